"""Preference formatting: shared prompt, paired completions, loss masks.

Turns are compared at equal turn numbers, so a conversation never has to be gathered to be compared: one
shuffle by (pair, turn) puts the two sides of a turn next to each other. The first turn at which the
sides differ is a minimum per pair. Strings are assembled in two levels (spans of 64 turns, then pairs), so that
the last step of a very long conversation gathers a row per 64 turns. Masks are running sums of lengths in the same two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 64
LAST = (1 << 63) - 1


def preference_pairs(
    turns: DataFrame,
    pair_col: str = "pair_id",
    chosen_col: str = "is_chosen",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per pair: ``pair_id, prompt, chosen, rejected``, their turn counts and loss masks.

    Input: one row per turn; ``is_chosen`` says to which side it belongs. The prompt is the longest prefix of turns
    that both sides share (role and text equal, nulls equal to nulls); it is rendered once and never
    trained on. Each completion is the rest of its side. A mask is an array of ``start, stop`` character spans
    of the completion: the texts (with end marks) of turns of ``trained_role``. If one side has no turns, the
    prompt is empty and so is that side's completion. Null texts render as empty, null roles as ``unknown``,
    null turn numbers come last. Turns repeated under one number are ordered by role and text and all
    rendered. Rows with a null pair or side belong to no pair and are left out. Extra columns are ignored.
    """
    t = turns.select(
        F.col(pair_col).cast("long").alias("pair_id"),
        F.col(chosen_col).cast("boolean").alias("good"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)).alias("turn"),
        F.struct(F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("said"),
    ).where("pair_id is not null and good is not null")
    t = t.repartition("pair_id", "turn")  # one exchange serves the numbering of repeats and the pairing of sides
    t = t.withColumn("dup", F.row_number().over(W.partitionBy("pair_id", "good", "turn").orderBy("said")))
    sides = t.groupBy("pair_id", "turn", "dup").agg(
        F.max(F.when(F.col("good"), F.col("said"))).alias("c"), F.max(F.when(~F.col("good"), F.col("said"))).alias("r")
    )
    differs = ~(F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c").eqNullSafe(F.col("r")))
    cut = sides.groupBy("pair_id").agg(F.min(F.when(differs, F.struct("turn", "dup"))).alias("cut"))
    sides = sides.join(cut, "pair_id")
    shared = F.col("cut").isNull() | (F.struct("turn", "dup") < F.col("cut"))
    parts = sides.select(
        "pair_id",
        "turn",
        "dup",
        F.explode(
            F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said")))).otherwise(
                F.array_compact(
                    F.array(
                        F.when(F.col("c").isNotNull(), F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said"))),
                        F.when(F.col("r").isNotNull(), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said"))),
                    )
                )
            )
        ).alias("p"),
    )
    role, text = F.coalesce("p.said.role", F.lit("unknown")), F.coalesce("p.said.text", F.lit(""))
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"))
    body = F.concat(text, F.lit("<|end|>\n"))
    bits = parts.select(
        "pair_id",
        F.col("p.part").alias("part"),
        F.expr(f"turn div {CHUNK}").alias("chunk"),
        "turn",
        "dup",
        F.concat(head, body).alias("text"),
        F.length(head).cast("long").alias("head"),
        F.length(body).cast("long").alias("body"),
        (role == trained_role).alias("train"),
    )
    # Running lengths inside a chunk, then over chunks: a mask costs no more than its turns. Windows and groups of a step share their exchange.
    inside = W.partitionBy("pair_id", "part", "chunk").orderBy("turn", "dup").rowsBetween(W.unboundedPreceding, -1)
    bits = bits.withColumn("at", F.coalesce(F.sum(F.col("head") + F.col("body")).over(inside), F.lit(0)))
    chunks = bits.groupBy("pair_id", "part", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("turn", "dup", "text"))).alias("bits"),
        F.sort_array(F.collect_list(F.when(F.col("train"), F.struct((F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.col("body")).alias("stop"))))).alias("spans"),
        F.sum(F.col("head") + F.col("body")).alias("length"),
    )
    chunks = chunks.select("pair_id", "part", "chunk", F.array_join(F.transform("bits", lambda b: b.text), "").alias("text"), F.size("bits").cast("long").alias("turns"), "spans", "length")
    before = W.partitionBy("pair_id").orderBy("part", "chunk").rowsBetween(W.unboundedPreceding, -1)
    earlier = [F.when(F.col("part") == p, F.sum(F.when(F.col("part") == p, F.col("length"))).over(before)) for p in ("chosen", "rejected")]
    chunks = chunks.withColumn("at", F.coalesce(*earlier, F.lit(0)))
    moved = F.transform("spans", lambda s: F.struct((s.start + F.col("at")).cast("int").alias("start"), (s.stop + F.col("at")).cast("int").alias("stop")))
    pieces = chunks.select("pair_id", "part", "turns", F.struct("chunk", "text", moved.alias("spans")).alias("piece"))
    three = ("prompt", "chosen", "rejected")
    whole = pieces.groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("part") == p, F.col("piece")))).alias(p) for p in three],
        *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("turns"))), F.lit(0)).alias(f"{p}_turns") for p in three],
    )
    return whole.select(
        "pair_id",
        *[F.array_join(F.transform(p, lambda x: x.text), "").alias(p) for p in three],
        *[f"{p}_turns" for p in three],
        *[F.flatten(F.transform(p, lambda x: x.spans)).alias(f"{p}_mask") for p in ("chosen", "rejected")],
    )


def paired_conversations(conversations: DataFrame) -> DataFrame:
    """Pair conversation 2k (chosen) with 2k+1 (rejected); no key is hot that wasn't hot before."""
    return conversations.select(F.expr("conv_id div 2 - if(conv_id < 0 and conv_id % 2 <> 0, 1, 0)").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turn", "role", "text")


def op1_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference_pairs(paired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def spans(part: str):
        return F.array_join(F.transform(f"{part}_mask", lambda s: F.concat_ws(":", s.start.cast("string"), s.stop.cast("string"))), ",")

    return made.select(
        "pair_id", "prompt_turns", "chosen_turns", "rejected_turns", "prompt", "chosen", "rejected", spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans")
    )


OP1_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, coalesce(turn, 9223372036854775807) AS turn, role, text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS dup
  FROM conversations WHERE conv_id IS NOT NULL
), cut AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
         min(CASE WHEN c.pair_id IS NULL OR r.pair_id IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
                  THEN [coalesce(c.turn, r.turn), coalesce(c.dup, r.dup)] END) AS cut
  FROM (SELECT * FROM t WHERE good) c FULL JOIN (SELECT * FROM t WHERE NOT good) r
    ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.dup = r.dup
  GROUP BY 1
), seg AS (
  SELECT t.pair_id, turn, dup,
         CASE WHEN cut IS NULL OR [turn, dup] < cut THEN CASE WHEN good THEN 'prompt' END WHEN good THEN 'chosen' ELSE 'rejected' END AS part,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body,
         coalesce(role, 'unknown') = 'assistant' AS train
  FROM t JOIN cut USING (pair_id)
), pos AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part ORDER BY turn, dup) - length(body) AS start FROM seg WHERE part IS NOT NULL
)
SELECT pair_id, count(*) FILTER (part = 'prompt') AS prompt_turns, count(*) FILTER (part = 'chosen') AS chosen_turns,
       count(*) FILTER (part = 'rejected') AS rejected_turns,
       coalesce(string_agg(head || body, '' ORDER BY turn, dup) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY turn, dup) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY turn, dup) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(start::BIGINT || ':' || (start + length(body))::BIGINT, ',' ORDER BY turn, dup) FILTER (part = 'chosen' AND train), '') AS chosen_spans,
       coalesce(string_agg(start::BIGINT || ':' || (start + length(body))::BIGINT, ',' ORDER BY turn, dup) FILTER (part = 'rejected' AND train), '') AS rejected_spans
FROM pos GROUP BY pair_id
"""
