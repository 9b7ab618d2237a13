"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes (words) are summed per source; targets come from water-filling in closed form: sources sorted
   by cap/weight saturate in that order, so running sums find the level at which the rest share.
2. All targets are cut into blocks of ``B`` words. Seats (blocks) go to sources by highest quotients
   t/(2k+1). Rounding t/B already is a Sainte-Laguë allocation for the house it happens to sum to; the few
   seats between that house and the wanted one are won or lost by quotient, so a number of candidates
   proportional to the number of sources is ranked, however many blocks there are. Seats are dealt to
   shards in turn, which gives each (source, shard) an integer quota (``mix_shards``; ``mix`` leaves shards out).
   What a source's target has beyond its seats, or lacks, is apportioned by the same rule in blocks of one word: one of its
   blocks is taken in part, so a source of a few words gets its few words.
3. A source's documents, in seeded order, are one stream of words cut into blocks. A quota of more words
   than the stream takes whole passes first, then blocks chosen by seeded rank until the words are reached. A document's part of the
   chosen blocks follows from prefix sums over blocks and over documents.

All prefix sums have two levels (``running``), so neither a source's rows nor all sources meet in one task. Rows equal in id, text and
source are one row with a count until the end. The table of blocks has at most ``blocks`` rows and five for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, ordered, running, text_or_empty

BLOCKS = 1 << 14
SHARDS = 16
ROWS_PER_GROUP = 4096


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``skey, source_size, n, rank, total, target`` from rows of ``skey, size`` (and ``copies``): one row per source."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    per = ordered(rows.groupBy("skey").agg(F.sum(F.col("size") * copies).alias("source_size"), F.sum(copies).alias("n")), "skey")
    per = running(per, [], "chunk", ["skey"], rank=F.lit(1)).withColumn("rank", F.col("rank") + 1).drop("chunk")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = ordered(per, "ratio", "rank")
    every = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights")).first()
    per = running(per, [], "chunk", ["ratio", "rank"], cap_before=F.col("cap"), weight_before=F.col("weight")).drop("chunk")
    full = F.col("ratio") <= (F.lit(float(every["total"])) - F.col("cap_before")) / (F.lit(every["weights"]) - F.col("weight_before"))
    per = materialise(per.withColumn("full", full), "filled")
    held = per.where("full").agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (float(every["total"]) - held["cap"]) / (every["weights"] - held["weight"]) if every["weights"] > held["weight"] else 0.0
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return per.select("skey", "source_size", "n", "rank", F.lit(every["total"]).cast("long").alias("total"), target.alias("target"))


def apportion(targets: DataFrame, blocks: int = BLOCKS, block: int | None = None, seats: str = "seats") -> DataFrame:
    """Add ``block`` (words in a block) and ``seats`` (blocks of the source) by Sainte-Laguë's quotients.

    Without ``block`` there are some ``blocks`` of them, and four more for each source.
    """
    targets = targets.drop("block")
    few = targets.agg(F.count(F.lit(1)).alias("sources"), F.max("total").alias("total")).first()
    sources, total = few["sources"], few["total"] or 0
    block = block or max(1, -(-total // (blocks + 4 * sources)))
    house = math.floor(total / block + 0.5)
    base = targets.withColumn("block", F.lit(block).cast("long")).withColumn("base", F.floor(F.col("target") / block + 0.5).cast("long"))
    lack = house - (base.agg(F.sum("base")).first()[0] or 0)
    if not lack:
        return base.withColumnRenamed("base", seats)
    # A source wins or loses at most its share of what is lacking, and two seats by rounding.
    span = F.ceil(F.col("target") * float(abs(lack) + sources) / max(1.0, float(total))) + 2
    steps = base.select("skey", "rank", "target", "base", F.explode(F.sequence(F.lit(1).cast("long"), span.cast("long"))).alias("j"))
    steps = steps.withColumn("seat", F.col("base") + F.col("j") if lack > 0 else F.col("base") - F.col("j") + 1).where("seat >= 1")
    quotient = F.col("target") / (2 * F.col("seat") - 1)
    steps = steps.select("skey", (-quotient if lack > 0 else quotient).alias("first"), (F.col("rank") if lack > 0 else -F.col("rank")).alias("then"))
    placed = running(ordered(steps, "first", "then"), [], "chunk", ["first", "then"], place=F.lit(1))
    moved = placed.where(F.col("place") < abs(lack)).groupBy("skey").agg(F.count(F.lit(1)).alias("moved"))
    return base.join(moved, "skey", "left").withColumn(seats, F.col("base") + F.coalesce("moved", F.lit(0)) * (1 if lack > 0 else -1)).drop("base", "moved")


def shard_quotas(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``skey, shard, quota``: seats dealt to shards in turn, so shards differ by one block at most."""
    start = running(ordered(plan.select("skey", "rank", "seats"), "rank"), [], "chunk", ["rank"], start=F.col("seats"))
    one = start.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    gap = F.pmod(F.col("shard") - F.col("start"), F.lit(shards))
    return one.select("skey", "shard", F.greatest(F.lit(0), F.ceil((F.col("seats") - gap) / shards)).cast("long").alias("quota"))


def _key(source_col: str) -> Column:
    source = F.col(f"`{source_col}`").cast("string")
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """Seeded place of a row by id and text."""
    return F.md5(F.concat(F.lit(f"doc:{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("null")), F.lit(":"), F.md5(text_or_empty(f"`{text_col}`"))))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights: tuple[int, ...], max_epochs: int, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their words' places ``a`` to ``b`` in their source's stream, the plan of sources, and blocks with seeded rank and the words ``take`` that a last pass takes from them."""
    size = F.regexp_count(text_or_empty(f"`{text_col}`"), F.lit(WORD_PATTERN)).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _key(source_col).alias("skey"), size.alias("size"), _order(id_col, text_col, seed).alias("order"))
    rows = materialise(rows.groupBy("skey", "order", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    plan = source_targets(rows, weights, max_epochs)
    plan = apportion(apportion(plan, block=1, seats="words"), blocks)
    plan = plan.withColumn("words", F.least("words", F.col("source_size") * max_epochs))
    plan = plan.withColumn("epochs", F.coalesce(F.expr("words div nullif(source_size, 0)"), F.lit(0)).cast("long"))
    plan = materialise(plan.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")), "plan")
    largest = plan.agg(F.max("n")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(1, largest / ROWS_PER_GROUP), 16)))

    # Blocks of each source and, by seeded rank, those that the last, partial pass takes, one of them in part.
    cut = plan.where("source_size > 0").select("skey", "block", "source_size", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(source_size - 1) div block"))).alias("at"))
    cut = cut.withColumn("words", F.least(F.col("block"), F.col("source_size") - F.col("at") * F.col("block")))
    cut = cut.withColumn("chance", F.md5(F.concat(F.lit(f"block:{seed}:"), F.col("skey"), F.lit(":"), F.col("at").cast("string")))).withColumn("sub", F.substring("chance", 1, 2))
    cut = running(cut, ["skey"], "sub", ["chance", "at"], nth=F.lit(1), earlier=F.col("words"))
    take = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("earlier")))
    cut = cut.select("skey", "at", "nth", take.cast("long").alias("take"), F.expr("at div 64").alias("sub"))
    cut = materialise(running(cut, ["skey"], "sub", ["at"], taken_before=F.col("take")).drop("sub"), "blocks")

    # Where each row starts in its source's seeded stream of words.
    rows = running(rows.withColumn("sub", F.substring("order", 1, digits)), ["skey"], "sub", ["order", "doc_id", "size"], a=F.col("size") * F.col("copies"))
    # A source without words has nothing to place; its rows stay. A row per source is broadcast if it is below the session's threshold.
    rows = rows.join(plan.select("skey", "source_size", "target", "block", "epochs"), "skey")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("a", F.col("a") + F.col("copy") * F.col("size"))
    return rows.withColumn("b", F.col("a") + F.col("size")), plan, cut


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights: tuple[int, ...], max_epochs: int, blocks: int) -> DataFrame:
    """A row per input row: its unit (``skey, order``), copies of that, its number among them, and the words taken."""
    rows, _, cut = _placed(docs, id_col, text_col, source_col, seed, weights, max_epochs, blocks)
    # The end of a document is looked up at its last word, whose block always exists.
    for x, tag in ((F.col("a"), "a"), (F.col("b") - 1, "z")):
        edge = cut.select("skey", F.col("at").alias(f"at_{tag}"), F.col("take").alias(f"take_{tag}"), F.col("taken_before").alias(f"until_{tag}"))
        rows = rows.withColumn("x", x).withColumn(f"at_{tag}", F.expr("x div block")).join(edge, ["skey", f"at_{tag}"], "left")

    def until(x: str, tag: str):
        return F.col(f"until_{tag}") + F.least(F.col(x) - F.col(f"at_{tag}") * F.col("block"), F.col(f"take_{tag}"))

    taken = F.col("epochs") * F.col("size") + F.when(F.col("size") > 0, until("b", "z") - until("a", "a")).otherwise(0)
    return rows.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    blocks: int = BLOCKS,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``doc_id, size, source_size, target, taken``, one row per input row. A source's ``taken`` words differ from its target
    by less than two. Null or empty texts have size 0 and nothing is taken of them; a null source is a source of its own, ordered last. Rows
    follow each other by a seeded hash of id and text, so rows that repeat an id, or have none, are spread; rows equal in both
    are alike in any run. A table without words gives targets of 0. Extra columns are ignored. ``taken`` never exceeds
    ``max_epochs`` times ``size``.
    """
    return _taken(docs, id_col, text_col, source_col, seed, weights, max_epochs, blocks).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: whole documents.

    A row of which ``taken`` words are taken appears floor(taken / size) times, and once more with the
    remaining fraction as its chance, by seeded hash: sources keep to their targets and reruns agree. Each row is
    judged for itself, also where ids repeat; rows equal in id, text and source share out what falls to them. Rows without words aren't taken.
    """
    chance = F.pmod(F.xxhash64(F.lit(f"mix:{seed}"), "order", "copy"), F.lit(1 << 30)) / float(1 << 30)
    share = F.col("taken") / F.col("size")
    taken = _taken(docs, id_col, text_col, source_col, seed, weights, max_epochs, blocks).where("taken > 0")
    units = taken.select("skey", "order", "copies", (F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("long").alias("times"))
    units = materialise(units.groupBy("skey", "order", "copies").agg(F.sum("times").alias("times")).where("times > 0"), "units")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(source_col).alias("skey"), _order(id_col, text_col, seed).alias("order"))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.where("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")

    mixed = spread(whole.join(units.where("copies = 1"), ["skey", "order"]))
    if units.where("copies > 1").limit(1).count():
        # Rows of one unit may differ in other columns: each such kind gets its part of the unit's copies.
        kinds = whole.join(units.where("copies > 1"), ["skey", "order"]).groupBy("skey", "order", "copies", "times", "row").agg(F.count(F.lit(1)).alias("of"))
        until = F.sum("of").over(W.partitionBy("skey", "order").orderBy(F.xxhash64("row"), F.to_json("row")).rowsBetween(W.unboundedPreceding, 0))
        kinds = kinds.withColumn("until", until)
        mixed = mixed.unionByName(spread(kinds.withColumn("times", F.expr("times * until div copies - times * (until - of) div copies"))))
    return mixed


def mix_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
) -> DataFrame:
    """How many words of each document the mix takes into each shard.

    Returns ``doc_id, size, source_size, target, shard, taken``: a row per input row and shard that takes words of it. Over shards ``taken``
    sums to that of ``mix``. The blocks that a source gives, those of whole passes and the one in part included, have quotas per shard (``shard_quotas``);
    they are dealt to shards in turn by pass and seeded rank, which fills every quota.
    """
    rows, plan, cut = _placed(docs, id_col, text_col, source_col, seed, weights, max_epochs, blocks)
    given = cut.groupBy("skey").agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("take") > 0, 1)).alias("picks"))
    seats = plan.join(given, "skey").select("skey", "rank", "block", "epochs", "blocks", (F.col("epochs") * F.col("blocks") + F.col("picks")).alias("seats"))
    first = running(ordered(seats, "rank"), [], "chunk", ["rank"], first=F.col("seats")).select("skey", "epochs", "blocks", "first")
    dealt = cut.join(first, "skey").withColumn("times", F.col("epochs") + (F.col("take") > 0).cast("long")).where("times > 0")
    turn = F.col("first") + F.col("pass") * F.col("blocks") + F.col("nth")
    dealt = dealt.select("skey", "at", "take", "blocks", "first", "nth", F.col("epochs").alias("passes"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("pass"))
    dealt = dealt.select("skey", "at", F.struct("pass", "passes", "take", F.pmod(turn, F.lit(shards)).cast("int").alias("shard")).alias("into"))
    dealt = dealt.groupBy("skey", "at").agg(F.collect_list("into").alias("into"))  # a pass each, so few
    parts = rows.where("size > 0").withColumn("at", F.explode(F.sequence(F.expr("a div block"), F.expr("(b - 1) div block")))).join(dealt, ["skey", "at"])
    parts = parts.withColumn("into", F.explode("into"))
    start = F.col("at") * F.col("block")
    stop = start + F.when(F.col("into.pass") < F.col("into.passes"), F.col("block")).otherwise(F.col("into.take"))
    parts = parts.withColumn("shard", F.col("into.shard")).withColumn("words", F.least(F.col("b"), stop) - F.greatest(F.col("a"), start)).where("words > 0")
    # A row's place in its source's stream tells it from others of the same id.
    return parts.groupBy("skey", "a", "doc_id", "size", "source_size", "target", "shard").agg(F.sum("words").cast("long").alias("taken")).drop("skey", "a")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_source_mix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('doc:42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents
), per AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) AS rnk FROM sized GROUP BY skey
), w AS (
  SELECT *, ([5.0, 2.0, 1.0])[(rnk - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap,
         sum(source_size) OVER ()::DOUBLE AS total, count(*) OVER () AS sources FROM per
), fill AS (
  SELECT *, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before
  FROM w WINDOW b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sat AS (
  SELECT *, cap / weight <= (total - cap_before) / (weights - weight_before) AS is_full FROM fill
), tgt AS (
  SELECT *, CASE WHEN is_full THEN cap
                 ELSE (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / (weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) * weight END::DOUBLE AS target,
         greatest(1, ceil(total / (16384 + 4 * sources)))::BIGINT AS block
  FROM sat
), base AS (  -- the rule of highest quotients in blocks of one word
  SELECT *, floor(target + 0.5)::BIGINT AS base, total::BIGINT AS house FROM tgt
), need AS (SELECT *, house - sum(base) OVER () AS lack FROM base
), steps AS (
  SELECT *, CASE WHEN lack > 0 THEN base + j ELSE base - j + 1 END AS seat
  FROM (SELECT *, unnest(generate_series(1, abs(lack)::BIGINT)) AS j FROM need WHERE lack <> 0)
), moved AS (
  SELECT skey, sum(sign(lack))::BIGINT AS moved FROM (
    SELECT *, row_number() OVER (ORDER BY CASE WHEN lack > 0 THEN -target / (2 * seat - 1) ELSE target / (2 * seat - 1) END,
                                          CASE WHEN lack > 0 THEN rnk ELSE -rnk END) AS place FROM steps WHERE seat >= 1)
  WHERE place <= abs(lack) GROUP BY skey
), quota AS (
  SELECT n.*, least(base + coalesce(moved, 0), source_size * 3)::BIGINT AS words FROM need n LEFT JOIN moved USING (skey)
), plan AS (
  SELECT skey, source_size, target, block, coalesce(words // nullif(source_size, 0), 0) AS epochs,
         words - coalesce(words // nullif(source_size, 0), 0) * source_size AS rest FROM quota
), cut AS (
  SELECT skey, rest, block, bno, least(block, source_size - bno * block) AS words, md5('block:42:' || skey || ':' || bno::VARCHAR) AS chance
  FROM (SELECT *, unnest(generate_series(0, (source_size - 1) // block)) AS bno FROM plan WHERE source_size > 0)
), blk AS (  -- how much of a block the last pass takes: its first words
  SELECT skey, bno, greatest(0, least(words, rest - (sum(words) OVER (PARTITION BY skey ORDER BY chance, bno) - words)))::BIGINT AS take FROM cut
), placed AS (
  SELECT s.*, p.source_size, p.target, p.block, p.epochs,
         coalesce(sum(size) OVER (PARTITION BY skey ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM sized s JOIN plan p USING (skey)
), part AS (
  SELECT p.doc_id, p.skey, p.a, p.ord, sum(greatest(0, least(p.a + size, bno * p.block + take) - greatest(p.a, bno * p.block))) AS got
  FROM placed p JOIN blk b ON b.skey = p.skey AND b.take > 0 AND size > 0 AND b.bno BETWEEN p.a // p.block AND (p.a + size - 1) // p.block
  GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.epochs * p.size + CASE WHEN p.size > 0 THEN coalesce(got, 0) ELSE 0 END)::BIGINT AS taken
FROM placed p LEFT JOIN part ON part.skey = p.skey AND part.ord = p.ord AND part.a = p.a
"""
