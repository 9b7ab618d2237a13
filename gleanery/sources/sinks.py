"""Output forms of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed


def flat(records: DataFrame, columns: list[str]) -> DataFrame:
    """Strings only, in the given order: null is empty, arrays are joined by commas, missing columns are empty."""
    have = dict(records.dtypes)

    def text(c: str) -> Column:
        if c not in have:
            return F.lit("")
        value = F.array_join(F.col(c), ", ") if have[c].startswith("array<string") else F.to_json(F.col(c)) if have[c].startswith(("map", "struct", "array")) else F.col(c).cast("string")
        return F.coalesce(value, F.lit(""))

    return records.select(*[text(c).alias(c) for c in columns])


def write_csv(records: DataFrame, path: str, columns: list[str] = fixed.JOB_CSV) -> None:
    flat(records, columns).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def csv_line(columns: list[str]) -> Column:
    """One line with every value quoted, quotes doubled and line breaks turned into spaces."""
    quoted = [F.concat(F.lit('"'), F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\r?\n", " "), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted)


def write_quoted_csv(records: DataFrame, path: str, columns: list[str]) -> None:
    """Files with a byte-order mark, a header line and CRLF ends, for spreadsheets: one for each ``FILE_ROWS`` records."""
    head = "\ufeff" + ",".join(columns)
    _framed(flat(records, columns).select(csv_line(columns).alias("value")), F.lit(head), None).write.option("lineSep", "\r\n").text(path)


FILE_ROWS = 1_000_000


def _framed(lines: DataFrame, first: Column, last: Column | None, comma: bool = False) -> DataFrame:
    """Lines dealt to files by hash, each file begun by a line and, if given, ended by one; with commas before all but its first record."""
    spark, files = lines.sparkSession, max(1, -(-lines.count() // FILE_ROWS))
    ends = [spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(k).alias("k"), v.alias("value")) for k, v in ((0, first), (3, last)) if v is not None]
    rows = lines.select(F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("file"), F.lit(2).alias("k"), "value")
    if comma:
        nth = F.row_number().over(W.partitionBy("file").orderBy("value"))
        rows = rows.withColumn("k", F.when(nth == 1, 1).otherwise(2)).withColumn("value", F.when(F.col("k") == 1, F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    for part in ends:
        rows = rows.unionAll(part)
    return rows.repartitionById(files, F.col("file")).sortWithinPartitions("k", "value").select("value")


def write_json_array(records: DataFrame, path: str) -> None:
    """Files that hold one JSON array each, a record a line; an empty table gives an empty array."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "false"})
    _framed(records.select(line.alias("value")), F.lit("["), F.lit("]"), comma=True).write.text(path)


def write_ndjson(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", False).json(path)


def properties(mapping: dict[str, str]) -> Column:
    """JSON of typed page properties: titles, URLs and rich text by field name."""
    parts = []
    for field, name in mapping.items():
        value = F.coalesce(F.col(field).cast("string"), F.lit(""))
        content = F.array(F.struct(F.struct(value.alias("content")).alias("text")))
        kind = F.struct(content.alias("title")) if field == "title" else F.struct(value.alias("url")) if field.endswith("_url") else F.struct(content.alias("rich_text"))
        parts.append(kind.alias(name))
    return F.to_json(F.struct(*parts))


def fan_out(records: DataFrame, sinks: list) -> None:
    """Write once-computed records to several sinks (functions of a DataFrame)."""
    held = records.persist()
    try:
        for sink in sinks:
            sink(held)
    finally:
        held.unpersist()
