"""Counts over records: stages, coverage, dashboard, top values, runs and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage_counts(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows that pass each predicate, in one pass."""
    return rows.agg(*[F.count_if(p).alias(name) for name, p in stages.items()])


def fill_report(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n, total, pct`` of non-empty values: one aggregate over all fields, then one row per field."""
    wide = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f"n{i}") for i, f in enumerate(fields)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("n")) for i, f in enumerate(fields)]))
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("f.n") / F.col("total"), 1)).otherwise(0.0)
    return wide.select("total", each.alias("f")).select("f.field", "f.n", "total", pct.alias("pct"))


def top_n(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent non-empty values; ties by name."""
    counted = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(n)


def top_n_of(rows: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    return reduce(DataFrame.unionAll, [top_n(rows, c, n).select(F.lit(c).alias("dimension"), "value", "n") for c in columns])


def dashboard(rows: DataFrame, saved: str, now: Column, flags: dict[str, Column]) -> DataFrame:
    """Total, last day, last week, and a count per flag, in one aggregate; ``now`` is a scalar column."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(saved).cast("timestamp"))
    day = 86_400_000_000
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(age < day).alias("last_day"), F.count_if(age < 7 * day).alias("last_week"), *[F.count_if(p).alias(k) for k, p in flags.items()])


def run_counters(attempts: DataFrame, run: str, ok: Column) -> DataFrame:
    return attempts.groupBy(run).agg(F.count(F.lit(1)).alias("done"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 1).alias("pct_ok"))


def failure_rollup(attempts: DataFrame, keys: list[str], ok: Column, reason: str, order: list[str]) -> DataFrame:
    """Per key with any failure: failed attempts, last reason and time, whether a later success resolved it."""
    when = F.struct(*order)
    rolled = attempts.groupBy(*keys).agg(
        F.count_if(~ok).alias("attempts"),
        F.max_by(F.when(~ok, F.col(reason)), F.when(~ok, when)).alias("reason"),
        F.max(F.when(~ok, F.col(order[0]))).alias("last_attempt_at"),
        F.max(F.when(~ok, when)).alias("__bad"),
        F.max(F.when(ok, when)).alias("__good"),
    )
    return rolled.where("attempts > 0").withColumn("resolved", F.coalesce(F.col("__good") > F.col("__bad"), F.lit(False))).drop("__bad", "__good")


def monthly_totals(rows: DataFrame, at: str, sums: dict[str, Column]) -> DataFrame:
    return rows.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.count(F.lit(1)).alias("calls"))


def within_budget(rows: DataFrame, at: str, cost: str, order: list[str], cap: float) -> DataFrame:
    """Rows whose month had spent less than ``cap`` before them, in order; ``order`` begins with ``at``.

    Sums run inside days, and over the days of a month, so no task sorts a month.
    """
    if order[0] != at:
        raise ValueError("the order begins with the time")
    rows = rows.withColumn("__day", F.date_format(at, "yyyy-MM-dd"))
    days = rows.groupBy("__day").agg(F.sum(cost).alias("spent"))
    before = W.partitionBy(F.substring("__day", 1, 7)).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("__day", F.coalesce(F.sum("spent").over(before), F.lit(0)).alias("__earlier"))
    inside = W.partitionBy("__day").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(inside), F.lit(0)) + F.col("__earlier")
    # Days that began beyond the cap go before they are sorted.
    rows = rows.join(days.where(F.col("__earlier") < cap), "__day").withColumn("spent_before", spent)
    return rows.where(F.col("spent_before") < cap).drop("__day", "__earlier")


def unpivoted(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Non-empty fields of each row as ``field, value`` rows."""
    return rows.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(keys, fields, "field", "value").where("value is not null and value <> ''")


def summary_lines(rows: DataFrame, parts: list[str], order: list[Column], n: int) -> DataFrame:
    """A count and the first ``n`` rows as lines of text: one row ``text``."""
    line = F.concat(F.lit("- "), F.concat_ws(" | ", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))
    first = rows.select(*[o.alias(f"__o{i}") for i, o in enumerate(order)], line.alias("line")).orderBy(*[f"__o{i}" for i in range(len(order))], "line").limit(n)
    few = first.agg(F.array_sort(F.collect_list(F.struct(*[f"__o{i}" for i in range(len(order))], "line"))).alias("l"))
    count = rows.agg(F.count(F.lit(1)).alias("c"))
    return count.crossJoin(few).select(F.array_join(F.concat(F.array(F.concat(F.lit("Records: "), F.col("c").cast("string"))), F.transform("l", lambda x: x.line)), "\n").alias("text"))
