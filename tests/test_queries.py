"""Every registered query against its SQL at the smallest scale."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import gleanery.queries as registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_matches_sql(spark, duck, data, name):
    df = registered.QUERIES[name](spark, data)
    got = sorted(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    found = duck.execute(registered.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in sorted(names))) for r in found.fetchall())
    assert got == want


def test_queries_without_sql_give_rows(spark, data):
    for name in set(registered.QUERIES) - set(registered.ORACLES):
        assert registered.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The tree without both folders of those operators, the pipeline's module still there: all other queries are listed and run."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    tree = tmp_path / "tree"
    shutil.copytree(root, tree, ignore=lambda path, names: {n for n in names if n in (".git", "__pycache__") or n == "llm"})
    code = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
from gleanery.queries import ORACLES, QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.entry(spark).count())
"""
    env = {**os.environ, "PYTHONPATH": str(tree)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tree, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
