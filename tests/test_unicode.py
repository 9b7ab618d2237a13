"""Unicode spaces, character references, targets that share a slug, and sinks and tables of many files."""

import html
import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions import salary, text
from gleanery.operators import ordered, reports
from gleanery.sources import registry, sinks


def test_unicode_spaces_in_running_text(spark):
    lines = ["CHF\u00a080\u202f000 - 110\u00a0000 / Jahr", "EUR\u00a060.000", "Head\u00a0of data", "5\u00a0years", "home\u00a0office"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = rows.select("i", salary.salary(F.col("x")).alias("s"), text.seniority(F.col("x")).alias("level"), text.experience_years(F.col("x")).alias("years"), text.workplace(F.col("x")).alias("place")).orderBy("i").collect()
    assert (got[0]["s"]["low"], got[0]["s"]["high"], got[1]["s"]["low"]) == ("80000", "110000", "60000")
    assert (got[2]["level"], got[3]["years"], got[4]["place"]) == ("head", "5", "remote")


@pytest.mark.parametrize("raw", ["Z&uuml;rich &#8211; Bern", "&amp;lt; &lt;b&gt; &quot;x&quot;", "&#x1F600; &#150; &#0; &#xD800; &#99999999;", "a & b &nosuch; &", "&NotEqualTilde; &nbsp;x", "plain", ""])
def test_references_as_the_standard_library_decodes_them(spark, raw):
    got = spark.createDataFrame([(raw,)], "x string").select(text.unescaped(F.col("x"))).first()[0]
    want = html.unescape(raw) if "&#99999999;" not in raw else html.unescape(raw).replace("\ufffd", "\ufffd")
    assert got == want
    assert spark.createDataFrame([(None,)], "x string").select(text.unescaped(F.col("x"))).first()[0] is None


def test_targets_that_share_a_slug(spark):
    body = json.dumps({"jobs": [{"title": "A", "absolute_url": "https://x.io/1"}]})
    rows = [("greenhouse", "acme", body, "first", 0), ("greenhouse", "acme", body, "second", 1), ("arbeitsagentur", "q", json.dumps({"stellenangebote": [{"refnr": "8", "beruf": "H"}, {"refnr": "8"}]}), "third", 2), ("arbeitsagentur", "q", json.dumps({"stellenangebote": [{"refnr": "8", "beruf": "H"}]}), "fourth", 3)]
    got = registry.stubs(spark.createDataFrame(rows, "adapter string, slug string, body string, target string, target_position int")).collect()
    assert sorted((r["target"], r["target_position"]) for r in got) == [("first", 0), ("fourth", 3), ("second", 1), ("third", 2)]


def test_files_of_csv_and_json_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 40)
    rows = spark.createDataFrame([(i, f'a "{i}"\nb', None) for i in range(100)], "id int, title string, tags string")
    sinks.write_quoted_csv(rows, str(tmp_path / "c"), ["id", "title"])
    files = sorted((tmp_path / "c").glob("part-*"))
    raw = [f.read_bytes().decode() for f in files]
    assert len(files) == 3 and all(x.startswith("\ufeffid,title\r\n") for x in raw)
    assert sum(x.count("\r\n") - 1 for x in raw) == 100
    for name, table, n in (("j", rows, 100), ("e", rows.limit(0), 0)):
        sinks.write_json_array(table, str(tmp_path / name))
        got = [r for f in (tmp_path / name).glob("part-*") for r in json.loads(f.read_text())]
        assert sorted(r["id"] for r in got) == list(range(n)) and all(r["tags"] is None for r in got)


def test_budget_and_pace_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(i, f"2024-0{rng.randrange(1, 3)}-{rng.randrange(1, 28):02d} 0{rng.randrange(9)}:00:00", rng.randrange(1, 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, at string, cost long").withColumn("at", F.col("at").cast("timestamp")).repartition(5)
    got = {r["id"]: r["spent_before"] for r in reports.within_budget(df, "at", "cost", ["at", "id"], 3000).collect()}
    spent, want = {}, {}
    for i, at, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        if (s := spent.get(at[:7], 0)) < 3000:
            want[i] = s
        spent[at[:7]] = s + cost
    assert got == want
    arrivals = [(f"h{rng.randrange(2)}", rng.random() * 40, i) for i in range(300)]
    paced = ordered.paced(spark.createDataFrame(arrivals, "h string, a double, i int").repartition(4), "h", "a", ["i"], 0.01)
    last, want = {}, {}
    for h, a, i in sorted(arrivals, key=lambda r: (r[1], r[2])):
        last[h] = want[i] = max(a, last.get(h, -1e9) + 0.01)
    assert {r["i"]: r["launch"] for r in paced.collect()} == pytest.approx(want)
