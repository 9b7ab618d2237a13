import corpus_pipeline
from pyspark.sql import functions as F

from gleanery.llm.common import materialise

from .helpers import SCHEMA, awkward_rows, components

SMALL = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs, columns = spark.read.parquet(f"{SMALL}/documents.parquet"), list(corpus_pipeline.COLUMNS)
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(materialise(stage(spark, seen[-1], SMALL), f"t{k}"))
    assert all(d.columns == columns for d in seen[1:-1])
    texts = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in seen[:-1]]
    kept = {}
    for i, t in texts[1]:
        kept[t] = max(i, kept.get(t, i))
    assert sorted(texts[2]) == sorted((i, t) for t, i in kept.items())
    near = {i for i, _, c in components(texts[2]) if i == c}
    assert sorted(texts[3]) == sorted(x for x in texts[2] if x[0] in near)
    assert {i for i, _ in texts[4]} <= near
    assert seen[5].count() == len(texts[4])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(i for i, _ in texts[4])


def test_stages_take_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            assert out.count() <= 3 * rows.count()
    once = corpus_pipeline.drop_copies(spark, docs, SMALL)
    assert once.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert once.where("doc_id = 9").count() == 1


def test_rows_that_repeat_an_id_are_judged_for_themselves(spark):
    t, u = " ".join(f"t{i}" for i in range(60)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, t, "en", "a", 1), (9, t + " word", "en", "a", 1), (9, u, "en", "a", 1), (9, u, "en", "a", 1), (None, u + " x", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    once = materialise(corpus_pipeline.drop_copies(spark, docs, SMALL), "t")
    assert sorted(map(repr, map(tuple, once.collect()))) == sorted(map(repr, set(rows)))
    near = materialise(corpus_pipeline.drop_near_copies(spark, once, SMALL), "t")
    assert sorted(map(repr, map(tuple, near.collect()))) == sorted(map(repr, {rows[0], rows[2], rows[4]}))
    mixed = [tuple(r) for r in corpus_pipeline.apply_mix(spark, near, SMALL).collect()]
    assert set(mixed) <= set(rows) and max(map(mixed.count, mixed)) <= 3
