import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import ann, bpe, chat, components, exact_dedup, html_text, jaccard_join, labelled, mixing, quality, queries, sharding, toxicity
from gleanery.llm.common import scratch

from .helpers import SCHEMA, awkward_rows
from .helpers import components as brute_components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 chat ---------------------------------------------------------------------------------------------------------------


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, is_chosen boolean, turn long, role string, text string, prompt string, part string, chunk string")


def test_chat_shares_the_longest_prefix_once_and_masks_completions(spark):
    rows = [(1, g, t, r, x if t < 2 else x + ("!" if g else "?"), "p", "q", "c") for g in (True, False) for t, r, x in ((0, "system", "s"), (1, "user", "u"), (2, "assistant", "a"), (3, "user", "v"), (4, "assistant", "b"))]
    r = chat.preference_pairs(turns(spark, rows)).first()
    assert r["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n"
    assert r["chosen"] == "<|assistant|>\na!<|end|>\n<|user|>\nv!<|end|>\n<|assistant|>\nb!<|end|>\n"
    assert (r["prompt_turns"], r["chosen_turns"], r["rejected_turns"]) == (2, 3, 3)
    assert [r["chosen"][a:b] for a, b in r["chosen_mask"]] == ["a!<|end|>\n", "b!<|end|>\n"]
    assert [r["rejected"][a:b] for a, b in r["rejected_mask"]] == ["a?<|end|>\n", "b?<|end|>\n"]


def test_chat_awkward_turns(spark):
    rows = [(1, True, 0, None, None, "", "", ""), (1, False, 0, None, None, "", "", ""), (2, True, 0, "user", "only", "", "", ""), (None, True, 0, "x", "y", "", "", ""), (3, True, None, "user", "z", "", "", ""), (3, True, 0, "user", "a", "", "", ""), (3, True, 0, "user", "a", "", "", ""), (3, False, 0, "user", "a", "", "", "")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(turns(spark, rows)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["prompt"] == "<|unknown|>\n<|end|>\n" and got[1]["chosen"] == got[1]["rejected"] == ""
    assert got[2]["prompt"] == "" and got[2]["rejected"] == "" and got[2]["chosen_turns"] == 1
    assert got[3]["prompt_turns"] == 1 and got[3]["chosen"] == "<|user|>\na<|end|>\n<|user|>\nz<|end|>\n"
    assert chat.preference_pairs(turns(spark, [])).count() == 0


def test_chat_of_many_chunks_keeps_order(spark):
    rows = [(1, g, t, "user", str(t), "", "", "") for t in range(300) for g in (True, False)]
    r = chat.preference_pairs(turns(spark, rows)).first()
    assert r["prompt"] == "".join(f"<|user|>\n{t}<|end|>\n" for t in range(300)) and r["chosen"] == ""


def test_chat_of_very_many_turns_is_linear(spark):
    """64,000 turns of one conversation, numbered or all under one number: masks and texts agree, in seconds."""
    import time

    for number in (F.col("id"), F.lit(None).cast("long")):
        turn = spark.range(64_000).select(F.lit(1).alias("pair_id"), number.alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("%06d", "id").alias("text"))
        both = turn.withColumn("is_chosen", F.lit(True)).unionByName(turn.withColumn("is_chosen", F.lit(False)).where("text > '000000'"))
        start = time.perf_counter()
        r = chat.preference_pairs(both).first()
        assert time.perf_counter() - start < 6
        assert (r["prompt_turns"], r["chosen_turns"], r["rejected_turns"]) in {(0, 64_000, 63_999), (32_000, 32_000, 31_999)}
        spans = [r["chosen"][a:b] for a, b in r["chosen_mask"]]
        assert all(s.endswith("<|end|>\n") and s[:6].isdigit() and int(s[:6]) % 2 for s in spans) and len(spans) == r["chosen"].count("<|assistant|>")


# 2 byte-level BPE -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def reference_ids(vocabulary, text):
    import tiktoken

    tokens, pattern = vocabulary
    if not hasattr(reference_ids, "coder"):
        reference_ids.coder = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return reference_ids.coder.encode_ordinary(text or "")


def test_bpe_equals_the_library_and_round_trips(spark, awkward, vocabulary):
    got = sorted(bpe.encode_digests(awkward, *vocabulary).collect(), key=repr)
    want = []
    for i, text, *_ in awkward_rows():
        ids = reference_ids(vocabulary, text)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_ids_decode_by_table(spark, awkward, vocabulary):
    rows = bpe.decode(bpe.encode(awkward, *vocabulary), vocabulary[0]).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == sorted(t or "" for _, t, *_ in awkward_rows())
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(nulls, vocabulary[0]).orderBy("doc_id").collect()] == [None, b""]


def test_bpe_of_nothing(empty, vocabulary):
    assert bpe.encode_digests(empty, *vocabulary).count() == 0


def test_bpe_query_over_a_table(spark, vocabulary):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op2_bpe_round_trip"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: len(reference_ids(vocabulary, r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# 3, 4 classifiers -------------------------------------------------------------------------------------------------------


def accuracy(spark, name, label):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert scored["score"].between(0, 1).all()
    out = scored[scored["held_out"]]
    hit = (out["predicted"] == 1) & (out[label] == 1)
    return (out["predicted"] == out[label]).mean(), hit.sum() / max(1, (out["predicted"] == 1).sum()), hit.sum() / (out[label] == 1).sum()


def test_toxicity_on_held_out_labels(spark):
    right, precision, recall = accuracy(spark, "op3_subsequence_toxicity", "toxic")
    assert right > 0.97 and precision > 0.93 and recall > 0.85


def test_quality_on_held_out_labels(spark):
    right, precision, recall = accuracy(spark, "op4_factorisation_quality", "quality")
    assert right > 0.98 and precision > 0.98 and recall > 0.98


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", labelled.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) if r["doc_id"] is not None else r["h"] for r in rows)


def test_kernel_tolerates_gaps_and_insertions():
    k = toxicity.gram(["idiot", "id.iot", "i-d-i-o-t", "idxiot", "banana"], ["idiot"])[:, 0]
    # A subsequence that occurs twice in a word counts twice, so a word's kernel with itself may exceed 1.
    assert k[0] >= 1 and min(k[1], k[3]) > 0.4 and k[2] > 0.1 and k[4] < 0.05
    square = toxicity.gram(["abc", "abd", "xyz"], ["abc", "abd", "xyz"])
    assert np.linalg.eigvalsh(square).min() > -1e-6


def test_scores_are_kernel_sums_over_landmarks():
    """The folded machine against kernel values by brute force: subsequences enumerated one by one."""
    from itertools import combinations

    def vector(word):
        out, text = {}, "\x02" + word + "\x03"
        for n in (3, 4):
            for at in combinations(range(len(text)), n):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = "".join(text[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - n)
        return out

    def length(word):  # of all occurrences, as the operator takes it
        text = "\x02" + word + "\x03"
        return np.sqrt(sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1 - n)) for n in (3, 4) for at in combinations(range(len(text)), n) if at[-1] - at[0] < toxicity.SPAN))

    words, marks, weight = ["idiot", "id.iot", "achlichkeit", "the"], ["idiot", "achlich", "moron"], np.array([2.0, -1.0, 0.5])
    want = [[sum(x * vector(m).get(k, 0) for k, x in vector(w).items()) / length(w) / length(m) for m in marks] for w in words]
    assert np.allclose(toxicity.gram(words, marks), want, atol=1e-5)
    sums = np.zeros(1 << toxicity.BITS)
    for m, a in zip(marks, weight, strict=True):
        _, h, v = toxicity.subsequences([m])
        np.add.at(sums, h, a * v)
    machine = toxicity.SubsequenceMachine(sums.astype(np.float32), 0.25, np.array([0.0, 1, 0, 0]))
    assert np.allclose(machine.score_units(words), np.array(want) @ weight + 0.25, atol=1e-4)


def test_toxicity_learns_gapped_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" zorkwit " if i % 4 == 0 else "") + ".", int(i % 4 == 0)) for i in range(240)]
    machine = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    probe = spark.createDataFrame([(1, "quiet " + " ".join(words[:20])), (2, "you zork.wit now"), (3, "you zorxkwit now"), (4, "z o r k w i t"), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(probe, machine).collect()}
    assert min(got[2], got[3], got[4]) > max(got[1], got[5], got[6])


def test_classifiers_take_awkward_rows_and_empty_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, None), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        machine, factors = toxicity.toxicity(awkward, labels), quality.fit(awkward, labels)
        for scored in (toxicity.score_texts(awkward, machine), quality.score_texts(awkward, factors)):
            assert [0 <= r["score"] <= 1 for r in scored.collect()] == [True] * awkward.count()
    assert toxicity.score_texts(empty, machine).count() == quality.score_texts(empty, factors).count() == 0
    assert toxicity.with_scores(awkward.drop("score"), machine).columns[-1] == "score" and toxicity.with_scores(awkward, machine).columns[-1] == "score_"


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    at, x = np.array([1, 4, 7]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert m.margin(at, x) == pytest.approx(0.3 + m.linear[at] @ x + pairs)


# 5 exact dedup ----------------------------------------------------------------------------------------------------------


def test_exact_dedup_awkward(spark, awkward):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "t5"), 3)
    got = exact_dedup.exact_dedup(awkward, index).collect()
    by = {}
    for i, t, *_ in awkward_rows():
        by.setdefault(t or "", []).append(i)
    assert len(got) == len(awkward_rows())
    for t, ids in by.items():
        own = [r for r in got if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert [r["keep_id"] for r in own] == [best] * len(ids) and {r["group_size"] for r in own} == {len(ids)}
        assert [r["doc_id"] for r in own if r["kept"]] == [best]


def test_digest_index_persists(spark, empty):
    path = scratch(spark, "t5b")
    day = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.exact_dedup(day([(1, "x"), (2, "x"), (3, "y")]), exact_dedup.DigestIndex(spark, path, 3)).collect()
    assert sorted(r["doc_id"] for r in first if r["kept"]) == [2, 3]
    again = exact_dedup.exact_dedup(day([(4, "x"), (5, "z")]), exact_dedup.DigestIndex(spark, path, 3)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again} == {4: (2, False), 5: (5, True)}
    assert exact_dedup.exact_dedup(empty, exact_dedup.DigestIndex(spark, path, 3)).count() == 0
    assert exact_dedup.DigestIndex(spark, path, 3).read().count() == 3


def test_a_batch_may_be_repeated(spark):
    """A run that died behind its append and is repeated under its name keeps what it would have kept."""
    path = scratch(spark, "t5d")
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    index = exact_dedup.DigestIndex(spark, path, 3)
    exact_dedup.exact_dedup(rows.where("doc_id % 7 = 0"), index, batch_name="before")
    first = sorted(map(tuple, exact_dedup.exact_dedup(rows, index, batch_name="day").collect()))
    held = index.read().count()
    again = sorted(map(tuple, exact_dedup.exact_dedup(rows.repartition(3), index, batch_name="day").collect()))
    assert first == again and sum(r[3] for r in first) > 0 and index.read().count() == held
    assert not any(r["kept"] for r in exact_dedup.exact_dedup(rows, index, batch_name="other").collect())
    index.drop()


def test_digest_index_is_joined_without_shuffling_it(spark):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "t5c"), 3)
    index.append(spark.createDataFrame([(b"a", 1)], "digest binary, keep_id long"), "first")
    new = spark.createDataFrame([(b"a", 1), (b"b", 2)], "digest binary, keep_id long").hint("merge")
    plan = new.join(index.read(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


# 6 n-gram Jaccard join --------------------------------------------------------------------------------------------------


def grouped(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(df, **options).collect()), key=repr)


def test_jaccard_awkward(spark, awkward, empty):
    assert grouped(awkward) == brute_components([r[:2] for r in awkward_rows()])
    assert grouped(empty) == []


def near_copies(rng, groups, size, words=80):
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(len(rows) + i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(120)) + " " + passage) for i in range(90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"short": 3, "family_entries": 2000}])
def test_jaccard_groups_of_near_copies(spark, options):
    rows = near_copies(random.Random(5), 4, 60)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options)
    assert got == brute_components(rows)


def test_jaccard_shingles_of_very_many_sets_of_a_batch(spark):
    rows = near_copies(random.Random(9), 1, 150)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert got == brute_components(rows)


def test_links_are_counted_between_distinct_sets(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base, "x"])), (4, " ".join(["y", *base])), (5, "other words entirely here now")]
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 0}


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(2)
    for _ in range(50):
        owners, n = 60, 40
        own = [np.sort(rng.choice(owners, rng.integers(1, owners), replace=False)) for _ in range(n)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        query, need = np.flatnonzero(rng.random(n) < 0.5), int(rng.integers(1, 15))
        if not len(query):
            continue
        found, count = jaccard_join.divide_skip(query, np.concatenate(own), starts, need)
        want = np.bincount(np.concatenate([own[i] for i in query]), minlength=owners)
        assert found.tolist() == np.flatnonzero(want >= need).tolist() and count.tolist() == want[want >= need].tolist()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 sharding -------------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_reproducible(spark, awkward, empty):
    runs = [sorted((r["shard"], r["slot"], r["size"], repr(r["record"]["doc_id"])) for r in sharding.external_shuffle(awkward, 4, least_buckets=5, bucket_bytes=1000).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(awkward_rows())
    slots = {s: sorted(r[1] for r in runs[0] if r[0] == s) for s in range(4)}
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and all(v == list(range(len(v))) for v in slots.values())
    assert sorted(r[2] for r in runs[0]) == sorted(len((t or "").encode()) + 1 for _, t, *_ in awkward_rows())
    assert sharding.external_shuffle(empty, 4).count() == 0
    few = sharding.external_shuffle(awkward.limit(2), 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]


def test_shards_are_shuffled_and_written(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    done = sharding.external_shuffle(rows, 4, least_buckets=8)
    got = done.select("record.doc_id", "shard", "slot").toPandas().sort_values(["shard", "slot"])
    assert abs(np.corrcoef(got["doc_id"], np.arange(2000))[0, 1]) < 0.1
    sharding.write_shards(done, str(tmp_path / "s"))
    back = sharding.read_shards(spark, str(tmp_path / "s"), rows.schema).where("shard = 2").orderBy("slot")
    assert [r["doc_id"] for r in back.select("record.doc_id").collect()] == got[got["shard"] == 2]["doc_id"].tolist()


# 8 HTML extraction ------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-banner"><p>We use cookies</p></div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp; para with <b>bo</b>ld words.<p>Short.<aside>side</aside><figure><figcaption>Caption</figcaption></figure>
<div class="ad">Buy now</div><ul><li>One<li>Two</ul><form><input>Mail</form><section id="comments"><p>Nice!</p></section></article><footer>&copy; x</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more First para with bold words. Short. Caption One Two"
    loose = "<body><div id='menu'><a>a</a><a>b</a></div><div class='text'><h1>Head</h1>" + "<p>Some longer running text of an article, with several words.</p>" * 4 + "<p>End.</p></div><div class='sidebar'>links</div></body>"
    assert html_text.main_text(loose) == "Head " + "Some longer running text of an article, with several words. " * 4 + "End."
    named = "<div class='site-header'><p>Site</p></div><div class='post-header'><h1>Head</h1></div><div class='elementor-widget'><p>Some longer running text of an article here.</p></div><ol id='readerComments'><li>Hi</ol>"
    assert html_text.main_text(named) == "Head Some longer running text of an article here."
    for page, want in ((None, ""), ("", ""), ("plain", "plain"), ("<nav>x</nav>", ""), ("<p>a<p>b", "a b"), ("<p>x</b></i> y", "x y"), ("<article><p>un<b>closed", "unclosed"), ("<", "<")):
        assert html_text.main_text(page) == want


def test_smoothing_keeps_level_and_damps_peaks():
    flat = html_text.smoothed(np.full(9, 3.0))
    assert np.allclose(flat, 3) and html_text.smoothed(np.array([0, 0, 9.0, 0, 0])).max() < 4


def test_extraction_over_tables(spark):
    import html as standard
    import re

    for r in html_text.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"<(/?(p|h1)|br)>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1))
        assert r["text"] == " ".join(standard.unescape(re.sub(r"<[^>]*>", "", inner)).split())
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract(odd).collect()) == ["", "", "x", "x"]


# 9 nearest neighbours ---------------------------------------------------------------------------------------------------


def exact_neighbours(ids, x, q, k):
    dist = np.sqrt(((x.astype(float) - x[ids == q][0].astype(float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, dist)) if ids[i] != q][:k]
    return [(int(ids[i]), float(dist[i])) for i in order]


def test_recall_and_scores_over_a_table(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_anisotropic_search"](spark, folder).toPandas()
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"])
    found = total = 0
    for q in ids[ids % 100 == 0]:
        want, own = exact_neighbours(ids, x, q, 10), got[got["query_id"] == q].sort_values("rank")
        found += len({i for i, _ in want} & set(own["vec_id"]))
        total += 10
        true = {int(i): d for i, d in zip(ids, np.sqrt(((x.astype(float) - x[ids == q][0].astype(float)) ** 2).sum(1)), strict=True)}
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], [true[i] for i in own["vec_id"]], rtol=1e-12)
    assert found / total >= 0.95


def test_neighbours_of_copies_and_awkward_vectors(spark):
    same = [(i, [1.0, 2.0]) for i in range(0, 400)]
    odd = [(1000, None), (1100, [0.0, 0.0]), (1200, [1.0, None]), (1300, [float("nan"), 1.0]), (1400, [float("inf"), 1.0]), (1500, [1.0]), (None, [1.0, 1.0]), (1600, [1.0, 2.5])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in same + odd], "vec_id long, embedding array<float>, score string, rank string")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 1600}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[200] == [(i, 0.0) for i in range(10)]
    assert got[1600] == [(i, 0.5) for i in range(10)]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 100")).count() == 0
    assert [r["vec_id"] for r in ann.nearest(df.where("vec_id in (100, 7)")).collect()] == [7]


# 10 mixing --------------------------------------------------------------------------------------------------------------


def filled_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed, open_ = sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] or sizes[s] == 0}
        if not over:
            return {**fixed, **share}
        fixed |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over
        if not open_:
            return fixed


def test_mix_targets_and_bounds(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a", "b", "c", "d", None] + ["big"] * 5)) for i in range(3000)] + [(9999, "x y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    sizes, source = {}, {i: s for i, _, s in rows}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = filled_targets(sizes), {}
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) < 2
    assert got.equals(mixing.mix(df.repartition(7)).toPandas().set_index("doc_id").loc[got["doc_id"]].reset_index()[got.columns.tolist()])


def test_seats_are_sainte_lague(spark):
    rng = random.Random(8)
    sizes = {f"s{i}": rng.randrange(1, 10**6) for i in range(23)}
    rows = spark.createDataFrame(list(sizes.items()), "skey string, size long")
    plan = mixing.apportion(mixing.source_targets(rows), 276).toPandas()
    block, target = int(plan["block"][0]), dict(zip(plan["skey"], plan["target"], strict=True))
    seats = dict(zip(plan["skey"], plan["seats"], strict=True))
    assert sum(seats.values()) == round(sum(sizes.values()) / block)
    # Highest quotients have won: no seat that was given has a lower one than a seat that wasn't (ties either way).
    assert min(target[s] / (2 * n - 1) for s, n in seats.items() if n) >= max(target[s] / (2 * n + 1) for s, n in seats.items()) * (1 - 1e-12)
    quotas = mixing.shard_quotas(mixing.apportion(mixing.source_targets(rows), 276), 5).toPandas()
    assert quotas.groupby("skey")["quota"].sum().to_dict() == seats
    per = quotas.groupby("shard")["quota"].sum()
    assert per.max() - per.min() <= 1


def test_mix_awkward(spark, awkward, empty):
    got = mixing.mix(awkward).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(awkward.where("text is null or trim(text) = ''")).collect()
    assert all((r["target"], r["taken"], r["size"]) == (0, 0, 0) for r in blank)


# queries against SQL ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([rounded(row[names.index(c)]) for c in sorted(names)]) for row in found.fetchall())
    assert sorted(repr([rounded(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want
