"""Index, ranking and search over tiny corpora, with a plain model as a second opinion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from findwell.functions import constants as K
from findwell.functions import text as T
from findwell.operators import index as I
from findwell.operators import rank as R
from findwell.operators.fuse import apply_frecency, ordered, reciprocal_rank_fusion
from findwell.plans.search import excerpt_weights, search, search_many

NOW = 1000 * K.DAY_MS
SCHEMA = "doc_id long, path string, basename string, body string, tag_list array<string>, mtime_ms long"


def corpus(spark, *docs):
    rows = [(i, d["path"], d.get("basename", ""), d.get("body", ""), d.get("tags", []), d.get("mtime", NOW)) for i, d in enumerate(docs)]
    return I.build_index(spark.createDataFrame(rows, SCHEMA).withColumn("tags", F.array_join("tag_list", " ")))


def paths(spark, index, raw, **options):
    return [r["path"] for r in search(index, raw, NOW, **options).collect()]


@pytest.fixture(scope="module")
def notes(spark):
    index = corpus(
        spark,
        {"path": "exact.md", "body": "cat"}, {"path": "prefix.md", "body": "catalog of items"}, {"path": "fuzzy.md", "body": "a cot in the room"},
        {"path": "Atlas/a.md", "body": "report draft", "tags": ["career/job"], "mtime": NOW - 100 * K.DAY_MS}, {"path": "Journal/b.md", "body": "report final"},
        {"path": "adj.md", "body": "the machine learning course"}, {"path": "scattered.md", "body": "learning how a machine works"}, {"path": "title.md", "basename": "mango", "body": "x"},
        {"path": "body.md", "body": "mango is tasty here"}, {"path": "note.md", "body": "la ragione del perché conta"},
    )
    return I.Index(index.docs.cache(), index.postings.cache(), index.dictionary.cache(), index.stats.cache())


def test_tiers_rank_exact_prefix_fuzzy(spark, notes):
    assert paths(spark, notes, "cat") == ["exact.md", "prefix.md", "fuzzy.md"]
    assert paths(spark, notes, "cat ", fuzzy="off") == ["exact.md"]


def test_filters(spark, notes):
    assert paths(spark, notes, "report tag:career ", fuzzy="off") == ["Atlas/a.md"]
    assert paths(spark, notes, "report path:atlas ", fuzzy="off") == ["Atlas/a.md"]
    assert paths(spark, notes, "report -draft ", fuzzy="off") == ["Journal/b.md"]
    assert paths(spark, notes, "report ", fuzzy="off", min_mtime=NOW - 7 * K.DAY_MS) == ["Journal/b.md"]
    assert paths(spark, notes, "report ", fuzzy="off", tag_filters=["career"], path_filters=["journal"]) == []


def test_phrase_title_and_folding(spark, notes):
    assert paths(spark, notes, '"machine learning"', fuzzy="off")[0] == "adj.md"
    assert paths(spark, notes, "mango ", fuzzy="off", title_only=True) == ["title.md"]
    assert paths(spark, notes, "perche ", fuzzy="off") == ["note.md"]


def test_words_that_decompose_are_found(spark):
    """Index and queries fold alike: Hangul, ligatures, fractions, letters beyond the basic plane."""
    index = corpus(spark, {"path": "k.md", "body": "나는 한국어 공부"}, {"path": "f.md", "body": "a \ufb01ne day"}, {"path": "h.md", "body": "½x cup"}, {"path": "a.md", "body": "𝒳𝒴 letters"})
    for raw, path in (("한국어 ", "k.md"), ("fine ", "f.md"), ("\ufb01ne ", "f.md"), ("½x ", "h.md"), ("XY ", "a.md"), ("한", "k.md")):
        assert paths(spark, index, raw, fuzzy="off") == [path], raw


def test_blank_and_filter_only(spark, notes):
    assert paths(spark, notes, "   ") == [] and paths(spark, notes, "tag:career") == []


def test_many_queries_equal_single_ones(spark, notes):
    raws = {1: "cat", 2: "report -draft ", 3: '"machine learning"', 4: "zzz"}
    rows = search_many(notes, raws, NOW).collect()
    for q, raw in raws.items():
        assert [r["path"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == paths(spark, notes, raw)


def test_golden_scores(spark):
    index = corpus(spark, {"path": "body.md", "body": "mango is tasty here"}, {"path": "title.md", "basename": "mango"})
    rows = {r["path"]: r["score"] for r in search(index, "mango ", NOW, fuzzy="off").collect()}
    assert rows == pytest.approx({"title.md": 0.1906089003, "body.md": 0.0676354162}, abs=1e-9)
    assert excerpt_weights(index, ["mango", "none"]) == pytest.approx({"mango": math.log(3 / 2.5), "none": math.log(3 / 0.5)})


def test_windows_and_phrases(spark):
    cases = [([[0, 9], [3], [5]], 5, False), ([[4], [5]], 1, True), ([[4]], 0, True), ([[1, 7], [8], [9]], 2, True), ([[2], [1]], 1, False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, lists array<array<int>>")
    got = {r["id"]: (r["w"], r["a"]) for r in df.select("id", R.min_window(F.col("lists")).alias("w"), R.adjacent(F.col("lists")).alias("a")).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def model(docs, terms):
    """BM25F over basename and body, term by term, with coverage, recency and proximity."""
    tokens = [{0: T.tokenize(d["basename"]), 6: T.tokenize(d["body"])} for d in docs]
    n, avg = len(docs), sum(len(t[6]) for t in tokens) / len(docs)
    out = {}
    for d, t in enumerate(tokens):
        base, found, places = 0.0, 0, []
        for term in terms:
            df = sum(any(x.text == term for f in u.values() for x in f) for u in tokens)
            tf = {f: sum(x.text == term for x in t[f]) for f in t}
            norm = 12 * tf[0] + tf[6] / (0.25 + 0.75 * (len(t[6]) / avg if avg else 1))
            if norm:
                base += math.log((n + 1) / (df + 0.5)) * norm / (1.2 + norm)
                found += 1
                if tf[6]:
                    places.append([x.pos for x in t[6] if x.text == term])
        if not found:
            continue
        score = base * (1 + 0.15 * (found - 1)) * (1 + 0.15 * math.exp(-(NOW - docs[d]["mtime"]) / K.DAY_MS / 90))
        if len(places) > 1:
            spans = [max(c) - min(c) for c in __import__("itertools").product(*places)]
            if min(spans) <= 8:
                score *= 1 + 0.1 * (1 - min(spans) / 8)
        out[d] = score
    return out


def test_random_corpora_agree_with_the_model(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "chatGpt", "é"]
    docs = [{"path": f"{i}.md", "basename": rng.choice(vocabulary), "body": " ".join(rng.choices(vocabulary, k=rng.randint(0, 25))), "mtime": NOW - rng.randint(0, 300) * K.DAY_MS} for i in range(40)]
    index = corpus(spark, *docs)
    got = {r["doc_id"]: r["score"] for r in search(index, "alpha beta gpt ", NOW, fuzzy="off", limit=100).collect()}
    assert got == pytest.approx(model(docs, ["alpha", "beta", "gpt"]), abs=1e-9)


def test_maintenance(spark):
    index = corpus(spark, {"path": "a.md", "body": "cat apple"}, {"path": "b.md", "body": "cat"}, {"path": "c.md", "body": "cat dog"})
    gone = I.tombstone(index, spark.createDataFrame([("a.md",)], "path string"))
    df = {r["term"]: r["df"] for r in gone.dictionary.collect()}
    assert df["cat"] == 3 and gone.stats.first()["n"] == 2
    assert sorted(paths(spark, gone, "cat ", fuzzy="off")) == ["b.md", "c.md"]
    dense = I.compact(gone)
    assert {r["term"]: r["df"] for r in dense.dictionary.collect()} == {"cat": 2, "dog": 1}
    assert sorted((r["path"], r["doc_id"]) for r in dense.docs.collect()) == [("b.md", 0), ("c.md", 1)]
    changed = I.upsert(index, spark.createDataFrame([(0, "b.md", "", "bird", [], NOW)], SCHEMA).withColumn("tags", F.lit("")))
    assert paths(spark, changed, "bird ", fuzzy="off") == ["b.md"] and sorted(paths(spark, changed, "cat ", fuzzy="off")) == ["a.md", "c.md"]
    assert not I.needs_compaction(changed) and I.status(changed)["tombstones"] == 1


def test_prefix_order_and_cap(spark):
    index = corpus(spark, {"path": "1", "body": "car card cat"}, {"path": "2", "body": "car card"}, {"path": "3", "body": "car"})
    assert [r["term"] for r in I.prefix_terms(index.dictionary, "ca", 2).collect()] == ["car", "card"]


def test_save_and_load(spark, tmp_path):
    index = corpus(spark, {"path": "a.md", "body": "cat apple"}, {"path": "b.md", "body": "catalog"})
    I.save(index, str(tmp_path / "x"))
    again = I.load(spark, str(tmp_path / "x"))
    assert paths(spark, again, "cat", fuzzy="off") == paths(spark, index, "cat", fuzzy="off") == ["a.md", "b.md"]
    plan = again.postings.where(F.col("term").isin(["cat", "dog"]))._jdf.queryExecution().toString()
    assert "In(term" in plan
    assert I.load(spark, str(tmp_path / "missing")) is None
    spark.createDataFrame([('{"schema": 0, "tokenizer": 1}',)], "value string").write.mode("overwrite").text(str(tmp_path / "x" / "meta"))
    assert I.load(spark, str(tmp_path / "x")) is None
    I.build_and_save(spark.createDataFrame([(0, "a.md", "", "cat apple", [], NOW)], SCHEMA), str(tmp_path / "y"))
    assert paths(spark, I.load(spark, str(tmp_path / "y")), "apple ", fuzzy="off") == ["a.md"]


def test_staleness(spark):
    index = corpus(spark, {"path": "a.md"}, {"path": "b.md"}, {"path": "c.md"})
    listing = spark.createDataFrame([("a.md", NOW, 0), ("b.md", NOW + 5, 0), ("n.md", NOW + 1, 0)], "path string, mtime_ms long, size long")
    assert [r["path"] for r in I.stale(listing, index).collect()] == ["b.md", "n.md"]
    assert [r["path"] for r in I.removed(listing, index).collect()] == ["c.md"]


def test_fusion_and_frecency(spark):
    a = spark.createDataFrame([("x", 0, "kw"), ("y", 1, "kw")], "path string, rank int, source string")
    b = spark.createDataFrame([("y", 0, "file"), ("z", 1, "file")], "path string, rank int, source string")
    rows = ordered(reciprocal_rank_fusion([a, b])).collect()
    assert [(r["path"], r["source"]) for r in rows] == [("y", "kw"), ("x", "kw"), ("z", "file")]
    assert rows[0]["score"] == pytest.approx(1 / 60 + 1 / 61)
    opened = spark.createDataFrame([("y", 15, NOW)], "key string, count long, last_opened_ms long")
    scores = {r["path"]: r["score"] for r in apply_frecency(spark.createDataFrame([("x", 1.0), ("y", 1.0)], "path string, score double"), opened, NOW).collect()}
    assert scores == pytest.approx({"x": 1.0, "y": 1.2839225791})
