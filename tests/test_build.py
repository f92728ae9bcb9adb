"""How an index is built at size: what is dealt out, how often texts are tokenized, what Python holds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from findwell.functions import text as T
from findwell.functions import workers as W
from findwell.operators import excerpt as E
from findwell.operators import index as I
from findwell.operators import rank as R
from findwell.plans import catalog, catalog_parts
from findwell.streaming import feed as U

TEXTS = ["the cat camelCase sat", "the the HTTPServer", None, "été 한국어 the cat"]
ROWS = [(i, f"{i}.md", f"t{i % 3}", TEXTS[i % 4]) for i in range(600)]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, path string, basename string, body string").coalesce(2)


def expected() -> list[tuple]:
    out = []
    for i, _, title, body in ROWS:
        own, said = T.term_places(title), T.term_places(body or "")
        out += [(t, i, len(own.get(t, ())), len(said.get(t, ())), said.get(t, [])) for t in {*own, *said}]
    return sorted(out)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_build_deals_out_runs(spark, tmp_path, monkeypatch):
    """many postings travel in one row, bodies are not sorted, and the saved relations are whole."""
    tables, put = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, label: tables.append(put(df, label)) or tables[-1])
    monkeypatch.setattr(I, "release", lambda table: None)
    I.build_and_save(docs(spark), str(tmp_path / "x"))
    index = I.load(spark, str(tmp_path / "x"))
    got = [(r["term"], r["doc_id"], r["tf_0"], r["tf_6"], r["positions"]) for r in index.postings.collect()]
    assert sorted(got) == expected()
    assert sum(t.where("term is not null").count() for t in tables) * 5 < len(got)
    lengths = {r["doc_id"]: (r["len_0"], r["len_6"]) for r in index.docs.collect()}
    assert len(lengths) == 600 and lengths[2] == (len(T.term_list("t2")), 0) and lengths[0][1] == len(T.term_list(TEXTS[0]))
    assert {r["term"]: r["df"] for r in index.dictionary.collect()}["the"] == 450


def test_runs_keep_every_posting():
    """Null, negative, repeated and far ids, and blocks and batches of any size."""
    ids = [None, -5, 10**12, 7, 7, 0, 3, None]
    part = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([TEXTS[i % 4] for i in range(8)])], ["doc_id", "__6"])
    want = sorted(repr((t, d, list(p))) for i, d in enumerate(ids) for t, p in T.term_places(TEXTS[i % 4] or "").items())
    for rows in (1, 9, 1000):
        for out in (1, 5, 1000):
            found = [r for b in I._unpacked([6], out)(I._packed([6], rows)(iter([part.slice(0, 3), part.slice(3)]))) for r in b.to_pylist()]
            assert sorted(repr((r["term"], r["doc_id"], r["positions"])) for r in found) == want
            assert all(r["tf_6"] == len(r["positions"]) and r["tf_0"] == 0 for r in found)
    numbers = np.array([0, 127, 128, 2**32, 2**63], np.uint64)
    assert (I._numbers(I._blobs(numbers, np.array([0, 2, 2, 5]))) == numbers).all()


def test_packing_holds_one_text_at_a_time():
    """F6, F8: a batch of Arrow is not turned into Python texts as a whole."""
    text = "word other " * 20_000
    part = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([text] * 100)], ["doc_id", "__6"])
    tracemalloc.start()
    n = sum(b.num_rows for b in I._packed([6], 20_000)(iter([part])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100 and peak < 14_000_000  # the batch's texts are 22 MB


def test_block_holds_numbers():
    """F6, F8: a posting waits as a few plain numbers, not as a list of its own."""
    texts = [" ".join(f"w{(i * 7 + k * 13) % 5000}" for k in range(2000)) for i in range(120)]
    part = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(texts)], ["doc_id", "__6"])
    list(I._packed([6])(iter([part.slice(0, 5)])))  # words are known
    tracemalloc.start()
    packed = I._packed([6], 1 << 30)(iter([part]))
    n = sum(sum(x or 0 for x in b.column(2).to_pylist()) for b in packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 240_000 and peak < 50_000_000


def test_texts_come_in_short_batches(spark, tmp_path, monkeypatch):
    """F6, F8: while texts are packed, a batch has some hundred of them; the session's own setting is there again afterwards."""
    seen, put, before = [], I.materialize, spark.conf.get(W.BATCH_ROWS)
    monkeypatch.setattr(I, "materialize", lambda df, label: seen.append((label, int(spark.conf.get(W.BATCH_ROWS)))) or put(df, label))
    I.build_and_save(docs(spark), str(tmp_path / "x"))
    assert seen == [("runs", W.TEXTS)] and spark.conf.get(W.BATCH_ROWS) == before


def test_search_of_type_uses_the_saved_index(spark, monkeypatch):
    """the corpus is indexed once for all queries, and a type is not part of it."""
    monkeypatch.setattr(I, "build_index", None)
    saved = catalog.index(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(I, "build_and_save", None)
    got = [r["doc_id"] for r in catalog_parts.search_of_type(spark, "/root/testdata/sf0.001").collect()]
    assert got and all(i % 4 == 1 for i in got) and saved.docs.where("doc_type <> 'md'").count() == 0


def test_index_is_tokenized_once(spark):
    """a built index is read back, so no use of it cuts the texts again."""
    index = I.build_index(docs(spark))
    assert all("MapInArrow" not in plan(x) for x in (index.docs, index.postings, index.dictionary, index.stats))
    assert index.postings.count() == len(expected())


def test_second_phase_reads_asked_terms_only(spark):
    """positions of other terms are dropped before the join with the best documents."""
    index = I.build_index(docs(spark))
    groups = spark.createDataFrame([(0, 0, 1.0, "the", 0), (0, 1, 1.0, "cat", 0)], R.GROUPS)
    found = R.rank(index, groups, R.RankOptions(0, 1000, rescore_top=1000))
    assert "LeftSemi" in plan(found)
    best = found.first()
    assert found.count() == 450 and best["rank"] == 1 and best["score"] >= best["first_score"]


def test_heads_need_no_python(spark, monkeypatch):
    """without a word to find nothing is tokenized, and the head is cut by code points."""
    rows = [(1, "a\r\nb\t" + "😀" * 300, []), (2, "x" * 10, None), (3, "", []), (4, None, []), (5, "some needle here", ["needle"])]
    got = {r["id"]: r["excerpt"] for r in E.with_excerpts(spark.createDataFrame(rows, "id int, body string, matched array<string>"), max_chars=20).collect()}
    assert (got[1]["text"], got[1]["ranges"]) == ("a  b " + "😀" * 15 + "…", []) and got[2]["text"] == "x" * 10 and got[3] is None and got[4] is None
    assert [(r["start"], r["end"]) for r in got[5]["ranges"]] == [(5, 11)]
    monkeypatch.setattr(E, "tokenize", None)
    assert E.make_excerpt("a\tb", []) == ("a b", [])


def test_segment_is_tokenized_once(spark, tmp_path, monkeypatch):
    """a segment's two relations come from one table of runs."""
    labels, put = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, label: labels.append(label) or put(df, label))
    events = docs(spark).selectExpr("doc_id as seq", "'create' as kind", "null as old_path", "path", "basename", "0L as mtime_ms", "1L as size", "'md' as doc_type", "body")
    U.write_segment(events, 0, str(tmp_path / "s"))
    assert labels == ["ordered", "runs"]
    now = U.current(spark, str(tmp_path / "s"))
    assert now.live.count() == 600 and now.postings.count() == len(expected())
