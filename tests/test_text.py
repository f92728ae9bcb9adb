"""Folding, tokenizing and parsing, on the driver and as Columns."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findwell.functions import text as T
from findwell.plans.parser import clauses, parse_mode, parse_query


def positions(text):
    return [(t.text, t.pos) for t in T.tokenize(text)]


def test_fold():
    assert [T.fold_text(x) for x in ("perché", "Naïve", "ﬁne", "½")] == ["perche", "naive", "fine", "1⁄2"]


def test_camel_case_gives_segments_and_a_compound():
    assert positions("the ChatGPT model") == [("the", 0), ("chat", 1), ("gpt", 2), ("chatgpt", 1), ("model", 3)]
    assert positions("HTTPServer") == [("http", 0), ("server", 1), ("httpserver", 0)]


def test_short_tokens_are_dropped_but_count():
    assert positions("l'amico e io") == [("amico", 1), ("io", 3)]


def test_digits_underscores_and_schemes():
    assert positions("utf8 ES2021") == [("utf8", 0), ("es2021", 1)]
    assert [t for t, _ in positions("snake_case")] == ["snake", "case"]
    assert [t for t, _ in positions("https://a.example.com")] == ["example", "com"]


def test_offsets_point_at_the_source():
    source = "see HTTPS://Perché-no"
    assert [source[t.start : t.end] for t in T.tokenize(source)] == ["see", "Perché", "no"]


def test_columns_agree_with_python(spark):
    texts = ["the ChatGPT model", "HTTPServer v2", "l'amico perché no", "a b", "", "café x", "https://Foo.bar HTTP://x1", "ÀÉÎ Straße SSöer", "𝒳 𝒳y 日本語"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: [(x["term"], x["pos"]) for x in r["tokens"]] for r in rows.select("id", T.tokens(F.col("t")).alias("tokens")).collect()}
    plain = {i: positions(t) for i, t in enumerate(texts) if "𝒳" not in t}
    assert {i: sorted(got[i]) for i in plain} == {i: sorted(v) for i, v in plain.items()}
    flat = T.token_rows(rows, "id", {6: F.col("t")}).collect()
    assert sorted((r["id"], r["term"], r["pos"]) for r in flat) == sorted((i, t, p) for i, v in got.items() for t, p in v)


def test_fold_is_exact_for_every_character(spark):
    """Characters that decompose to several (ligatures, fractions, Hangul, astral letters) and marks, as on the driver."""
    texts = ["ﬁne", "plain", "½", "한국어", "𝒳y", "①②", "ŉ", "Å\u0301", "İI", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.fold(F.col("t"))).collect()] == [t and T.fold_text(t) for t in texts]


def test_places_agree_with_tokens():
    for text in ["the ChatGPT model HTTPServer v2", "https://Foo.barBaz HTTP://x1 ab://cd", "한국어 ﬁne ÀÉÎ Straße 𝒳 𝒳y 日本語 a_b", "aB aB aB", ""]:
        assert sorted((t, p) for t, places in T.term_places(text).items() for p in places) == sorted(positions(text))


def test_ids_lose_no_rows(spark):
    """Wide rows over many partitions, which adaptive execution coalesces in different ways; counted both ways."""
    from findwell.operators import index as I

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = spark.range(6000).select(F.col("id").alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 40).alias("body"), F.concat(F.lit("p"), F.sha2(F.col("id").cast("string"), 256)).alias("path"))
        got = I.assign_ids(rows.repartition(9), F.col("path"))
        assert got.agg(F.count("*"), F.countDistinct("key"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()[:] == (6000, 6000, 6000, 0, 5999)
        assert [r["path"] for r in got.orderBy("doc_id").select("path").collect()] == sorted(r["path"] for r in rows.select("path").collect())
        assert I.assign_ids(rows.limit(0), F.col("path")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_tokenize_never_fails_and_offsets_ascend(text):
    found = T.tokenize(text)
    assert all(0 <= t.start < t.end <= len(text) and t.pos >= 0 for t in found)


def test_parser_flags():
    assert parse_query("foo bar").terms == {"foo": False, "bar": True}
    assert parse_query("foo bar ").terms == {"foo": False, "bar": False}
    assert parse_query("chatGpt").terms == {"chat": True, "gpt": True, "chatgpt": True}
    assert parse_query("foo foo").terms == {"foo": True}


def test_parser_phrases_and_operators():
    q = parse_query('"machine learning" -draft-x path:Atlas tag:#Career/Job "open end')
    assert q.phrases == [["machine", "learning"], ["open", "end"]]
    assert (q.exclusions, q.path_filters, q.tag_filters, q.terms) == (["draft"], ["atlas"], ["career/job"], {})
    assert q.exact == ["machine", "learning", "open", "end"]


def test_quotes_end_operators():
    q = parse_query('-"foo bar" path:"a b"')
    assert q.exclusions == [] and q.path_filters == [] and q.phrases == [["foo", "bar"]]
    assert clauses('a"b c"d') == [("word", "a", False), ("phrase", "b c", False), ("word", "d", True)]


def test_modes():
    assert parse_mode(">  reload") == ("command", "reload")
    assert parse_mode("+x") == ("capture", "x") and parse_mode("?why") == ("intent", "why")
    assert parse_mode(" >x") == ("search", " >x")
