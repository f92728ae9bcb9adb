"""Fuzzy matching, excerpts, browsing, scalar functions, sources, feeds, providers, and the driver contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from findwell.functions import constants as K
from findwell.functions import html as H
from findwell.functions import markdown as MD
from findwell.functions import misc as M
from findwell.operators import browse as B
from findwell.operators import excerpt as E
from findwell.operators import fuzzy as Z
from findwell.operators import index as I
from findwell.plans import catalog, providers
from findwell.sources import files as S
from findwell.streaming import feed as U

NOW = 1000 * K.DAY_MS


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_levenshtein_and_candidates(spark):
    words = spark.createDataFrame([(w, len(w)) for w in ("hello", "help", "world", "held", "helo")], "term string, len int")
    assert [r["term"] for r in Z.fuzzy_candidates(words, "helo", 1).collect()] == ["held", "hello", "help"]
    assert one(spark, Z.bounded_levenshtein(F.lit("kitten"), F.lit("sitting"), 2)) == 3


def test_subsequence(spark):
    def score(q, c):
        return one(spark, Z.subsequence_score(q, F.lit(c)))

    assert score("xyz", "abc") is None and score("", "abc") is None
    assert score("abc", "abc") == pytest.approx(1 + 4 + (1 + 3) * 2 + 16)
    assert score("mn", "my-note") == pytest.approx(5 + 5 - 2 * 0.2)
    assert score("cn", "chatNote") == pytest.approx(5 + 5 - 3 * 0.2)
    assert score("no", "note") > score("no", "a note") > score("no", "anonymous")
    assert [Z.min_score(q) for q in ("a", "ab", "abc", "abcd", "abcdef")] == [12, 8, 5, 4, 4]


def test_actions(spark):
    commands = spark.createDataFrame([("app:delete", "Delete file"), ("trash:show", "Show trash"), ("reload", "Reload")], "id string, name string")
    acts = Z.actions(commands)
    assert {r["id"]: (r["source"], r["destructive"]) for r in acts.collect()} == {"app:delete": ("app", True), "trash:show": ("trash", False), "reload": ("app", False)}
    opened = spark.createDataFrame([("cmd:trash:show", 9, NOW)], "key string, count long, last_opened_ms long")
    assert Z.rank_actions(acts, "e", opened, NOW).first()["id"] != "" and Z.rank_actions(acts, "", opened, NOW).first()["id"] == "trash:show"


def test_excerpt():
    source = "start " + "x " * 100 + "rare word and common thing\nend " + "y " * 100
    text, ranges = E.make_excerpt(source, ["rare", "common"], 60)
    assert [text[a:b] for a, b in ranges] == ["rare", "common"] and text[0] == text[-1] == "…" and "\n" not in text
    assert E.make_excerpt("short text", ["none"]) == ("short text", [])
    assert E.make_excerpt("common x " * 3 + "z " * 200 + "rare", ["rare", "common"], 20, {"rare": 9.0})[1][-1][1] <= 22
    assert E.render_highlight("a<b cat", [(4, 7), (5, 9), (0, 1)]) == "<mark>a</mark>&lt;b <mark>cat</mark>"
    assert E.render_highlight("cat", [(1, 9), (5, 7)]) == "c<mark>at</mark>"
    assert E.title_ranges("My Cat", ["cat"]) == [(3, 6)]


def test_thumbnail_and_preview(spark):
    assert one(spark, E.thumbnail_text(F.lit("a```x\ny```b ![[n]] ![[p.png]]"))) == "ab  ![[p.png]]"
    assert one(spark, E.preview_text(F.lit("---\nk: v\n---\n\n hi"), F.lit("md"))) == "hi"


def test_buckets(spark):
    day = K.DAY_MS
    times = [NOW + 10, NOW - 10, NOW - day - 10, NOW - 8 * day, NOW - 40 * day, NOW + 5 * day]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, mtime_ms long")
    got = [r["bucket"] for r in B.group_by_recency(df, NOW + 3600_000).orderBy("id").collect()]
    assert got == ["Today", "Yesterday", "Past week", "Past 30 days", "Older", "Today"]


def test_dates_captures_settings(spark):
    assert M.match_date_keyword(" Ieri ", 1_784_196_000_000) == ("Yesterday", "2026-07-15") and M.match_date_keyword("tomato", 0) is None
    assert M.append_to_capture("# T", "- x") == f"# T\n\n{M.CAPTURE_HEADING}\n- x\n"
    note = f"a\n\n{M.CAPTURE_HEADING}\n- one\n\n# Next\nz\n"
    assert M.append_to_capture(note, "- two") == f"a\n\n{M.CAPTURE_HEADING}\n- one\n- two\n# Next\nz\n"
    s = M.parse_settings({"httpPort": "8080", "maxResults": 99, "bodyFuzzy": "always", "httpTokenHash": "A" * 64, "maxAttachmentMB": -1, "indexPdf": False})
    assert (s.http_port, s.max_results, s.body_fuzzy, s.http_token_hash, s.max_attachment_mb, s.index_pdf) == (8080, 20, "always", "a" * 64, 20, False)
    assert M.icon_for("PNG", "md") == "image" and M.icon_for("zzz", "none") == "file"


def test_html(spark):
    raw = F.lit("<title> A &amp; B </title><script>x</script><p>caf&#233; &#x41; &lt;b&gt; &copy;</p><!-- no -->")
    assert one(spark, H.html_title(raw)) == "A & B"
    assert one(spark, H.html_text(raw, numeric=True)) == "A & B café A <b> &copy;"
    assert one(spark, H.html_title(F.lit("<p>x</p>"))) is None


def test_markdown_fields(spark):
    notes = [("n.md", "note", "---\nx: 1\n---\n# Top\n## Sub #\ntext #Tag/One", json.dumps({"aliases": ["Al", 3], "tags": "#Zwei", "deep": {"a": [1, "q", None, True]}, "position": "no"}))]
    r = MD.extract_fields(spark.createDataFrame(notes, "path string, basename string, content string, frontmatter string")).first()
    assert (r["h1"], r["h2h3"], r["aliases"], r["tag_list"], r["frontmatter"]) == ("Top", "Sub", "Al", ["tag/one", "zwei"], "1 q true")
    assert r["body"].startswith("# Top")


def test_file_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "My note.md").write_text("# Head\nbody text")
    (tmp_path / "page.html").write_text("<title>Page</title><p>html body</p>")
    (tmp_path / "a.pdf").write_bytes(b"PDFTEXT")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    root = str(tmp_path)
    note = S.markdown_scan(spark, root).first()
    assert (note["path"], note["basename"], note["h1"], note["size"]) == ("sub/My note.md", "My note", "Head", 16)
    assert S.markdown_scan(spark, root, lite=True).first()["body"] == ""
    page = S.html_scan(spark, root).first()
    assert (page["path"], page["basename"], page["name"], page["body"]) == ("page.html", "page", "Page", "Page html body")

    def extract(content):
        if content == b"bad":
            raise ValueError
        return content.decode().lower()

    rows = {r["path"]: r["text"] for r in S.attachment_scan(spark, root, extract).collect()}
    errors = {r["path"]: r["error"] for r in S.attachment_scan(spark, root, extract).collect()}
    assert errors == {"a.pdf": None, "b.pdf": "ValueError"}

    def slow(content):
        import time

        time.sleep(0.8 if content == b"bad" else 0)
        return "x"

    assert {r["path"]: (r["text"], r["error"]) for r in S.attachment_scan(spark, root, slow, timeout_s=0.3).collect()} == {"a.pdf": ("x", None), "b.pdf": (None, "timeout")}
    notes = S.markdown_scan(spark, root)
    assert S.unread(spark, root, notes, "*.md").count() == 0
    assert [r["path"] for r in S.unread(spark, root, notes.where("false"), "*.md").collect()] == ["sub/My note.md"]
    assert rows == {"a.pdf": "pdftext", "b.pdf": None} and S.wanted_extensions(False, True) == K.IMAGE_EXTENSIONS
    files = S.file_catalog(S.listing(spark, root))
    assert {r["ext"] for r in files.collect()} == {"md", "html", "pdf"}
    S.write_frecency(spark.createDataFrame([("k", 1, 2)], "key string, count long, last_opened_ms long"), str(tmp_path / "f"))
    (tmp_path / "f" / "more.json").write_text('{"key": "bad"}\nnot json\n')
    assert [tuple(r) for r in S.frecency_table(spark, str(tmp_path / "f")).collect()] == [("k", 1, 2)]
    S.write_extracted(spark.createDataFrame([("p", "t")], "path string, text string"), str(tmp_path / "x"))
    assert S.extracted_texts(spark, str(tmp_path / "x")).count() == 1


def test_feed(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def events(*rows):
        full = [(s, k, old, p, p, NOW, 1, "md", b) for s, k, old, p, b in rows]
        spark.createDataFrame(full, U.EVENT).coalesce(1).write.mode("append").parquet(source)

    def run():
        U.start(spark.readStream.schema(U.EVENT).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
        return {r["path"]: r["body"] for r in U.current(spark, store).live.collect()}

    events((1, "create", None, "a", "cat"), (2, "modify", None, "a", "cat two"), (3, "create", None, "b", "dog"))
    assert run() == {"a": "cat two", "b": "dog"}
    events((4, "rename", "b", "c", "dog"), (5, "delete", None, "a", None))
    assert run() == {"c": "dog"}
    folded = U.fold_segments(spark, store, str(tmp_path / "index"))
    assert {r["term"]: r["df"] for r in folded.dictionary.collect()} == {"dog": 1} | {r["term"]: 1 for r in folded.dictionary.collect() if r["term"] != "dog"}


def test_save_policy():
    p = U.SavePolicy()
    assert p.due is None and not p.begin(0)
    p.changed(10)
    assert p.due == 70 and not p.begin(69) and p.begin(70) and p.due is None
    p.changed(71)  # during the save
    assert p.due is None and not p.begin(500)
    p.done()
    assert p.due == 131
    for now in range(80, 400, 50):
        p.changed(now)
    assert p.due == 371  # five minutes after the first unsaved change


def test_suggestions():
    day = 1_784_196_000_000
    assert [(r["kind"], r["path"]) for r in M.suggestions(" Ieri ", 0, day, True)] == [("date", "Journal/Daily/15-07-2026.md"), ("create", "Ieri.md"), ("ask", "")]
    assert [r["kind"] for r in M.suggestions("plan", 2, day)] == ["create"] and M.suggestions("plan", 3, day) == [] and M.suggestions(" ", 0, day, True) == []


def test_since_is_local(spark):
    from findwell.operators.filters import since

    noon = 1_706_702_400_000
    assert since("today", noon, "UTC") == since("today", noon) == noon - 12 * 3600_000
    assert since("today", noon, "Asia/Tokyo") == noon - 21 * 3600_000 and since("week", noon) == noon - 7 * K.DAY_MS


def test_excerpts_agree_with_trying_every_anchor():
    """Best window by trying all of them, on random texts."""
    import random

    rng = random.Random(9)
    for _ in range(300):
        source = " ".join(rng.choice(["aa", "bbb", "cc", "zzzzzzz", "y", "x\ty"]) for _ in range(rng.randrange(1, 60)))
        most, weights = rng.randrange(8, 60), {"aa": rng.choice([1.0, 2.5]), "bbb": 0.7, "cc": 1.0}
        hits = [t for t in E.tokenize(source) if t.text in weights]
        text, ranges = E.make_excerpt(source, list(weights), most, weights)
        assert all(text[a:b] in weights for a, b in ranges) and "\t" not in text
        if not hits:
            assert text == source[:most].replace("\t", " ") + ("…" if len(source) > most else "") and not ranges
            continue
        best, lo, hi = max(((round(sum(weights[w] for w in {h.text for h in hits[i:] if h.end - a.start <= most}), 9), -i), a.start, max(h.end for h in hits[i:] if h.end - a.start <= most)) for i, a in enumerate(hits))
        plain = text.removeprefix("…").removesuffix("…")
        begin = source.replace("\t", " ").find(plain, max(0, lo - most))
        assert round(sum(weights[w] for w in {text[a:b] for a, b in ranges}), 9) >= best[0] and begin <= lo and begin + len(plain) >= hi and len(plain) <= most
        assert (begin == 0 or source[begin - 1].isspace() or begin == lo) and (begin + len(plain) == len(source) or source[begin + len(plain)].isspace() or begin + len(plain) == hi)


def test_opens_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "path string, ts_ms long").write.parquet(source)
    U.start_opens(spark.readStream.schema("path string, ts_ms long").parquet(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in U.read_opens(spark, str(tmp_path / "out")).collect()} == {("a", 2, 9), ("b", 1, 1)}


def test_providers_and_endpoint(spark):
    docs = [(0, "Atlas/mango tree.md", "mango tree", "a mango is tasty", NOW), (1, "b.md", "b", "nothing", NOW)]
    index = I.build_index(spark.createDataFrame(docs, "doc_id long, path string, basename string, body string, mtime_ms long"))
    files = S.file_catalog(index.docs.select("path", "mtime_ms").unionByName(spark.createDataFrame([("mango.canvas", NOW)], "path string, mtime_ms long")))

    class Broken:
        name, weight, deep = "broken", 1.0, False

        def search(self, raw, limit):
            raise RuntimeError("no")

    seen = []
    registry = providers.ProviderRegistry(providers.KeywordProvider(index, NOW), Broken(), providers.FileProvider(files), on_error=lambda n, e: seen.append(n))
    rows = registry.fused("mango").collect()
    assert [(r["path"], r["source"]) for r in rows] == [("Atlas/mango tree.md", "keyword"), ("mango.canvas", "file")] and seen == ["broken"]
    slow = providers.FileProvider(files)
    slow.name, slow.deep = "deep", True
    waves = [[r["source"] for r in w.collect()] for w in providers.ProviderRegistry(providers.KeywordProvider(index, NOW), slow).waves("mango")]
    assert waves == [["keyword"], ["keyword", "deep"]] and len(list(registry.waves("mango"))) == 1
    import hashlib

    end = providers.SearchEndpoint(index, hashlib.sha256(b"t").hexdigest(), lambda: NOW)
    ask = lambda path="/search", host="127.0.0.1:1", auth="Bearer t", method="GET", **p: end.handle(method, path, p, host, auth)
    assert [ask(host="evil.com")[0], ask(auth=None)[0], ask(auth="Bearer x")[0], ask(method="POST")[0], ask(path="/x")[0]] == [403, 401, 401, 405, 404]
    assert ask(q=" ") == (200, "[]") and json.loads(ask("/health")[1])["docs"] == 2
    (hit,) = json.loads(ask(q="tasty ")[1])
    assert (hit["path"], hit["ext"], hit["foundWords"], hit["matches"]) == ("Atlas/mango tree.md", "md", ["tasty"], [{"match": "tasty", "offset": 11}])
    assert [providers.http_limit(x) for x in (None, "7", "1000", "-1", "x")] == [50, 7, 100, 50, 50]


QUICK = ["exact_fold_postings", "exact_fold_search", "note_fields", "note_previews", "excerpt_windows", "settled_backlog", "fused_providers", "action_ranking", "date_presets", "build_order", "search_sparse", "fold_words", "tokenize_cases", "html_titles", "html_texts", "recency_boost", "coverage_boost", "frecency_state", "rrf_weighted", "subsequence_match", "catalog_search", "recent_docs", "recency_buckets", "file_types", "type_filter", "date_keyword", "capture_lines", "destructive_flag", "last_event", "postings", "phrase_match", "prefix_tier"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_agree_with_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "part", "customer", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, folder)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", ["html_titles", "html_index_lengths"])
def test_page_queries_agree_on_entities(spark, tmp_path, name):
    """Entities in titles, and pages without a title, as the SQL has them; the operator itself decodes all named ones."""
    pages = [(1, "http://a/b", "<title>token = &quot;x1 &amp; yy</title><p>&quot;body&quot; text</p>"), (2, "http://c/long-name", "<p>no title &lt;here&gt;</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, found.fetchall()))
    assert one(spark, H.html_title(F.lit(pages[0][2]))) == 'token = "x1 & yy'


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["rank", "doc_id", "path", "basename", "score"]


def test_written_tables(spark, tmp_path):
    """Only what materialize() wrote is deleted, and a cluster needs a shared folder."""
    from types import SimpleNamespace

    from findwell.sources import stored

    own = stored.materialize(spark.range(3), "x")
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in own.inputFiles()}
    other = str(tmp_path / "other")
    spark.range(2).write.parquet(other)
    import os

    assert own.count() == 3 and os.path.isdir(folder.replace("//", "/"))
    stored.release(own.where("id > 0").unionByName(spark.read.parquet(other)))
    assert not os.path.exists(folder.replace("//", "/")) and spark.read.parquet(other).count() == 2
    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError):
        stored.shared_dir(far)
