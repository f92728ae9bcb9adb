"""More queries of the engine with their SQL: the default search as users get it, notes, excerpts, maintenance, caches,
providers, browsing and feeds."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import markdown as MD
from ..functions import misc as M
from ..functions import text as T
from ..functions.html import decode_entities
from ..operators import browse as B
from ..operators import excerpt as E
from ..operators import filters as P
from ..operators import fuzzy as Z
from ..operators import index as I
from ..sources import files as S
from ..sources.stored import new_path
from ..streaming import feed as U
from . import catalog as C
from .catalog import D, INDEX, NOW_MS, query, table
from .providers import FileProvider, ProviderRegistry, http_rows
from .search import search, search_many, search_typed, with_weights

# --- the default search --------------------------------------------------------------------------


def default_sql(groups: str, limit: int = K.DEFAULT_LIMIT, where: str = "true", phrases: dict[int, list[str]] | None = None) -> str:
    """CTEs up to r(query_id, doc_id, score, rank): the first hundred by first score are rescored by proximity and
    phrases, and the limit cuts them. phrases: one for each query."""
    at = lambda q, i, t: f"(SELECT query_id, doc_id, unnest(positions) - {i} AS x FROM pos WHERE query_id = {q} AND term = '{t}') t{i}"
    hits = [f"SELECT query_id, doc_id FROM {at(q, 0, w[0])} " + " ".join(f"JOIN {at(q, i, t)} USING (query_id, doc_id, x)" for i, t in enumerate(w[1:], 1)) for q, w in (phrases or {}).items()]
    said = " UNION ".join(hits) or "SELECT query_id, doc_id FROM pos WHERE false"
    return f"""{C.ranked_sql(groups, where=where)},
won AS (SELECT query_id, doc_id, min(group_id * 100000 + variant_rank) AS first_won FROM best GROUP BY query_id, doc_id),
placed AS (SELECT query_id, doc_id, first_score, row_number() OVER (PARTITION BY query_id ORDER BY round(first_score, 10) DESC, first_won, doc_id) AS place
  FROM s JOIN won USING (query_id, doc_id) QUALIFY place <= {max(limit, K.RESCORE_TOP)}),
pos AS (SELECT DISTINCT query_id, doc_id, term, positions FROM best JOIN placed USING (query_id, doc_id) WHERE positions IS NOT NULL),
many AS (SELECT query_id, doc_id, list(positions) AS lists, max(list_min(positions)) AS latest FROM pos GROUP BY query_id, doc_id HAVING count(*) >= 2),
ends AS (SELECT query_id, doc_id, lists, unnest(flatten(lists)) AS e, latest FROM many),
win AS (SELECT query_id, doc_id, min(e - list_min(list_transform(lists, lambda l: list_max(list_filter(l, lambda x: x <= e))))) AS w FROM ends WHERE e >= latest GROUP BY query_id, doc_id),
said AS ({said}),
rescored AS (SELECT query_id, doc_id, place, first_score * CASE WHEN place <= {K.RESCORE_TOP} AND w <= {K.PROXIMITY_WINDOW} THEN 1 + {K.PROXIMITY_MAX} * (1 - w / {K.PROXIMITY_WINDOW}.0) ELSE 1 END
  * CASE WHEN place <= {K.RESCORE_TOP} AND (query_id, doc_id) IN (SELECT DISTINCT query_id, doc_id FROM said) THEN 1 + {K.PHRASE_BONUS} ELSE 1 END AS score FROM placed p LEFT JOIN win USING (query_id, doc_id)),
r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, place) AS INTEGER) AS rank FROM rescored QUALIFY rank <= {limit})"""


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def near_groups(q: int, group: int, target: str) -> str:
    """Group rows of the fuzzy tier."""
    return f"SELECT {q}, {group}, {K.FUZZY_WEIGHT}, term, row_number() OVER (ORDER BY dist, term) FROM ({C.near_sql(target)})"


SHOWN = "SELECT CAST(query_id AS BIGINT) AS query_id, rank, doc_id, round(score, 6) AS score FROM r"
THREE = f"{C.exact_groups_sql((0, ['with', 'from', 'that']))}"


@query(f"WITH {default_sql(THREE)} {SHOWN}")
def search_top(spark, sf_dir):
    """The twenty best, with the cut at a hundred and its order of ties."""
    return _ranked(search_many(C.index(spark, sf_dir), {0: "with from that "}, NOW_MS))


@query(f"WITH {default_sql(C.exact_groups_sql((0, ['the'])), limit=130)} {SHOWN}")
def search_beyond_rescoring(spark, sf_dir):
    return _ranked(search_many(C.index(spark, sf_dir), {0: "the "}, NOW_MS, limit=130))


@query(f"WITH {default_sql(C.exact_groups_sql((0, ['thinthhq'])) + ' UNION ALL ' + near_groups(0, 1, 'thinthhq'))} {SHOWN}")
def search_sparse(spark, sf_dir):
    """A word that no document has: similar terms take over, with their scores."""
    return _ranked(search_many(C.index(spark, sf_dir), {0: "thinthhq "}, NOW_MS))


DEFAULTS = f"""{C.exact_groups_sql((0, ['with', 'the', 'thin']), (2, ['of', 'the']))} UNION ALL {C.prefix_groups_sql(3, 'thin')}
 UNION ALL {near_groups(1, 2, 'thinthhx')}"""
ONLY_2 = "(g.query_id <> 2 OR (doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'with') AND len(list_filter(tags, lambda t: starts_with(t, 'en'))) > 0))"


@query(f"WITH {default_sql(DEFAULTS, where=ONLY_2, phrases={2: ['of', 'the']})} SELECT CAST(query_id AS BIGINT) AS query_id, rank, doc_id, path, round(score, 6) AS score FROM r JOIN d USING (doc_id)")
def search_defaults(spark, sf_dir):
    """Interactive settings: top 20, prefix of the word being typed, similar terms where results are sparse."""
    found = search_many(C.index(spark, sf_dir), {0: "with the thin", 1: "thinthhx", 2: '"of the" -with tag:en'}, NOW_MS)
    return found.select("query_id", "rank", "doc_id", "path", F.round("score", 6).alias("score"))


KINDS = ("md", "pdf", "html", "image")


@query(f"WITH {default_sql(THREE, limit=K.DEFAULT_LIMIT * K.OVERFETCH)} SELECT doc_id, rank, round(score, 6) AS score FROM r WHERE doc_id % 4 = 1 ORDER BY rank LIMIT {K.DEFAULT_LIMIT}")
def search_of_type(spark, sf_dir):
    """A type filter after six times the limit was fetched. Types are no terms, so the saved index of the corpus serves with them in place of its own."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    saved = C.index(spark, sf_dir)
    index = replace(saved, docs=saved.docs.withColumn("doc_type", kinds))
    return search_typed(index, "with from that ", NOW_MS, "pdf", fuzzy="off").select("doc_id", "rank", F.round("score", 6).alias("score"))


CHIPS = f"path LIKE '%src1%' AND path LIKE '%/%' AND len(list_filter(tags, lambda t: starts_with(t, 'en'))) > 0 AND mtime_ms >= {NOW_MS - 365 * K.DAY_MS}"


@query(f"WITH {C.ranked_sql(C.exact_groups_sql((0, ['the'])), where=CHIPS)} SELECT {C.SCORES}")
def chip_filters(spark, sf_dir):
    """Filters that are typed and filters of the caller hold together."""
    return C.scores(spark, sf_dir, "the path:/ ", path_filters=["src1"], tag_filters=["en"], min_mtime=P.since("year", NOW_MS))


@query(f"WITH {default_sql(THREE)} SELECT doc_id, term, round(ln((n + 1) / (df + 0.5)), 6) AS weight FROM r JOIN (SELECT DISTINCT doc_id, term FROM best) USING (doc_id) JOIN dict USING (term) CROSS JOIN st")
def excerpt_weighting(spark, sf_dir):
    index = C.index(spark, sf_dir)
    found = with_weights(index, search(index, "with from that ", NOW_MS))
    return found.select("doc_id", F.explode("weights").alias("term", "weight")).withColumn("weight", F.round("weight", 6))


@query(f"WITH {default_sql(THREE)} SELECT path, CAST(row_number() OVER (ORDER BY mtime_ms DESC, path) AS INTEGER) AS place FROM r JOIN d USING (doc_id)")
def resorted(spark, sf_dir):
    """Results by time instead of relevance: only what was fetched is put in another order."""
    found = B.resort(search(C.index(spark, sf_dir), "with from that ", NOW_MS), "modified")
    return found.select("path", F.row_number().over(Window.orderBy(F.desc("mtime_ms"), "path")).alias("place"))  # twenty rows


@query(f"WITH {default_sql(THREE)} SELECT path, 'md' AS type, 'md' AS ext, '' AS excerpt, round(score, 6) AS score, 0 AS n_matches FROM r JOIN d USING (doc_id)")
def http_answer(spark, sf_dir):
    found = search(C.index(spark, sf_dir), "with from that ", NOW_MS).withColumn("excerpt", F.lit(None).cast("struct<text:string,ranges:array<struct<start:int,end:int>>>"))
    shape = "struct<score:double,path:string,basename:string,type:string,ext:string,excerpt:string,foundWords:array<string>,matches:array<struct<match:string,offset:int>>>"
    rows = http_rows(found).select(F.from_json("value", shape).alias("x"))
    return rows.select("x.path", "x.type", "x.ext", "x.excerpt", F.round("x.score", 6).alias("score"), F.size("x.matches").alias("n_matches"))


# --- words that decompose ------------------------------------------------------------------------

TITLES = ("한국어 공부", "ﬁne day", "½x cup", "ÀÉÎ Straße", "plain")
WORDS = [(i, t.text) for i, title in enumerate(TITLES) for t in T.tokenize(title)]
FOLDED = ", ".join(f"({i}, '{t}')" for i, t in WORDS)


def _titled(spark, sf_dir) -> DataFrame:
    titles = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    return C.corpus(spark, sf_dir).select("doc_id", "path", titles.alias("basename"))


@query(f"SELECT doc_id, x.term FROM documents JOIN (VALUES {FOLDED}) x(k, term) ON doc_id % {len(TITLES)} = k")
def exact_fold_postings(spark, sf_dir):
    """Hangul, ligatures, fractions and marks as the index has them."""
    return I.postings_of(_titled(spark, sf_dir)).select("doc_id", "term")


@query(" UNION ALL ".join(f"SELECT CAST({q} AS BIGINT) AS query_id, doc_id FROM documents WHERE doc_id % {len(TITLES)} = {k}" for q, k in ((0, 0), (1, 1), (2, 3))))
def exact_fold_search(spark, sf_dir):
    found = search_many(I.build_index(_titled(spark, sf_dir)), {0: "한국어 ", 1: "FINE ", 2: "straße "}, NOW_MS, limit=C.EVERYTHING, fuzzy="off")
    return found.select("query_id", "doc_id")


@query("SELECT doc_id, sha256(lower(strip_accents(coalesce(text, '')))) AS folded FROM documents")
def fold_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fold(F.coalesce("text", F.lit(""))), 256).alias("folded"))


@query(f"WITH {D}, f AS (SELECT doc_id, 6 AS field, body AS t FROM d), {C.tokens_sql('f')} SELECT doc_id, count(*) AS n_terms, sha256(string_agg(term, ' ' ORDER BY term)) AS words FROM tk GROUP BY doc_id")
def term_lists(spark, sf_dir):
    found = C.corpus(spark, sf_dir).select("doc_id", T.terms(F.col("body")).alias("t")).where("size(t) > 0")
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("words"))


# --- notes ---------------------------------------------------------------------------------------

NOTES = """notes AS (SELECT doc_id, lang, source, '---' || chr(10) || 'status: ' || lang || chr(13) || chr(10) || '---' || chr(10) || '# Top ' || source || chr(10) || '## Sub ' || lang || ' ##' || chr(10)
 || '###### Deep' || chr(10) || coalesce(text, '') AS content FROM documents), stripped AS (SELECT *, regexp_replace(content, '\\A---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n?', '') AS body FROM notes)"""


def _notes(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.lit("---\nstatus: "), "lang", F.lit("\r\n---\n# Top "), "source", F.lit("\n## Sub "), "lang", F.lit(" ##\n###### Deep\n"), F.coalesce("text", F.lit("")))
    front = F.concat(
        F.lit('{"aliases": ["'), "source", F.lit(' alias", 3], "tags": "#'), F.upper("lang"), F.lit('", "status": "'), "lang", F.lit('", "deep": {"n": '), F.col("doc_id").cast("string"),
        F.lit(', "list": [1.5, true, null, "z"]}, "position": "no"}'),
    )
    return d.select("doc_id", F.concat("source", F.lit(".md")).alias("path"), F.col("source").alias("basename"), content.alias("content"), front.alias("frontmatter"), F.array(F.concat(F.lit("#"), "source")).alias("meta_tags"))


@query(f"WITH {NOTES} SELECT doc_id, sha256(body) AS body FROM stripped")
def note_bodies(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", F.sha2(MD.strip_frontmatter(F.col("content")), 256).alias("body"))


@query(
    rf"""WITH {NOTES}, lines AS (SELECT *, list_filter(regexp_split_to_array(body, '\r?\n'), lambda x: regexp_matches(x, '^#{{1,6}}\s+\S')) AS found FROM stripped),
heads AS (SELECT *, list_transform(found, lambda x: regexp_replace(regexp_replace(x, '^#+\s+', ''), '\s+#*\s*$', '')) AS names, list_transform(found, lambda x: length(regexp_extract(x, '^(#+)', 1))) AS levels FROM lines)
SELECT doc_id, source || ' alias' AS aliases, array_to_string([names[i] FOR i IN range(1, len(names) + 1) IF levels[i] <= 1], ' ') AS h1, array_to_string([names[i] FOR i IN range(1, len(names) + 1) IF levels[i] > 1], ' ') AS h2h3,
 lower(source) || ' ' || lower(lang) AS tags, lang || ' ' || doc_id || ' 1.5 true z' AS frontmatter FROM heads"""
)
def note_fields(spark, sf_dir):
    return MD.extract_fields(_notes(spark, sf_dir)).select("doc_id", "aliases", "h1", "h2h3", "tags", "frontmatter")


@query(rf"WITH {NOTES} SELECT doc_id, substr(regexp_replace(body, '^\s+', ''), 1, {K.PREVIEW_CHARS}) AS preview FROM stripped")
def note_previews(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", E.preview_text(F.col("content"), F.lit("md")).alias("preview"))


@query(f"SELECT doc_id, substr('a  ![[p.PNG]] b ' || regexp_replace(coalesce(text, ''), '[`~!]', '', 'g'), 1, {K.THUMBNAIL_CHARS}) AS thumbnail FROM documents")
def note_thumbnails(spark, sf_dir):
    own = F.concat(F.lit("a ```x\ny```~~~z~~~![[note]] ![[p.PNG]] b "), F.regexp_replace(F.coalesce("text", F.lit("")), "[`~!]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", E.thumbnail_text(own).alias("thumbnail"))


@query("SELECT doc_id, 'a' || chr(CAST(33 + doc_id % 400 AS INTEGER)) || chr(CAST(65 + doc_id % 26 AS INTEGER)) || '& <&bogus; ' AS decoded FROM documents")
def numeric_entities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("a&#"), (F.col("doc_id") % 400 + 33).cast("string"), F.lit(";&#x"), F.hex(F.col("doc_id") % 26 + 65), F.lit(";&AMP;&nbsp;&lt;&bogus;&nbsp;"))
    return d.select("doc_id", decode_entities(raw, numeric=True).alias("decoded"))


# --- excerpts ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, translate(substr(text, 1, {K.EXCERPT_CHARS}), chr(13) || chr(10) || chr(9), '   ') || CASE WHEN length(text) > {K.EXCERPT_CHARS} THEN '…' ELSE '' END AS excerpt FROM documents WHERE text <> ''")
def excerpt_heads(spark, sf_dir):
    """Without a match an excerpt is the head of the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array().cast("array<string>").alias("matched"))
    return E.with_excerpts(d, "text").select("doc_id", F.col("excerpt.text").alias("excerpt")).where("excerpt is not null")


HALF = (K.EXCERPT_CHARS - 6) // 2  # room on each side of a word of six letters


@query(
    f"""WITH c AS (SELECT doc_id, doc_id % 120 AS k, doc_id % 90 AS m FROM documents), x AS (SELECT *, repeat('x ', k) || 'needle' || repeat(' y', m) AS t,
 CASE WHEN 2 * k <= {HALF} THEN 0 ELSE 2 * k - {HALF - 1} END AS a, CASE WHEN {HALF} >= 2 * m THEN 2 * k + 6 + 2 * m ELSE 2 * k + 6 + {HALF - 1} END AS b FROM c)
SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(t, a + 1, b - a) || CASE WHEN b < length(t) THEN '…' ELSE '' END AS excerpt,
 CAST(2 * k - a + CASE WHEN a > 0 THEN 1 ELSE 0 END AS INTEGER) AS begins, CAST(2 * k - a + 6 + CASE WHEN a > 0 THEN 1 ELSE 0 END AS INTEGER) AS ends FROM x"""
)
def excerpt_windows(spark, sf_dir):
    """A match in the middle: room on both sides, whole words at the edges, the range moved along."""
    k, m = (F.col("doc_id") % 120).cast("int"), (F.col("doc_id") % 90).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("x "), k), F.lit("needle"), F.repeat(F.lit(" y"), m)).alias("text"), F.array(F.lit("needle")).alias("matched"))
    found = E.with_excerpts(d, "text").select("doc_id", F.col("excerpt.text").alias("excerpt"), F.col("excerpt.ranges")[0].alias("r"))
    return found.select("doc_id", "excerpt", F.col("r.start").alias("begins"), F.col("r.end").alias("ends"))


# --- building and maintenance --------------------------------------------------------------------


@query(f"WITH {D} SELECT path, row_number() OVER (ORDER BY mtime_ms DESC, path) - 1 AS doc_id FROM d")
def build_order(spark, sf_dir):
    """Ids in the order of modification, the newest first."""
    return I.assign_ids(C.corpus(spark, sf_dir).drop("doc_id"), F.desc("mtime_ms"), F.col("path")).select("path", "doc_id")


@query(f"WITH {INDEX} SELECT doc_id, CAST(len_0 AS INTEGER) AS len_0, CAST(len_4 AS INTEGER) AS len_4, 0 AS len_6 FROM lens")
def lite_lengths(spark, sf_dir):
    return I.build_index(C.corpus(spark, sf_dir), lite=True).docs.select("doc_id", "len_0", "len_4", "len_6")


@query(f"WITH {INDEX} SELECT term, df FROM dict")
def saved_dictionary(spark, sf_dir):
    """What a rebuilt, saved and loaded index knows; the first build is overwritten."""
    path, docs = new_path(spark, "index"), C.corpus(spark, sf_dir)
    I.build_and_save(docs.where("doc_id % 2 = 0"), path)
    I.build_and_save(docs, path)
    return I.load(spark, path).dictionary.select("term", "df")


@query(f"WITH {INDEX} SELECT term, doc_id, CAST(tf_6 AS INTEGER) AS tf_6 FROM p WHERE term IN ('the', 'with', 'la')")
def saved_lookup(spark, sf_dir):
    """Postings of some terms from a saved index, by a filter that reaches the scan."""
    path = new_path(spark, "index")
    I.build_and_save(C.corpus(spark, sf_dir), path)
    return I.load(spark, path).postings.where(F.col("term").isin("the", "with", "la")).select("term", "doc_id", "tf_6")


@query(
    f"""SELECT count(*) FILTER (NOT {C.DELETED}) AS indexed, count(*) FILTER ({C.DELETED}) AS tombstones, count(*) FILTER ({C.DELETED}) > greatest({K.COMPACT_LEAST}, {K.COMPACT_RATIO} * count(*) FILTER (NOT {C.DELETED})) AS compact
FROM documents"""
)
def index_status(spark, sf_dir):
    index = C._tombstoned(spark, sf_dir)
    found = I.status(index)
    return spark.createDataFrame([(found["indexed"], found["tombstones"], I.needs_compaction(index))], "indexed long, tombstones long, compact boolean")


@query(f"WITH {INDEX} SELECT path, CAST(CASE WHEN doc_id % 10 = 0 THEN 3 ELSE len_6 END AS INTEGER) AS len_6, CAST(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE len_0 END AS INTEGER) AS len_0 FROM lens JOIN d USING (doc_id)")
def upserted(spark, sf_dir):
    changed = C.corpus(spark, sf_dir).where("doc_id % 10 = 0").withColumn("body", F.lit("alpha beta gamma")).withColumn("basename", F.lit("fresh"))
    return I.upsert(C.index(spark, sf_dir), changed).live.select("path", "len_6", "len_0")


@query(
    f"""WITH {INDEX} SELECT CASE WHEN path LIKE 'src2/%' THEN 'moved/' || doc_id ELSE path END AS path, CAST(len_6 AS INTEGER) AS len_6 FROM lens JOIN d USING (doc_id) WHERE path NOT LIKE 'src3/%'"""
)
def feed_segments(spark, sf_dir):
    """Two batches of change events as segments: all documents, then deletions and renames."""
    store = new_path(spark, "segments")
    own = C.corpus(spark, sf_dir).select(
        F.col("doc_id").alias("seq"), F.lit("create").alias("kind"), F.lit(None).cast("string").alias("old_path"), "path", "basename", "mtime_ms", F.lit(1).cast("long").alias("size"), F.lit("md").alias("doc_type"), "body"
    )
    gone = own.where("path like 'src3/%'").withColumn("kind", F.lit("delete"))
    moved = own.where("path like 'src2/%'").withColumn("kind", F.lit("rename")).withColumn("old_path", F.col("path")).withColumn("path", F.concat(F.lit("moved/"), F.col("seq").cast("string")))
    U.write_segment(own, 0, store)
    U.write_segment(gone.unionByName(moved), 1, store)
    return U.current(spark, store).live.select("path", "len_6")


EVENTS = """e AS (SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'rename' END AS kind, 'f' || user_id AS own, epoch_us(ts) // 1000 AS mtime_ms FROM events),
x AS (SELECT seq, CASE WHEN kind = 'rename' THEN 'modify' ELSE kind END AS kind, CASE WHEN kind = 'rename' THEN 'g' || substr(own, 2) ELSE own END AS path, mtime_ms FROM e
  UNION ALL SELECT seq, 'delete', own, mtime_ms FROM e WHERE kind = 'rename'),
final AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, kind DESC) = 1)"""


def _changes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "create").when(F.col("event_id") % 3 == 1, "delete").otherwise("rename")
    own = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    rows = e.select(F.col("event_id").alias("seq"), kind.alias("kind"), own.alias("own"), F.unix_millis(F.col("ts").cast("timestamp")).alias("mtime_ms"))
    renamed = F.col("kind") == "rename"
    return rows.select("seq", "kind", F.when(renamed, F.col("own")).alias("old_path"), F.when(renamed, F.concat(F.lit("g"), F.substring("own", 2, 100))).otherwise(F.col("own")).alias("path"), "mtime_ms")


@query(f"WITH {EVENTS} SELECT path, kind, seq FROM final")
def settled_backlog(spark, sf_dir):
    """Events that came before the index was ready: the last of each path counts."""
    return U.settled(_changes(spark, sf_dir)).select("path", "kind", "seq")


@query(f"WITH {EVENTS}, base AS (SELECT 'f' || c_custkey AS path, CAST(c_custkey AS BIGINT) AS mtime_ms FROM customer) SELECT * FROM base WHERE path NOT IN (SELECT path FROM final) UNION ALL SELECT path, mtime_ms FROM final WHERE kind <> 'delete'")
def catalog_changes(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").cast("long").alias("mtime_ms"))
    return U.apply_to_catalog(base, _changes(spark, sf_dir))


# --- caches and keys -----------------------------------------------------------------------------


@query("SELECT source || '/' || doc_id AS path, sha256(text) AS text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL")
def extracted_cache(spark, sf_dir):
    path = new_path(spark, "extracted")
    S.write_extracted(table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"), path)
    return S.extracted_texts(spark, path).select("path", F.sha2("text", 256).alias("text"))


@query(C.OPENS)
def frecency_cache(spark, sf_dir):
    path = new_path(spark, "frecency")
    S.write_frecency(C._opens(spark, sf_dir), path)
    return S.frecency_table(spark, path)


@query(f"SELECT 'cmd:' || key AS key, count, last_opened_ms FROM ({C.OPENS})")
def action_usage(spark, sf_dir):
    """Actions live under their own prefix among the usage statistics."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return U.opens(e, prefix="cmd:")


# --- providers, actions, browsing ----------------------------------------------------------------


def _named(spark, sf_dir, name: str, key: str) -> DataFrame:
    return S.file_catalog(table(spark, sf_dir, name).select(F.concat(F.col(key), F.lit(".canvas")).alias("path"), F.lit(0).cast("long").alias("mtime_ms")))


def found_sql(q: str, key: str, source: str) -> str:
    return f"SELECT path, score, row_number() OVER (ORDER BY score DESC, path) - 1 AS r FROM (SELECT {key} || '.canvas' AS path, score FROM ({C.subsequence_sql(q, key, key, source)}) WHERE score >= 5 ORDER BY score DESC, path LIMIT {K.DEFAULT_LIMIT})"


@query(f"WITH a AS ({found_sql('r12', 'c_name', 'customer')}) SELECT path, round(score, 6) AS score, 'canvas' AS ext, 'md' AS doc_type, 'file' AS source FROM a")
def file_finder(spark, sf_dir):
    found = FileProvider(_named(spark, sf_dir, "customer", "c_name")).search("r12", K.DEFAULT_LIMIT)
    return found.select("path", F.round("score", 6).alias("score"), "ext", "doc_type", "source")


@query(
    f"""WITH a AS ({found_sql("r12", "c_name", "customer")}), b AS ({found_sql("r12", "s_name", "supplier")}), u AS (SELECT path, 1.0 / ({K.RRF_K} + r) AS score, 0 AS l, r FROM a UNION ALL SELECT path, 0.5 / ({K.RRF_K} + r), 1, r FROM b)
SELECT path, round(sum(score), 8) AS score FROM u GROUP BY path ORDER BY sum(score) DESC, min(l * 1000 + r) LIMIT {K.DEFAULT_LIMIT}"""
)
def fused_providers(spark, sf_dir):
    """Two providers of different weight; one that fails has no rows."""
    a, b = FileProvider(_named(spark, sf_dir, "customer", "c_name")), FileProvider(_named(spark, sf_dir, "supplier", "s_name"))
    a.name, a.weight, b.name, b.weight = "customers", 1.0, "suppliers", 0.5

    class Failing(FileProvider):
        name = "failing"

        def search(self, raw: str, limit: int) -> DataFrame:
            raise RuntimeError("no source")

    return ProviderRegistry(a, Failing(a.catalog), b).fused("r12").select("path", F.round("score", 8).alias("score"))


ACTIONS = f"""SELECT id, round(score, 6) AS score, round(CASE WHEN count IS NULL THEN 1.0 ELSE {C.BOOST} END, 6) AS boost
FROM (SELECT 'part:' || p_partkey AS id, score FROM ({C.subsequence_sql("lar", "p_partkey", "lower(p_name || ' part')", "part")})) LEFT JOIN (SELECT 'part:' || key AS id, count, last_opened_ms FROM ({C.OPENS})) USING (id)"""


@query(ACTIONS)
def action_ranking(spark, sf_dir):
    commands = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    used = C._opens(spark, sf_dir).withColumn("key", F.concat(F.lit("cmd:part:"), "key"))
    return Z.rank_actions(Z.actions(commands), "lar", used, C.EVENTS_NOW).select("id", F.round("score", 6).alias("score"), F.round("boost", 6).alias("boost"))


@query(f"SELECT path, doc_id * 1000 AS mtime_ms FROM ({C.MIXED}) WHERE path LIKE '%.canvas' ORDER BY mtime_ms DESC, path LIMIT {K.BROWSE_LIMIT}")
def browse_catalog(spark, sf_dir):
    """Types that are not indexed are browsed in the file catalog."""
    files = C._mixed(spark, sf_dir).select("path", (F.col("doc_id") * 1000).alias("mtime_ms"))
    return B.browse_any(files.limit(0), files, NOW_MS, "canvas").select("path", "mtime_ms")


@query(f"WITH {D} SELECT path, mtime_ms - doc_id * 7 % 1000 * {K.DAY_MS} AS sort_time FROM d ORDER BY sort_time DESC, path LIMIT {K.BROWSE_LIMIT}")
def recent_created(spark, sf_dir):
    docs = C.corpus(spark, sf_dir).withColumn("ctime_ms", F.col("mtime_ms") - F.col("doc_id") * 7 % 1000 * K.DAY_MS).withColumn("tags", F.col("tag_list")).withColumn("deleted", F.lit(False))
    return B.recent(docs, order="created").select("path", "sort_time")


@query("SELECT p, count(*) AS n FROM events, (VALUES ('today', 1706659200000), ('week', 1706097600000), ('month', 1704110400000), ('year', 1675166400000)) v(p, t) WHERE epoch_ms(ts) >= t GROUP BY p")
def date_presets(spark, sf_dir):
    """Events since each preset at noon of 2024-01-31."""
    now = 1_706_702_400_000
    e = table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    tests = F.array_compact(F.array(*[F.when(F.col("t") >= P.since(p, now, "UTC"), p) for p in P.DATE_PRESETS]))
    return e.select(F.explode(tests).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


TYPED = "CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext = 'png' THEN 'image' ELSE 'md' END"


@query(
    f"""SELECT doc_id, unnest(list_filter([CASE WHEN t = 'md' THEN 'note' END, CASE WHEN t = 'pdf' THEN 'pdf' END, CASE WHEN t = 'image' OR ext = 'heic' THEN 'image' END, CASE WHEN t = 'html' THEN 'html' END,
 CASE ext WHEN 'canvas' THEN 'canvas' WHEN 'base' THEN 'base' WHEN 'mp3' THEN 'audio' WHEN 'webm' THEN 'video' END], lambda x: x IS NOT NULL)) AS kind FROM (SELECT *, {TYPED} AS t FROM (SELECT *, {C.EXT} AS ext FROM ({C.MIXED})))"""
)
def type_filter_by_kind(spark, sf_dir):
    """The type filters where the document's own type counts as well as its extension."""
    m = C._mixed(spark, sf_dir).withColumn("ext", M.extension(F.col("path")))
    tests = F.array_compact(F.array(*[F.when(P.of_type(k, F.col("ext"), M.doc_type(F.col("ext"))), k) for k in P.TYPE_TESTS]))
    return m.select("doc_id", F.explode(tests).alias("kind"))


@query(
    f"""SELECT doc_id, CASE ext WHEN 'md' THEN 'file-text' WHEN 'pdf' THEN 'file-type' WHEN 'png' THEN 'image' WHEN 'heic' THEN 'image' WHEN 'htm' THEN 'globe' WHEN 'canvas' THEN 'layout-dashboard' WHEN 'base' THEN 'table'
 WHEN 'mp3' THEN 'music' WHEN 'webm' THEN 'video' ELSE 'file-text' END AS icon FROM (SELECT *, {C.EXT} AS ext FROM ({C.MIXED}))"""
)
def file_icons(spark, sf_dir):
    m = C._mixed(spark, sf_dir).withColumn("ext", M.extension(F.col("path")))
    return m.select("doc_id", M.icon(F.col("ext"), M.doc_type(F.col("ext"))).alias("icon"))


@query("SELECT c_custkey, strftime(DATE '2026-07-16' + o, '%Y-%m-%d') AS day FROM (SELECT c_custkey, [0, -1, 1, NULL][c_custkey % 4 + 1] AS o FROM customer)")
def date_keywords(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(x) for x in (" OGGI", "yesterday ", "Domani", "someday")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.date_keyword(words, F.lit("2026-07-16").cast("date")).cast("string").alias("day"))


@query(
    r"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '^\s*(-\s*)?\[\s?\]') THEN '- [ ] ' || trim(regexp_replace(t, '^\s*(-\s*)?\[\s?\]\s*', '')) || ' 📅 ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '- ' || trim(t) END AS captured
FROM (SELECT *, ['', '- [ ] ', ' [] ', '[x] '][o_orderkey % 4 + 1] || o_orderpriority || ' ' AS t FROM orders)"""
)
def captures(spark, sf_dir):
    marks = F.element_at(F.array(*[F.lit(x) for x in ("", "- [ ] ", " [] ", "[x] ")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.concat(marks, "o_orderpriority", F.lit(" ")).alias("t"))
    return o.select("o_orderkey", M.capture_line(F.col("t"), F.col("day")).alias("captured"))


@query(f"SELECT p_partkey, {C.destructive_sql('t')} AS destructive FROM (SELECT p_partkey, ['Delete ', 'Show trash ', 'clear history ', 'reset '][p_partkey % 4 + 1] || p_name AS t FROM part)")
def destructive_names(spark, sf_dir):
    verbs = F.element_at(F.array(*[F.lit(x) for x in ("Delete ", "Show trash ", "clear history ", "reset ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.is_destructive(F.concat(verbs, F.col("p_name"))).alias("destructive"))
