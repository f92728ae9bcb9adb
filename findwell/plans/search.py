"""Search: from query strings to ranked documents, for one query or many in one plan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.misc import extension
from ..operators import fuzzy as Z
from ..operators.filters import allowed, of_type
from ..operators.index import Index, prefix_terms
from ..operators.rank import GROUPS, PHRASES, RankOptions, idf, rank, with_df
from .parser import ParsedQuery, parse_query

SMALL = 50_000  # rows of a query relation up to which it is broadcast
PUSHED = 200  # terms up to which they are written into the scan's filter
FEW_QUERIES = 8  # queries up to which their terms are looked up beforehand

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has, as a local relation (no job reads it)."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]))


def _narrowed(index: Index, exact: set[str], prefixes: set[str]) -> Index:
    """Only the postings and terms that can take part: a filter that reaches the Parquet scan."""
    if len(exact) + len(prefixes) > PUSHED:
        return index
    test = F.col("term").isin(sorted(exact))
    for p in sorted(prefixes):
        test = test | F.col("term").startswith(p)
    return replace(index, postings=index.postings.where(test), dictionary=index.dictionary.where(test))


FOUND = "query_id long, doc_id long, score double, first_score double, matched array<string>, rank int"
_DF = GROUPS + ", df long"


def _resolved(index: Index, exact: list[tuple[int, int, str]], prefixes: list[tuple[int, int, str]]) -> list[tuple]:
    """Group rows of a few queries, looked up by one job: at most a row for each term and ``PREFIX_CAP`` for each prefix."""
    terms = sorted({t for _, _, t in exact})
    parts = [index.dictionary.where(F.col("term").isin(terms)).select("term", "df", F.lit(None).cast("string").alias("prefix"))]
    parts += [prefix_terms(index.dictionary, p).select("term", "df", F.lit(p).alias("prefix")) for p in sorted({p for _, _, p in prefixes})]
    df, under = {}, defaultdict(list)
    for r in reduce(DataFrame.unionByName, parts).collect():
        if r["prefix"] is None:
            df[r["term"]] = r["df"]
        else:
            under[r["prefix"]].append((-r["df"], r["term"]))
    rows = [(q, g, 1.0, t, 0, df[t]) for q, g, t in exact if t in df]
    for q, g, p in prefixes:
        rows += [(q, g, K.PREFIX_WEIGHT, t, i + 1, -n) for i, (n, t) in enumerate(sorted(under[p])) if t != p]
    return rows


def _prefix_groups(index: Index, wanted: list[tuple[int, int, str]]) -> DataFrame:
    """Group rows of prefix expansions for (query_id, group_id, prefix): the most frequent terms, without the
    prefix itself. Terms meet prefixes by equality on their first characters."""
    asked = _local(index.docs.sparkSession, wanted, "query_id long, group_id int, prefix string")
    sizes = sorted({len(p) for _, _, p in wanted})
    heads = F.explode(F.array_distinct(F.array(*[F.substring("term", 1, n) for n in sizes]))).alias("prefix")
    hits = index.dictionary.select("term", "df", heads).join(F.broadcast(asked) if len(wanted) <= SMALL else asked, "prefix")
    place = F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy(F.desc("df"), "term"))
    kept = hits.withColumn("place", place).where((F.col("place") <= K.PREFIX_CAP) & (F.col("term") != F.col("prefix")))
    return kept.select("query_id", "group_id", F.lit(K.PREFIX_WEIGHT).alias("weight"), F.col("term").alias("variant"), F.col("place").cast("int").alias("variant_rank"), "df")


def _fuzzy_groups(index: Index, wanted: list[tuple[int, int, str]], exact: list[tuple[int, str]]) -> DataFrame:
    spark = index.docs.sparkSession
    targets = _local(spark, wanted, "query_id long, group_id int, target string")
    known = _local(spark, exact, "query_id long, term string")
    found = Z.fuzzy_candidates_many(index.dictionary, F.broadcast(targets) if len(wanted) <= SMALL else targets).join(known, ["query_id", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("dist", "term"))
    return found.select("query_id", "group_id", F.lit(K.FUZZY_WEIGHT).alias("weight"), F.col("term").alias("variant"), place.alias("variant_rank"), "df")


def _restriction(index: Index, parsed: dict[int, ParsedQuery], path_filters, tag_filters, min_mtime) -> Callable[[DataFrame], DataFrame] | None:
    """Filters of the queries and of the caller (all must hold); None if there is nothing to test."""
    spark = index.docs.sparkSession
    own = [(q, list(p.path_filters), list(p.tag_filters)) for q, p in parsed.items() if p.path_filters or p.tag_filters]
    without = [(q, t) for q, p in parsed.items() for t in p.exclusions]
    shared = bool(path_filters or tag_filters or min_mtime is not None)
    if not own and not without and not shared:
        return None

    def restrict(rows: DataFrame) -> DataFrame:
        if shared:
            rows = rows.join(allowed(index.docs, path_filters, tag_filters, min_mtime).select("doc_id"), "doc_id", "left_semi")
        if own:
            tests = _local(spark, own, "query_id long, __paths array<string>, __tags array<string>")
            wide = rows.join(F.broadcast(tests) if len(own) <= SMALL else tests, "query_id", "left").join(index.docs.select("doc_id", "folded_path", "tags"), "doc_id")
            paths = F.forall(F.coalesce("__paths", F.array().cast("array<string>")), lambda p: F.col("folded_path").contains(p))
            tags = F.forall(F.coalesce("__tags", F.array().cast("array<string>")), lambda f: F.exists("tags", lambda t: t.startswith(f)))
            rows = wide.where(paths & tags).select(*rows.columns)
        if without:
            bad = _local(spark, without, "query_id long, term string")
            hit = index.postings.select("term", "doc_id").join(F.broadcast(bad) if len(without) <= SMALL else bad, "term").select("query_id", "doc_id")
            rows = rows.join(hit, ["query_id", "doc_id"], "left_anti")
        return rows

    return restrict


def search_many(
    index: Index, queries: dict[int, str], now_ms: int, limit: int = K.DEFAULT_LIMIT, fuzzy: str = "on-sparse", title_only: bool = False,
    path_filters=(), tag_filters=(), min_mtime: int | None = None, rescore_top: int = K.RESCORE_TOP,
) -> DataFrame:
    """(query_id, rank, doc_id, path, basename, doc_type, tags, mtime_ms, score, matched) for all queries.

    fuzzy: ``off``, ``always``, or ``on-sparse`` (queries with fewer than five results are ranked again with
    similar terms).
    """
    spark = index.docs.sparkSession
    parsed = {q: p for q, raw in queries.items() if (p := parse_query(raw)).exact}
    empty = index.docs.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "doc_id", "path", "basename", "doc_type", "tags", "mtime_ms", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched")).where("false")
    if not parsed:
        return empty
    rows, prefixes, near, phrases = [], [], [], []
    for q, p in parsed.items():
        rows += [(q, g, 1.0, t, 0) for g, t in enumerate(p.exact)]
        typed = [t for t, prefix in p.terms.items() if prefix]
        prefixes += [(q, len(p.exact) + i, t) for i, t in enumerate(typed)]
        near += [(q, len(p.exact) + len(typed) + i, t) for i, t in enumerate(p.terms)]
        phrases += [(q, i, words) for i, words in enumerate(p.phrases)]
    exact = {t for p in parsed.values() for t in p.exact}
    heads = {t for _, _, t in prefixes}
    if len(parsed) <= FEW_QUERIES and len(exact) + len(heads) <= PUSHED:
        known = _resolved(index, [(q, g, t) for q, g, _, t, _ in rows], prefixes)
        groups = _local(spark, known, _DF)
    else:
        groups = with_df(index, _local(spark, rows, GROUPS)).select(*[f.split(" ")[0] for f in _DF.split(", ")])
        if prefixes:
            groups = groups.unionByName(_prefix_groups(index, prefixes))
    # every prefix expands to at most PREFIX_CAP terms, so the size of the query relation is known beforehand
    small = len(rows) + K.PREFIX_CAP * len(prefixes) <= SMALL
    spoken = _local(spark, phrases, PHRASES) if phrases else None
    restrict = _restriction(index, parsed, path_filters, tag_filters, min_mtime)
    single = not prefixes and all(len(p.exact) == 1 for p in parsed.values())
    options = RankOptions(now_ms, limit, title_only, small, rescore_top, len(parsed), single)
    wider = RankOptions(now_ms, limit, title_only, False, rescore_top, len(parsed))
    if fuzzy == "always" and near:
        wide = groups.unionByName(_fuzzy_groups(index, near, [(q, t) for q, p in parsed.items() for t in p.exact]))
        found = rank(index, wide, wider, spoken, restrict)
    else:
        found = rank(_narrowed(index, exact, heads), groups, options, spoken, restrict)
        if fuzzy == "on-sparse" and near:
            if options.few:  # at most ``limit`` rows a query: they need not be found twice
                found = _local(spark, [tuple(r) for r in found.collect()], FOUND)
            counts = {r[0]: r[1] for r in found.groupBy("query_id").count().collect()}  # one row a query
            sparse = [q for q in parsed if counts.get(q, 0) < K.FUZZY_SPARSE]
            again = [x for x in near if x[0] in set(sparse)]
            if again:
                more = _fuzzy_groups(index, again, [(q, t) for q in sparse for t in parsed[q].exact])
                changed = _local(spark, [(q,) for q in sparse], "query_id long")
                wide = groups.join(F.broadcast(changed), "query_id", "left_semi").unionByName(more)
                second = rank(index, wide, wider, spoken, restrict)
                found = found.join(F.broadcast(changed), "query_id", "left_anti").unionByName(second)
    described = index.docs.select("doc_id", "path", "basename", "doc_type", "tags", "mtime_ms")
    return described.join(F.broadcast(found) if options.few else found, "doc_id").select(*empty.columns)


def search(index: Index, raw: str, now_ms: int, limit: int = K.DEFAULT_LIMIT, **options) -> DataFrame:
    """The results of one query, best first."""
    found = search_many(index, {0: raw}, now_ms, limit, **options).drop("query_id")
    return found.orderBy("rank").limit(limit)  # no more rows than that: the limit spares an exchange


def search_typed(index: Index, raw: str, now_ms: int, kind: str | None = None, limit: int = K.DEFAULT_LIMIT, **options) -> DataFrame:
    """As search(), for one type of file: ``OVERFETCH`` times the limit are fetched, those of the type stay, and the limit cuts them."""
    found = search(index, raw, now_ms, limit=limit * K.OVERFETCH if kind else limit, **options)
    if kind:
        found = found.where(of_type(kind, extension(F.col("path")), F.col("doc_type")))
    return found.orderBy("rank").limit(limit)


def excerpt_weights(index: Index, terms: list[str]) -> dict[str, float]:
    """Inverse document frequency of each term; unknown terms count as never seen."""
    n = index.stats.first()["n"]
    known = {r["term"]: r["df"] for r in index.dictionary.where(F.col("term").isin(terms)).collect()}
    from math import log

    return {t: log((n + 1) / (known.get(t, 0) + 0.5)) for t in terms}


def with_weights(index: Index, results: DataFrame) -> DataFrame:
    """Adds ``weights`` map<term, idf> for each row's matched terms."""
    words = results.select(F.explode("matched").alias("term")).distinct()
    scored = words.join(index.dictionary.select("term", "df"), "term", "left").crossJoin(F.broadcast(index.stats.select("n")))
    every = scored.agg(F.map_from_entries(F.collect_list(F.struct("term", idf(F.col("n"), F.coalesce("df", F.lit(0)))))).alias("__all"))
    return results.crossJoin(F.broadcast(every)).withColumn("weights", F.map_filter("__all", lambda k, v: F.array_contains("matched", k))).drop("__all")
