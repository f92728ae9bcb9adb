"""BM25F ranking as one plan for any number of queries.

Queries arrive as a small relation of term groups: (query_id, group_id, weight, variant,
variant_rank). Its join with the postings is the only place where terms are looked up; documents are then
reduced to (query_id, doc_id) with two aggregations. Positions are left out of that first phase and read again
only for each query's best ``RESCORE_TOP`` documents, which proximity and phrases re-score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .index import LEN, TF, Index

GROUPS = "query_id long, group_id int, weight double, variant string, variant_rank int"  # a column df may follow
PHRASES = "query_id long, phrase_id int, words array<string>"


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 0.5))


def tnorm(fields: tuple[int, ...] = tuple(range(len(K.FIELDS)))) -> Column:
    """Weighted, length-normalised term frequency over the given fields: one arithmetic expression."""
    total = F.lit(0.0)
    for f in fields:
        b, weight = K.FIELD_B[f], K.FIELD_WEIGHT[f]
        if b == 0:
            total = total + F.col(TF[f]) * weight
        else:
            ratio = F.when(F.col(f"avg_{f}") > 0, F.try_divide(F.col(LEN[f]), F.col(f"avg_{f}"))).otherwise(1.0)
            total = total + F.col(TF[f]) * weight / (1 - b + b * ratio)
    return total


def coverage(groups: Column) -> Column:
    return 1 + K.COVERAGE * (groups - 1)


def recency(mtime_ms: Column, now_ms: int) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - mtime_ms) / K.DAY_MS)
    return 1 + K.RECENCY_MAX * F.exp(-age / K.RECENCY_DAYS)


def frecency(count: Column, last_opened_ms: Column, now_ms: int) -> Column:
    """Boost by how often and how lately something was opened; 1 if never."""
    often = F.least(F.lit(1.0), F.log2(1 + count) / F.log2(F.lit(K.FRECENCY_SATURATION + 1.0)))
    lately = F.exp(-F.greatest(F.lit(0.0), (F.lit(now_ms) - last_opened_ms) / K.DAY_MS) / K.FRECENCY_DAYS)
    boost = 1 + K.FRECENCY_MAX * (K.FRECENCY_COUNT_SHARE * often + K.FRECENCY_AGE_SHARE * lately)
    return F.when(count > 0, boost).otherwise(1.0)


def with_df(index: Index, groups: DataFrame) -> DataFrame:
    """Groups with their variants' document frequency; unknown variants go."""
    return groups if "df" in groups.columns else groups.join(index.dictionary.select(F.col("term").alias("variant"), "df"), "variant")


def contributions(index: Index, groups: DataFrame, fields: tuple[int, ...], broadcast: bool = True) -> DataFrame:
    """(query_id, group_id, weight, doc_id, mtime_ms, contrib, term): each group's best variant for each document."""
    asked = with_df(index, groups)
    used = [TF[f] for f in fields]
    hits = index.postings.select("term", "doc_id", *used)
    hits = hits.join(F.broadcast(asked) if broadcast else asked, hits["term"] == asked["variant"]).drop("variant")
    lengths = [LEN[f] for f in fields if K.FIELD_B[f]]
    scored = index.with_facts(hits.join(index.docs.where(~F.col("deleted")).select("doc_id", "mtime_ms", *lengths), "doc_id"))
    scored = scored.withColumn("t", tnorm(fields)).where("t > 0")
    contrib = idf(F.col("n"), F.col("df")) * F.col("t") / (K.K1 + F.col("t"))
    best = F.max(F.struct(contrib.alias("contrib"), (-F.col("variant_rank")).alias("r"), F.col("term"))).alias("best")
    # one shuffle serves this aggregation and the next one
    dealt = scored.repartition("query_id", "doc_id")
    kept = dealt.groupBy("query_id", "group_id", "weight", "doc_id").agg(best, F.any_value("mtime_ms").alias("mtime_ms"))
    return kept.select("query_id", "group_id", "weight", "doc_id", "mtime_ms", "best.contrib", "best.term", (-F.col("best.r")).alias("variant_rank"))


def min_window(lists: Column) -> Column:
    """Smallest span of positions with one from each list; null if a list is empty."""
    latest_start = F.array_max(F.transform(lists, F.array_min))
    ends = F.filter(F.flatten(lists), lambda p: p >= latest_start)
    return F.array_min(F.transform(ends, lambda p: p - F.array_min(F.transform(lists, lambda one: F.array_max(F.filter(one, lambda x: x <= p))))))


def adjacent(lists: Column) -> Column:
    """Whether position s + i is in list i for some s and every i."""
    rest = F.when(F.size(lists) > 1, F.slice(lists, 2, 1_000_000)).otherwise(F.array().cast("array<array<int>>"))
    return F.exists(F.get(lists, 0), lambda s: F.forall(F.transform(rest, lambda one, i: F.array_contains(one, s + i + 1)), lambda ok: ok))


@dataclass(frozen=True)
class RankOptions:
    now_ms: int
    limit: int = K.DEFAULT_LIMIT
    title_only: bool = False
    broadcast: bool = True  # the query relation is small
    rescore_top: int = K.RESCORE_TOP
    queries: int | None = None  # how many there are, if known: bounds the rows of the second phase
    single: bool = False  # no query has a second term: nothing to rescore

    @property
    def few(self) -> bool:
        """Whether the second phase has few rows: at most this many documents for each query, a handful of terms each."""
        return self.queries is not None and self.queries * max(self.rescore_top, self.limit) <= FEW


FEW = 20_000


def _steady(score: str) -> Column:
    """Scores in an order that the order of summation cannot change."""
    return F.desc(F.round(score, 10))


def rank(index: Index, groups: DataFrame, options: RankOptions, phrases: DataFrame | None = None, restrict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, score, first_score, matched, rank from 1): each query's best documents.

    restrict: takes rows with query_id and doc_id and keeps those that may be returned.
    Order: score, then first-pass score, then the first group and variant that found it, then doc_id.
    """
    fields = K.TITLE_FIELDS if options.title_only else tuple(range(len(K.FIELDS)))
    best = contributions(index, groups, fields, options.broadcast)
    if restrict is not None:
        best = restrict(best)
    found = F.array_sort(F.collect_list(F.struct("group_id", "variant_rank", "term"))).alias("won")
    docs = best.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("contrib") * F.col("weight")).alias("base"), F.count("*").alias("n_groups"), F.any_value("mtime_ms").alias("mtime_ms"), found
    )
    first = docs.withColumn("first_score", F.col("base") * coverage(F.col("n_groups")) * recency(F.col("mtime_ms"), options.now_ms))
    order = [_steady("first_score"), F.col("won")[0]["group_id"], F.col("won")[0]["variant_rank"], F.col("doc_id")]
    top = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= max(options.rescore_top, options.limit))
    terms = F.array_distinct(F.transform("won", lambda w: w["term"]))
    top = top.select("query_id", "doc_id", "first_score", "place", terms.alias("matched"))
    if options.single and phrases is None:
        out = top.where(F.col("place") <= options.limit).withColumn("score", F.col("first_score"))
        return out.select("query_id", "doc_id", "score", "first_score", "matched", F.col("place").alias("rank"))

    # phase two: positions of the winning terms, for the best documents only
    wanted = top.select("query_id", "doc_id", F.explode("matched").alias("term"))
    near = index.postings.where(F.size("positions") > 0).select("term", "doc_id", "positions")
    if options.broadcast:  # the postings of other terms are left behind before anything is dealt out
        near = near.join(F.broadcast(groups.select(F.col("variant").alias("term")).distinct()), "term", "left_semi")
    hint = F.broadcast if options.few else lambda df: df
    lists = near.join(hint(wanted), ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    scored = top.join(hint(lists), ["query_id", "doc_id"], "left")
    window = F.when(F.size(F.map_values("at")) >= 2, min_window(F.map_values("at")))
    close = F.when((window <= K.PROXIMITY_WINDOW) & (F.col("place") <= options.rescore_top), 1 + K.PROXIMITY_MAX * (1 - window / K.PROXIMITY_WINDOW)).otherwise(1.0)
    scored = scored.withColumn("score", F.col("first_score") * close)
    if phrases is not None:
        spoken = phrases.groupBy("query_id").agg(F.collect_list("words").alias("phrases"))
        scored = scored.join(F.broadcast(spoken) if options.broadcast else spoken, "query_id", "left")
        said = F.filter("phrases", lambda p: F.forall(p, lambda w: F.map_contains_key("at", w)) & adjacent(F.transform(p, lambda w: F.try_element_at("at", w))))
        many = F.when((F.col("place") <= options.rescore_top) & F.col("at").isNotNull() & F.col("phrases").isNotNull(), F.size(said)).otherwise(0)
        scored = scored.withColumn("score", F.col("score") * F.pow(F.lit(1 + K.PHRASE_BONUS), many))
    final = Window.partitionBy("query_id").orderBy(_steady("score"), "place")
    out = scored.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= options.limit)
    return out.select("query_id", "doc_id", "score", "first_score", "matched", "rank")
