"""Approximate matching: bounded edit distance and subsequence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import fold, fold_text, units, utf16_length


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 if it is larger; the scan stops early."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def max_distance(term: str) -> int:
    return 2 if units(term) > 6 else 1


def fuzzy_candidates(dictionary: DataFrame, target: str, most: int | None = None) -> DataFrame:
    """(term, dist) of other terms within the distance; the length band is tested before the distance."""
    most = max_distance(target) if most is None else most
    band = dictionary.where(F.col("len").between(units(target) - most, units(target) + most) & (F.col("term") != target))
    return band.select("term", bounded_levenshtein(F.col("term"), F.lit(target), most).alias("dist")).where(F.col("dist") <= most).orderBy("dist", "term")


def fuzzy_candidates_many(dictionary: DataFrame, targets: DataFrame) -> DataFrame:
    """For targets (query_id, group_id, target): (query_id, group_id, term, dist, df). The targets are the query set;
    the join runs on exact length, so only terms of the band meet."""
    own = utf16_length(F.col("target"))
    most = F.when(own > 6, 2).otherwise(1)
    wanted = targets.withColumn("most", most).withColumn("len", F.explode(F.sequence(own - F.col("most"), own + F.col("most"))))
    met = wanted.join(dictionary.select("term", "len", "df"), "len").where(F.col("term") != F.col("target"))
    scored = met.withColumn("dist", F.levenshtein("term", "target", 2))
    return scored.where((F.col("dist") >= 0) & (F.col("dist") <= F.col("most"))).select("query_id", "group_id", "term", "dist", "df")


def subsequence_score(query: str, candidate: Column) -> Column:
    """Score of the query's characters found from left to right in the candidate (both folded); null if they
    are not all there. Runs and word starts score more, a late start and gaps less, whole names most."""
    q = fold_text(query)
    if not q:
        return F.lit(None).cast("double")
    c = fold(candidate)
    start = F.struct(F.lit(0).alias("next"), F.lit(-2).alias("last"), F.lit(-1).alias("first"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"))

    def step(s: Column, ch: Column) -> Column:
        at = F.call_function("locate", ch, c, s["next"] + 1) - 1
        before, here = F.substring(candidate, at, F.lit(1)), F.substring(candidate, at + 1, F.lit(1))
        boundary = (at == 0) | before.isin(*K.BOUNDARY_CHARS) | (F.lower(before) == before) & (F.lower(here) != here)
        gain = K.SUBSEQ_CHAR + F.when(at == s["last"] + 1, K.SUBSEQ_RUN).otherwise(0.0) + F.when(boundary, K.SUBSEQ_BOUNDARY).otherwise(0.0)
        return F.struct(
            (at + 1).alias("next"), at.alias("last"), F.when(s["first"] < 0, at).otherwise(s["first"]).alias("first"),
            (s["score"] + gain).alias("score"), (s["ok"] & (at >= 0)).alias("ok"),
        )

    def finish(s: Column) -> Column:
        spread = s["last"] - s["first"] - (len(q) - 1)
        whole = F.when(c == q, K.SUBSEQ_EXACT).when(c.startswith(q), K.SUBSEQ_PREFIX).otherwise(0.0)
        return F.when(s["ok"], s["score"] - s["first"] * K.SUBSEQ_LEAD - spread * K.SUBSEQ_GAP + whole)

    return F.aggregate(F.array(*[F.lit(x) for x in q]), start, step, finish)


def min_score(query: str) -> float:
    return K.MIN_SCORE_BY_LENGTH[min(len(query.strip()), 4)]


def search_catalog(catalog: DataFrame, query: str, limit: int = K.DEFAULT_LIMIT, least: float | None = None, name: str = "basename") -> DataFrame:
    """Files by the score of their name: best first, then the newest, then by path."""
    if not query.strip():
        return catalog.withColumn("score", F.lit(0.0)).limit(0)
    least = min_score(query) if least is None else least
    scored = catalog.withColumn("score", subsequence_score(query, F.col(name)))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("mtime_ms"), "path").limit(limit)


def actions(commands: DataFrame, default_source: str = "app") -> DataFrame:
    """Commands (id, name) as actions: source (the id's part before a colon), destructive, describe."""
    from .filters import is_destructive

    source = F.when(F.col("id").contains(":"), F.substring_index("id", ":", 1)).otherwise(default_source)
    shown = commands.select("id", F.col("name").alias("title"), source.alias("source"))
    return shown.withColumn("destructive", is_destructive(F.concat_ws(" ", "title", "id"))).withColumn("describe", F.format_string("%s (%s)", "title", "source"))


def match_actions(catalog: DataFrame, query: str) -> DataFrame:
    """Actions by the score of "title source", best first; all for an empty query."""
    if not query:
        return catalog.withColumn("score", F.lit(0.0))
    scored = catalog.withColumn("score", subsequence_score(query.lower(), F.lower(F.concat_ws(" ", "title", "source"))))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "id")


def rank_actions(catalog: DataFrame, query: str, frecency: DataFrame, now_ms: int) -> DataFrame:
    """Command mode: the most used first, then the best match."""
    from .rank import frecency as boost

    opened = frecency.select(F.col("key").alias("__key"), "count", "last_opened_ms")
    found = match_actions(catalog, query).join(opened, F.concat(F.lit("cmd:"), "id") == F.col("__key"), "left")
    return found.withColumn("boost", boost(F.coalesce("count", F.lit(0)), F.col("last_opened_ms"), now_ms)).drop("__key", "count", "last_opened_ms").orderBy(F.desc("boost"), F.desc("score"), "id")
