"""Fusion of ranked lists and re-ranking by use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .rank import frecency


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = K.RRF_K, weights: list[float] | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Fuses lists of (keys, rank from 0, payload columns): score is the sum of weight / (k + rank); the payload comes
    from the first list that has the row, ties go to the first encounter. All lists have the same columns."""
    weights = weights or [1.0] * len(lists)
    parts = [d.withColumn("__list", F.lit(i)).withColumn("__w", F.lit(float(w))) for i, (d, w) in enumerate(zip(lists, weights))]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    payload = [c for c in every.columns if c not in (*keys, "rank", "__list", "__w")]
    first = F.struct("__list", "rank")
    fused = every.groupBy(*keys).agg(
        F.sum(F.col("__w") / (k + F.col("rank"))).alias("score"), F.min(first).alias("__first"), *[F.min_by(F.struct(c), first)[c].alias(c) for c in payload]
    )
    return fused


def ordered(fused: DataFrame, limit: int | None = None) -> DataFrame:
    out = fused.orderBy(F.desc("score"), "__first")
    return (out if limit is None else out.limit(limit)).drop("__first")


def with_rank(df: DataFrame, *order, most: int) -> DataFrame:
    """The first ``most`` rows with their rank from 0: a list of results. Whole tables are ranked by ``index.assign_ids``."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def apply_frecency(results: DataFrame, opened: DataFrame, now_ms: int, key: str = "path") -> DataFrame:
    """Multiplies the scores of an already limited result by the use of each row."""
    used = opened.select(F.col("key").alias("__key"), F.col("count").alias("__n"), F.col("last_opened_ms").alias("__t"))
    joined = results.join(used, results[key] == used["__key"], "left")
    boost = frecency(F.coalesce("__n", F.lit(0)), F.col("__t"), now_ms)
    return joined.withColumn("score", F.col("score") * boost).drop("__key", "__n", "__t").orderBy(F.desc("score"), key)
