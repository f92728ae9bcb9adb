"""Browsing without a query: recent documents, sort orders, recency buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .filters import INDEXED_TYPES, allowed, of_type

BUCKETS = ("Today", "Yesterday", "Past week", "Past 30 days", "Older")


def day_start(ms: Column) -> Column:
    """Midnight (of the session's time zone) of an epoch time in ms."""
    return F.unix_millis(F.date_trunc("DAY", F.timestamp_millis(ms)))


def bucket_order(mtime_ms: Column, now_ms: int) -> Column:
    """0..4: which recency bucket a time falls in. Later days than today count as today."""
    today = day_start(F.lit(now_ms).cast("long"))
    return F.when(mtime_ms >= today, 0).when(mtime_ms >= today - K.DAY_MS, 1).when(mtime_ms >= today - 7 * K.DAY_MS, 2).when(mtime_ms >= today - 30 * K.DAY_MS, 3).otherwise(4)


def group_by_recency(items: DataFrame, now_ms: int, time: str = "mtime_ms") -> DataFrame:
    """Adds ``bucket_ord`` and ``bucket``."""
    order = bucket_order(F.col(time), now_ms)
    return items.withColumn("bucket_ord", order).withColumn("bucket", F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket_ord") + 1))


def sort_time(order: str, mtime_ms: Column, ctime_ms: Column | None = None, last_opened_ms: Column | None = None) -> Column:
    """The time that a sort order looks at: created, viewed (or else modified), modified."""
    if order == "created" and ctime_ms is not None:
        return F.coalesce(ctime_ms, mtime_ms)
    if order == "viewed" and last_opened_ms is not None:
        return F.coalesce(last_opened_ms, mtime_ms)
    return mtime_ms


def recent(docs: DataFrame, limit: int = K.BROWSE_LIMIT, order: str = "modified", opened: DataFrame | None = None, path_filters=(), tag_filters=(), min_mtime: int | None = None) -> DataFrame:
    """The latest live documents that pass the filters."""
    found = allowed(docs, path_filters, tag_filters, min_mtime)
    viewed = None
    if opened is not None:
        found = found.join(opened.select(F.col("key").alias("path"), "last_opened_ms"), "path", "left")
        viewed = F.col("last_opened_ms")
    created = F.col("ctime_ms") if "ctime_ms" in found.columns else None
    timed = found.withColumn("sort_time", sort_time(order, F.col("mtime_ms"), created, viewed))
    return timed.orderBy(F.desc("sort_time"), "path").limit(limit)


def browse(docs: DataFrame, now_ms: int, kind: str | None = None, limit: int = K.BROWSE_LIMIT, strict: bool = False, **filters) -> DataFrame:
    """Recent documents in buckets. The type filter applies after the cut; ``strict`` applies it before."""
    from ..functions.misc import extension

    test = of_type(kind, extension(F.col("path")), F.col("doc_type")) if kind else F.lit(True)
    found = recent(docs.where(test) if strict else docs, limit, **filters).where(test)
    return group_by_recency(found, now_ms)


def browse_any(docs: DataFrame, catalog: DataFrame, now_ms: int, kind: str | None = None, limit: int = K.BROWSE_LIMIT, **filters) -> DataFrame:
    """As browse(); files of types that are not indexed come from the catalog (path, mtime_ms)."""
    from ..functions.misc import extension

    if kind is None or kind in INDEXED_TYPES:
        return browse(docs, now_ms, kind, limit, **filters)
    return group_by_recency(catalog_recent(catalog, limit, of_type(kind, extension(F.col("path")))), now_ms)


def catalog_recent(catalog: DataFrame, limit: int = K.BROWSE_LIMIT, predicate: Column | None = None) -> DataFrame:
    """The latest files of any type."""
    found = catalog if predicate is None else catalog.where(predicate)
    return found.orderBy(F.desc("mtime_ms"), "path").limit(limit)


def resort(results: DataFrame, order: str, **times) -> DataFrame:
    """Re-orders a fetched result by another order than relevance."""
    if order == "relevance":
        return results.orderBy(F.desc("score"), "path")
    return results.orderBy(F.desc(sort_time(order, F.col("mtime_ms"), **times)), "path")
