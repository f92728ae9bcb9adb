"""Incremental index maintenance from a stream of change events.

The store is a folder of segments. Each micro-batch writes one segment (its documents, postings and tombstones)
under its batch id, so a replayed batch overwrites its own output and nothing is applied twice. A
reader unions the segments; compaction rewrites them as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, append, assign_ids, compact, load, save, stats_of, write_relations
from ..sources.stored import release

DOCUMENT = "path string, basename string, mtime_ms long, size long, doc_type string, body string"
EVENT = "seq long, kind string, old_path string, " + DOCUMENT
SPAN = 1 << 40  # ids of a segment start at (batch + 1) * SPAN


def expand_renames(events: DataFrame) -> DataFrame:
    """A rename is a deletion of the old path and a change of the new one."""
    gone = events.where("kind = 'rename'").withColumn("path", F.col("old_path")).withColumn("kind", F.lit("delete"))
    new = events.withColumn("kind", F.when(F.col("kind") == "rename", "modify").otherwise(F.col("kind")))
    return new.unionByName(gone)


def last_event_wins(events: DataFrame, by: str = "path", order: str = "seq") -> DataFrame:
    """The latest event of each path."""
    latest = Window.partitionBy(by).orderBy(F.desc(order), F.desc("kind"))
    return events.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def debounced(events: DataFrame, by: str = "path", time: str = "ts", quiet: str = "400 milliseconds") -> DataFrame:
    """Bursts of events of a path, parted by a quiet time; the last event of each burst. Works on streams with a watermark."""
    fields = F.struct(*[c for c in events.columns if c != by])
    bursts = events.groupBy(by, F.session_window(time, quiet)).agg(F.max_by(fields, F.col(time)).alias("e"), F.count("*").alias("n_events"))
    return bursts.select(by, "n_events", "e.*")


def write_segment(events: DataFrame, batch: int, path: str) -> None:
    """Applies one micro-batch of change events."""
    final = last_event_wins(expand_renames(events)).persist()
    changed = final.where("kind <> 'delete'").drop("seq", "kind", "old_path")
    numbered = assign_ids(changed, F.col("path"), base=(batch + 1) * SPAN)
    write_relations(numbered, f"{path}/docs/batch={batch}", f"{path}/postings/batch={batch}", ordered=False)
    final.select("path").write.mode("overwrite").parquet(f"{path}/tombstones/batch={batch}")
    final.unpersist()
    release(numbered)


def start(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs the feed; without ``every`` it handles what is there and stops."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write_segment(df, batch, path))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str, base: Index | None = None) -> Index:
    """The index of all segments over an optional base: a path's later segment hides earlier ones."""
    docs = spark.read.parquet(f"{path}/docs")
    dead = spark.read.parquet(f"{path}/tombstones").groupBy("path").agg(F.max("batch").alias("__last"))
    marked = docs.join(dead, "path", "left").withColumn("deleted", F.coalesce(F.col("batch") < F.col("__last"), F.lit(False))).drop("batch", "__last")
    postings = spark.read.parquet(f"{path}/postings").drop("batch")
    from ..operators.index import dictionary_of

    columns = base.docs.columns if base else [c for c in marked.columns]
    own = Index(marked.select(*columns), postings, dictionary_of(postings), stats_of(marked))
    if base is None:
        return own
    hidden = base.docs.join(dead, "path", "left").withColumn("deleted", F.col("deleted") | F.col("__last").isNotNull()).select(*columns)
    return append(Index(hidden, base.postings, base.dictionary, base.stats), own)


def fold_segments(spark: SparkSession, path: str, target: str, base: Index | None = None) -> Index | None:
    """Compacts base and segments into a saved index."""
    dense = compact(current(spark, path, base))
    save(dense, target)
    release(dense.docs)
    return load(spark, target)


def settled(events: DataFrame) -> DataFrame:
    """The last event of each path of a backlog, renames taken apart: what is applied once the index is ready."""
    return last_event_wins(expand_renames(events))


def apply_to_catalog(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """The file catalog (path, mtime_ms, and others) after change events: touched paths leave, those that exist now come back."""
    final = settled(events)
    stays = catalog.join(final.select("path"), "path", "left_anti")
    return stays.unionByName(final.where("kind <> 'delete'").select(*[c for c in catalog.columns if c in final.columns]), allowMissingColumns=True)


@dataclass
class SavePolicy:
    """When a changed index is written: after ``quiet_s`` without a change, and ``cap_s`` after the first unsaved one at the
    latest. One write at a time; changes during a write start a new wait."""

    quiet_s: float = 60.0
    cap_s: float = 300.0
    first: float | None = None
    last: float | None = None
    saving: bool = False

    def changed(self, now: float) -> None:
        self.first = now if self.first is None else self.first
        self.last = now

    @property
    def due(self) -> float | None:
        """When to save; None if nothing is unsaved or a save is under way."""
        if self.first is None or self.saving:
            return None
        return min(self.last + self.quiet_s, self.first + self.cap_s)

    def begin(self, now: float) -> bool:
        """Whether a save begins now."""
        if self.due is None or now < self.due:
            return False
        self.saving, self.first, self.last = True, None, None
        return True

    def done(self) -> None:
        self.saving = False


def opens(events: DataFrame, key: str = "path", time_ms: str = "ts_ms", prefix: str = "") -> DataFrame:
    """Usage statistics: (key, count, last_opened_ms). On a stream this is a stateful aggregate in update mode."""
    named = F.concat(F.lit(prefix), F.col(key)) if prefix else F.col(key)
    return events.groupBy(named.alias("key")).agg(F.count("*").alias("count"), F.max(time_ms).alias("last_opened_ms"))


def start_opens(events: DataFrame, path: str, checkpoint: str, key: str = "path", time_ms: str = "ts_ms", every: str | None = None) -> StreamingQuery:
    """Keeps the statistics as a table: each micro-batch writes the keys it changed, readers take each key's last."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = opens(events, key, time_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_opens(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("key").agg(F.max_by("count", "batch").alias("count"), F.max_by("last_opened_ms", "batch").alias("last_opened_ms"))


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs of a superseded query, which was started under spark.addTag(tag)."""
    spark.interruptTag(tag) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobsWithTag(tag)
