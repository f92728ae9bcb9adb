"""Operator 10: importance resampling of a corpus towards a target.

Two bag-of-n-grams models over hashed word unigrams and bigrams are fitted: one of the raw corpus, over all
documents, and one of the target, a bounded sample of labelled rows. A document's importance is the log ratio
of its probabilities under the two. The sample without replacement takes the k documents with
the largest log weight plus Gumbel noise, which is drawn from a hash of the document's id.

Counts are added up inside each task (one vector of ``BUCKETS``) before the shuffle. The k-th
largest key is found by refining a histogram of fixed size, so nothing is sorted or gathered.

Defined cases: a null or empty text has weight zero; null ids draw noise like any other; repeated rows have equal
keys and are taken in the order of ids; without target rows every weight is zero and the sample is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, keyed_texts, materialize, mix64

BUCKETS = 10_000
MAX_TARGET = 20_000
SMOOTHING = 1.0
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word (lower-cased in ASCII) and each pair of neighbours in a row."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~blank
    start[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] |= ~blank[edges]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    # a polynomial over each word's bytes, from its first: blanks count nothing, and the sum starts anew at each word
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data)))) if at[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.append(at, len(data))))])
        value = np.where(blank, np.uint64(0), mix64(lower.astype(np.uint64) + np.uint64(1)) * mix64(place.astype(np.uint64) + np.uint64(7)))
        word = mix64(np.add.reduceat(value, at))
        row = np.searchsorted(offsets, at, "right") - 1
        pair = mix64(word[:-1] * _PAIR + word[1:])
    both = row[:-1] == row[1:]
    n = np.uint64(BUCKETS)
    return np.concatenate([word % n, pair[both] % n]).astype(np.int64), np.concatenate([row, row[:-1][both]])


def counts(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of (raw, target) over all rows of df: (text, target boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            target = np.array(batch.column("target").to_pylist(), bool)
            for lo, hi in chunks(offsets, 1 << 20):
                b, row = buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total[0] += np.bincount(b, minlength=BUCKETS)
                if (wanted := target[lo:hi]).any():
                    total[1] += np.bincount(b[wanted[row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    summed = df.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = summed.orderBy("bucket").toArrow()  # BUCKETS rows
    out = np.zeros((2, BUCKETS), np.int64)
    if got.num_rows:
        at = got.column("bucket").to_numpy()
        out[0, at], out[1, at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def weights(df: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """(key, log_weight, noisy): every row's importance, without and with Gumbel noise. good: (id long), bounded."""
    own = keyed_texts(df, key, text)
    marked = own.join(F.broadcast(good.select("id", F.lit(True).alias("hit"))), F.col("key") == F.col("id"), "left")
    ratio = log_ratio(*counts(marked.select("text", F.coalesce("hit", F.lit(False)).alias("target"))))
    told = df.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets, 1 << 20):
                b, row = buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total = np.bincount(row, weights=told.value[b], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.round(total, 9))], ["key", "log_weight"])

    scored = own.mapInArrow(run, "key long, log_weight double")
    uniform = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))


def top_k(scored: DataFrame, k: int, cells: int = 4096, few: int = 5000) -> DataFrame:
    """The k rows with the largest ``noisy`` (ties: smaller keys) of a written table."""
    low, high = scored.agg(F.min("noisy"), F.max("noisy")).first()
    if k <= 0 or low is None:
        return scored.limit(0)
    above = 0  # rows over ``high`` are taken
    # the k-th row lies in [low, high]
    while low < high:
        width = (high - low) / cells
        cell = F.least(F.floor((F.col("noisy") - low) / width), F.lit(cells - 1)) if width > 0 else F.lit(0)
        inside = scored.where((F.col("noisy") >= low) & (F.col("noisy") <= high))
        got = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(cell.alias("c")).agg(F.count("*"), F.min("noisy"), F.max("noisy")).collect()}
        for c in sorted(got, reverse=True):
            n, c_low, c_high = got[c]
            if above + n >= k:
                break
            above += n
        if (c_low, c_high) == (low, high):
            break
        low, high = c_low, c_high
        if n <= few:
            break
    edge = scored.where((F.col("noisy") >= low) & (F.col("noisy") <= high)).orderBy(F.desc("noisy"), F.col("key").asc_nulls_first()).limit(k - above)
    return scored.where(F.col("noisy") > high).unionByName(edge)


def resample(df: DataFrame, labels: DataFrame, share: float = 0.8, key: str = "doc_id", text: str = "text", label: str = "quality", max_target: int = MAX_TARGET) -> DataFrame:
    """(key, log_weight, noisy) of the sample: ``share`` of the rows. The target are rows labelled 1,
    ``max_target`` of them at most (chosen by a hash of the key)."""
    good = labels.where(F.col(f"`{label}`") == 1).select(F.col(f"`{key}`").cast("long").alias("id")).where("id is not null").distinct()
    part = min(1.0, max_target / max(1, good.count()))
    some = good.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(part * (1 << 20)))
    scored = materialize(weights(df, some, key, text), "weights")
    return top_k(scored, round(share * scored.count()))
