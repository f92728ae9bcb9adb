"""Operator 1: benchmark decontamination with the q-gram lemma.

An item of m characters (lower-cased, white space collapsed) leaks into a document if some stretch
of the document is within e = floor(rate * m) edits of it. By the q-gram lemma such a stretch shares at least
t = m + 1 - q - q * e of the item's q-grams with it, and all of those lie on at most e + 1
neighbouring diagonals (document position minus item position). Diagonals are therefore
cut into bands of 2 * (e + 1) that overlap by half, so some band holds all of them; the shared
q-grams are counted per (document, item, band), bands that reach t are kept, and their regions
are verified by a banded alignment. The filter has no false negatives, and nothing is capped.

The items are the query set: they are taken in blocks of bounded size, each block's q-gram index is
broadcast, and every document is scanned against it, without a shuffle of the documents.

Defined cases: null texts and items are empty; an empty item never matches; items too short for a
q-gram match verbatim; repeated items and rows give repeated matches; a null key is passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keyed_texts, materialize, mix64

Q = 9
RATE = 0.08
BITS = 22
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 4 << 20  # about 80 MB for each worker: 20 bytes a q-gram
EXPANDED = 1 << 21
SCHEMA = "key long, item long, start long, stop long, edits int"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of each q-gram."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = mix64(points[:n].astype(np.uint64) + np.uint64(1)) if q == 1 else points[:n].astype(np.uint64)
        for i in range(1, q):
            h = h * _BASE + points[i : n + i]
        return h * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """q-grams of a block of items: sorted distinct hashes, and for each the (item, position) pairs."""

    q: int
    ids: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    edits: np.ndarray = None
    need: np.ndarray = None
    short: list[int] = field(default_factory=list)

    @staticmethod
    def build(items: list[tuple[int, str]], q: int, rate: float) -> Index:
        x = Index(q, [i for i, _ in items], [normalise(t) for _, t in items])
        size = np.array([len(t) for t in x.texts], np.int64)
        x.edits = np.maximum(0, np.minimum((rate * size).astype(np.int64), (size - q) // q))
        x.need = size + 1 - q - q * x.edits
        x.short = [i for i, n in enumerate(size) if 0 < n < q]
        each = [grams(codes(t), q) for t in x.texts]
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(each)), [len(g) for g in each])
        pos = np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, np.int64)
        by = np.argsort(h, kind="stable")
        h, x.item, x.pos = h[by], item[by].astype(np.int32), pos[by].astype(np.int32)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        x.hashes = h[new]
        x.first = np.append(np.flatnonzero(new), len(h)).astype(np.int32)
        x.filter = np.zeros(1 << BITS, bool)
        x.filter[(x.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return x


def align(item: np.ndarray, region: np.ndarray, edits: int, slack: int) -> tuple[int, int, int] | None:
    """Best (start, stop, edits) of item in region, ends free, at most ``edits``; only cells on
    diagonals 0..slack (region position minus item position) of the parallelogram are filled."""
    m, wide = len(item), slack + 1
    far = m + edits + wide
    padded = np.concatenate([region, np.full(max(0, m + wide - len(region)), np.uint32(0xFFFFFFFF))])
    step = np.arange(wide)
    cost, origin = np.zeros(wide, np.int64), step.copy()
    for i in range(m):
        diagonal = cost + (padded[i : i + wide] != item[i])
        up, up_from = np.append(cost[1:] + 1, far), np.append(origin[1:], 0)
        take = up < diagonal
        cost, origin = np.where(take, up, diagonal), np.where(take, up_from, origin)
        # gaps along the row: the best of all earlier diagonals plus their distance
        shifted = cost - step
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, step, 0))
        source = np.where(shifted == best, step, source)
        origin = origin[source]
        cost = best + step
        if cost.min() > edits:
            return None
    stop = step + m
    cost = np.where(stop <= len(region), cost, far)
    k = int(np.argmin(cost))
    return (int(origin[k]), int(stop[k]), int(cost[k])) if cost[k] <= edits else None


def search(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, stop, edits), positions in the normalised text; the best match for each pair."""
    q, found = index.q, []
    if not texts:
        return found
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    for k in index.short:
        for d, t in enumerate(texts):
            if (at := t.find(index.texts[k])) >= 0:
                found.append((d, k, at, at + len(index.texts[k]), 0))
    points = codes("".join(texts))
    h = grams(points, q)
    maybe = np.flatnonzero(index.filter[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(maybe) or not len(index.hashes):
        return found
    slot = np.searchsorted(index.hashes, h[maybe])
    slot[slot == len(index.hashes)] = 0
    real = index.hashes[slot] == h[maybe]
    maybe, slot = maybe[real], slot[real]
    doc = np.searchsorted(begin, maybe, "right") - 1
    inside = maybe + q <= begin[doc + 1]
    maybe, slot, doc = maybe[inside], slot[inside], doc[inside]
    many = index.first[slot + 1] - index.first[slot]
    if not many.sum():
        return found
    shift = int(max(len(t) for t in index.texts))
    wide = int(size.max()) + 2 * shift + 2
    # one row for each shared q-gram, some at a time: q-grams that many items have are expanded in bounded memory
    keys, counts = [], []
    total = np.cumsum(many)
    lo = 0
    while lo < len(maybe):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + EXPANDED, "right")))
        own = many[lo:hi]
        row = np.repeat(np.arange(lo, hi), own)
        post = np.repeat(index.first[slot[lo:hi]] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(len(row))
        item = index.item[post]
        diagonal = (maybe - begin[doc])[row] - index.pos[post] + shift  # never negative
        band = diagonal // (index.edits[item] + 1)
        key = (doc[row] * len(index.ids) + item) * wide + band
        # a shared q-gram counts in its band and in the one before, which reaches half into it
        key, count = np.unique(np.concatenate([key, (key - 1)[band > 0]]), return_counts=True)
        keys.append(key)
        counts.append(count)
        lo = hi
    key, slot = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(slot, weights=np.concatenate(counts)).astype(np.int64)
    pair, band = key // wide, key % wide
    kept = count >= index.need[pair % len(index.ids)]
    best: dict[int, tuple[int, int, int]] = {}
    for p, b in zip(pair[kept].tolist(), band[kept].tolist()):
        d, k = divmod(p, len(index.ids))
        if best.get(p, (0, 0, 1))[2] == 0:
            continue
        e, m = int(index.edits[k]), len(index.texts[k])
        first = b * (e + 1) - shift - e
        lo = max(0, first)
        region = texts[d][lo : (b + 2) * (e + 1) - shift + m + e]
        if (at := region.find(index.texts[k])) >= 0:
            hit = (at, at + m, 0)
        else:
            # what the region lacks before the text is filled, so that diagonals before it exist for an item whose head is cut;
            # an item's character set against the filling costs one edit, as if it were missing
            fill = np.full(lo - first, 0xFFFFFFFF, np.uint32)
            hit = align(codes(index.texts[k]), np.concatenate([fill, codes(region)]), e, max(0, len(fill) + len(region) - m + e))
            hit = hit and (max(0, hit[0] - len(fill)), hit[1] - len(fill), hit[2])
        if hit and (p not in best or hit[2] < best[p][2]):
            best[p] = (lo + hit[0], lo + hit[1], hit[2])
    return found + [(*divmod(p, len(index.ids)), *v) for p, v in best.items()]


def search_rows(texts: list[str | None], index: Index, each: int = 1 << 20) -> Iterator[tuple[int, int, int, int, int]]:
    """search() over a batch of raw texts, some at a time."""
    some, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        some.append(normalise(t or ""))
        size += len(some[-1])
        if size > each or i + 1 == len(texts):
            yield from ((lo + d, k, a, b, e) for d, k, a, b, e in search(some, index))
            some, lo, size = [], i + 1, 0


def _without(told, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            good[[d for d, *_ in search_rows(batch.column(at).to_pylist(), told.value)]] = False
            yield batch.filter(pa.array(good))

    return run


def _scan(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = told.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = [(keys[d], index.ids[k], a, b, e) for d, k, a, b, e in search_rows(batch.column(1).to_pylist(), index)]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "item", "start", "stop", "edits"])

    return run


def blocks(items: DataFrame, item_key: str, item_text: str, q: int, rate: float, block_items: int, block_chars: int) -> Iterator[Index]:
    """Indexes of the items, in blocks of at most ``block_items`` and about ``block_chars``."""
    block, size = [], 0
    for r in keyed_texts(items, item_key, item_text).where("trim(text) <> ''").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= block_items or size >= block_chars:
            yield Index.build(block, q, rate)
            block, size = [], 0
    if block:
        yield Index.build(block, q, rate)


def leaks(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, item, start, stop, edits): each document and each item that occurs in it within its edit budget.

    What is broadcast is one block of items; the documents are scanned once for each block. Of several blocks each is
    done, written and taken back before the next one is sent out.
    """
    spark = df.sparkSession
    parts = [f(keyed_texts(df, key, text)) for f in _rounds(spark, blocks(items, item_key, item_text, q, rate, block_items, block_chars), lambda told: lambda own: own.mapInArrow(_scan(told), SCHEMA))]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def _rounds(spark: SparkSession, indexes: Iterator[Index], step) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function of a DataFrame for each block; a single block is left lazy."""
    own = next(indexes, None)
    alone = True
    while own is not None:
        told, own = spark.sparkContext.broadcast(own), next(indexes, None)
        alone = alone and own is None

        def run(df: DataFrame, told=told, lazy=alone) -> DataFrame:
            out = step(told)(df)
            if lazy:
                return out
            out = materialize(out, "block")
            told.destroy()
            return out

        yield run


def clean(
    df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """df's own rows and columns, without the documents that hold an item: one scan a block of items, no shuffle."""
    names, at = df.columns, df.columns.index(text)
    out = df.toDF(*[f"c{i}" for i in range(len(names))])
    indexes = blocks(items, item_key, item_text, q, rate, block_items, block_chars)
    for f in _rounds(df.sparkSession, indexes, lambda told: lambda own: own.mapInArrow(_without(told, at), own.schema)):
        out = f(out)
    return out.toDF(*names)
