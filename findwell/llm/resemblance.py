"""Near-duplicates by resemblance, for the pipeline: Jaccard similarity of word shingles of ``least`` or more.

Words are runs of anything but ASCII white space, with A-Z lower-cased; each run of ``width`` words is a shingle; fewer words
form one. Two texts are near-duplicates if their sets of shingles (as 64-bit hashes) have a Jaccard similarity of 0.8 or more.
On SimHash fingerprints of 64 bits such pairs differ in ten bits on average, and a ball that covers them reaches nearly every
shard. So the vantage-point trees of ``simhash`` give the candidates within their two bits, MinHash those beyond, and each is confirmed on
the sets themselves:

1. Texts of equal sets are one node. Of each node ``BANDS`` bands of ``ROWS`` minima are taken; a pair of similarity 0.8
   shares no band with probability (1 - 0.8**4)**24, 3 in a million.
2. The nodes of each band are compared with the least of them, and each with the least of its SimHash component. Confirmed pairs
   give components.
3. Bands of three or more nodes that are still in different components get all their pairs counted, through postings of
   the shingles in the band. A band returns at most one edge a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, materialize, mix64, release
from . import simhash
from .simhash import Union, components
from .suffix_dedup import BLOCK, word_hashes

WIDTH = 5
LEAST = (4, 5)  # 0.8
BANDS, ROWS = 24, 4
_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their n+1 offsets."""
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    h, at = word_hashes(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    place, last = np.arange(len(h)), at[1:][doc] if len(h) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = h.copy()
        for i in range(1, width):
            inside = np.flatnonzero(place + i < last)
            total[inside] += mix64(h[inside + i] + np.uint64(i))
        total = mix64(total)
    whole = (place + width <= last) | (place == at[:-1][doc])
    total, doc = total[whole], doc[whole]
    by = np.lexsort((total, doc))
    total, doc = total[by], doc[by]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    total, doc = total[new], doc[new]
    return total, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's own hash (its node), and the keys of its bands [set, BANDS]."""
    n = len(at) - 1
    node, bands = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return node, bands
    first = at[:-1][full]
    with np.errstate(over="ignore"):
        node[full] = mix64(np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first))
        for b in range(BANDS):
            key = np.full(len(full), b + 1, np.uint64)
            for odd in _ODD[b * ROWS : (b + 1) * ROWS]:
                key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(h * odd, first))
            bands[full, b] = key
    return node, bands


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        for lo, hi in chunks(offsets, BLOCK):
            yield (batch.column(0).slice(lo, hi - lo), *shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, h, at in _each(batches):
        node, bands = signatures(h, at)
        ends = pa.array(np.where(np.diff(at) > 0, BANDS, 0).cumsum(), pa.int32())
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pa.array(bands[np.diff(at) > 0].reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([row, pa.array(node.view(np.int64)), lists], ["row", "id", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for node, h, at in _each(batches):
        yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], ["id", "shingles"])


def joined(flat: np.ndarray, begin: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels (positions) of the sets flat[begin[i] : begin[i + 1]] after all pairs that are similar enough, and those of
    equal labels before, are united."""
    n, size = len(begin) - 1, np.diff(begin)
    found = Union(n)
    _, first, kind = np.unique(labels, return_index=True, return_inverse=True)
    found.add(np.arange(n), first[kind])
    _, kind, many = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(kind, kind="stable")
    posting, start = owner[order], np.concatenate(([0], np.cumsum(many)))
    for i in range(n):
        if (found.label == found.label[i]).all():
            continue
        own = kind[begin[i] : begin[i + 1]]
        own = own[many[own] > 1]
        count = many[own]
        at = np.repeat(start[own] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        both = np.bincount(posting[at], minlength=n)
        near = np.flatnonzero(LEAST[1] * both >= LEAST[0] * (size + size[i] - both))
        found.add(np.full(len(near), i), near)
    return found.label


def _band(group: pa.Table) -> pa.Table:
    group = group.sort_by("id").combine_chunks()
    ids, sets = group.column("id").to_numpy(), group.column("shingles").combine_chunks()
    begin = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(sets).to_numpy(), dtype=np.int64)))
    label = joined(sets.flatten().to_numpy(), begin, group.column("root").to_numpy())
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"a": ids[moved], "b": ids[label[moved]]})


def fingerprint_pairs(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, a_row, b, b_row): nodes and the least row of their SimHash component, where that is another node."""
    linked = simhash.near_duplicates(texts, "row", "text", width=WIDTH).where("key <> component").select("key", "component").distinct()
    nodes = prints.select("row", "id").distinct()
    a = linked.join(nodes.select(F.col("row").alias("key"), F.col("id").alias("a")), "key")
    both = a.join(nodes.select(F.col("row").alias("component"), F.col("id").alias("b")), "component").where("a <> b")
    return both.groupBy("a", "b").agg(F.min("key").alias("a_row"), F.min("component").alias("b_row"))


def near_duplicates(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, component) for every row of df; rows: any long, equal ones have equal texts."""
    texts = df.select(F.col(row).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    prints = materialize(texts.mapInArrow(_prints, "row long, id long, bands array<long>"), "resemblance")
    nodes = materialize(prints.groupBy("id").agg(F.min_by("bands", "row").alias("bands"), F.min("row").alias("row")), "nodes", few=True)
    keyed = nodes.select("id", "row", F.explode("bands").alias("band"))
    # bands of the same nodes (by their number, least and exclusive or) are one; no band's nodes are gathered for that
    groups = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("b"), F.bit_xor("id").alias("mark")).where("n > 1")
    bands = materialize(groups.groupBy("n", "b", "mark").agg(F.min("band").alias("band")), "bands", few=True)
    flat = materialize(keyed.join(bands.drop("mark"), "band"), "members")
    close = materialize(fingerprint_pairs(texts, prints), "close", few=True)
    ends = [close.select(F.col(x).alias("id"), F.col(f"{x}_row").alias("row")) for x in ("a", "b")]
    needed = flat.select("id", "row").unionByName(ends[0]).unionByName(ends[1]).groupBy("id").agg(F.min("row").alias("row"))
    found = texts.join(needed.hint("shuffle_hash"), "row").select("id", "text").mapInArrow(_sets, "id long, shingles array<long>")
    sets = materialize(found.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")
    pairs = flat.where("id <> b").select(F.col("id").alias("a"), "b").unionByName(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(other, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    near = materialize(both.where(LEAST[1] * F.col("n") >= LEAST[0] * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b"), "near")
    met = components(near)
    # bands whose nodes have not all met
    labelled = flat.where("n > 2").select("band", "id").join(met, flat["id"] == met["a"], "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    apart = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    rest = labelled.join(apart, "band").join(sets, "id").groupBy("band").applyInArrow(_band, "a long, b long")
    roots = components(near.unionByName(rest))  # it has read all that it needs
    for done in (nodes, bands, flat, close, sets, near):
        release(done)
    return prints.join(roots, prints["id"] == roots["a"], "left").select("row", F.coalesce("root", "id").alias("component"))
