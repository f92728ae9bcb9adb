"""Operator 3: near-duplicates by SimHash fingerprints, linked with vantage-point trees.

Fingerprint: words are runs of anything but ASCII white space, with A-Z lower-cased; each run of
``width`` words, joined by one space, is hashed with XXH64; bit i is set if it is set in over half
of the hashes. Fewer words form one shingle; no word gives fingerprint zero.

Linking: equal fingerprints are one node (named by the smallest key), so copies never form pairs.
A vantage-point tree is fitted on a bounded sample of fingerprints (``sample`` of them at most;
it only steers where rows go, never what is found). Each inner node holds a vantage point and a
radius; a fingerprint belongs to one leaf, its shard, and is also sent as a query to every leaf
that its ball of ``distance`` bits may reach: by the triangle inequality the inner side can be
skipped if d(q, v) - distance > radius and the outer one if d(q, v) + distance <= radius. Inside a
shard the same rule splits further, down to blocks that are compared exactly, and the pairs found
go straight into a union-find, so a shard returns at most one row for each of its rows. Components
across shards are joined by min-hooking and pointer jumping on written tables.

Defined cases: null text is empty; empty texts share fingerprint zero and are linked like any
other; rows with a null key get a fingerprint and a null component; repeated rows and repeated
keys are one node each (rows that share a key share their component).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, keyed_texts, materialize, release

SEED = 42
ONE_TASK = 1 << 18
_SIGN = np.uint64(1 << 63)
# spread[b] has bit i of b in its i-th byte
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """uint64 fingerprint of each text, given as bytes and offsets."""
    n = len(offsets) - 1
    raw = data.tobytes().lower()
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(n, np.int64)
    for d in range(n):
        words = raw[offsets[d] : offsets[d + 1]].split()
        if len(words) <= width:
            grams = [b" ".join(words)] if words else []
        elif width == 3:
            grams = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
        else:
            grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
        counts[d] = len(grams)
        hashes.extend([digest(g, SEED) for g in grams])
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)  # little-endian: byte k has bits 8k..8k+7
    # byte-wide counters hold 255 hashes; sums of those blocks are then added up by document
    starts = np.concatenate(([0], np.cumsum(counts[full])))
    blocks = -(-counts[full] // 255)
    first = np.concatenate(([0], np.cumsum(blocks)))
    at = np.repeat(starts[:-1] - 255 * first[:-1], blocks) + 255 * np.arange(first[-1])
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[h[:, k]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, first[:-1], axis=0)
        bits = (2 * ones > counts[full][:, None]).astype(np.uint64)
        out[full] |= (bits << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key long, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets, 4 << 20):
                fp = fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], ["key", "fp"])

    return keyed_texts(df, key, text).mapInArrow(run, "key long, fp long")


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree. Node i: point[i], radius[i], inner child 2i+1, outer child 2i+2 while
    radius[i] >= 0; else a leaf. Only reached nodes are present."""

    nodes: dict[int, tuple[int, int]]

    @staticmethod
    def fit(sample: np.ndarray, leaf: int, depth: int, seed: int = 1) -> Tree:
        rng, nodes = np.random.default_rng(seed), {}
        todo = [(0, np.unique(sample), 0)]
        while todo:
            i, own, level = todo.pop()
            if level >= depth or len(own) <= leaf:
                continue
            best = None
            for v in own[rng.integers(0, len(own), 5)]:
                d = np.bitwise_count(own ^ v)
                r = int(np.median(d))
                inner = int((d <= r).sum())
                near = int(((d >= r - 1) & (d <= r + 2)).sum())  # rows that both sides would get
                cost = near + abs(2 * inner - len(own)) / 2
                if 0 < inner < len(own) and (best is None or cost < best[0]):
                    best = (cost, int(v), r, d <= r)
            if best is None:
                continue
            nodes[i] = (best[1], best[2])
            todo += [(2 * i + 1, own[best[3]], level + 1), (2 * i + 2, own[~best[3]], level + 1)]
        return Tree(nodes)

    def route(self, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows that may have a neighbour in it, which of them belong to it)."""
        todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            i, rows, own = todo.pop()
            if not len(rows):
                continue
            if i not in self.nodes:
                yield i, rows, own
                continue
            point, radius = self.nodes[i]
            d = np.bitwise_count(fps[rows] ^ np.uint64(point)).astype(np.int64)
            inner, outer = d - reach <= radius, d + reach > radius
            todo.append((2 * i + 1, rows[inner], own[inner] & (d[inner] <= radius)))
            todo.append((2 * i + 2, rows[outer], own[outer] & (d[outer] > radius)))


class Union:
    """Labels of the smallest position that a position is linked to; edges come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def link_shard(fps: np.ndarray, own: np.ndarray, reach: int, small: int = 1 << 18) -> np.ndarray:
    """Positions' labels after all pairs of a member (own) and any row within ``reach`` are united."""
    found = Union(len(fps))
    rng = np.random.default_rng(7)
    todo = [(np.flatnonzero(own), np.arange(len(fps)), 0)]
    while todo:
        members, queries, level = todo.pop()
        if not len(members) or not len(queries):
            continue
        if len(members) * len(queries) > small and level < 24:
            v = fps[members[rng.integers(len(members))]]
            dm = np.bitwise_count(fps[members] ^ v).astype(np.int64)
            r = int(np.median(dm))
            inside = dm <= r
            if 0.2 < inside.mean() < 0.8 or inside.mean() < 1 and level < 8:
                dq = np.bitwise_count(fps[queries] ^ v).astype(np.int64)
                todo.append((members[inside], queries[dq - reach <= r], level + 1))
                todo.append((members[~inside], queries[dq + reach > r], level + 1))
                continue
        step = max(1, (1 << 21) // len(queries))
        for i in range(0, len(members), step):
            part = members[i : i + step]
            a, b = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[queries][None, :]) <= reach)
            found.add(part[a], queries[b])
    return found.label


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, root) from all edges at once."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    edges = pa.Table.from_batches(whole)
    ids, at = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    found = Union(len(ids))
    found.add(at[: edges.num_rows], at[edges.num_rows :])
    moved = np.flatnonzero(found.label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[found.label[moved]])], ["a", "root"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a, root) for each a of edges (a long, b long, b < a): the smallest id reachable.

    Up to ``ONE_TASK`` edges are united in one task, as rounds of jobs would take longer than their work. Else each round hooks every a to its smallest neighbour and turns its other edges into edges
    between smaller ids, until every a has one edge left: a forest with the same components.
    Pointer jumping then takes each node to its root. All rounds work on written tables.
    """
    rest = materialize(edges.where("b < a").select("a", "b").distinct(), label, few=True)
    if rest.count() <= ONE_TASK:
        found = materialize(rest.coalesce(1).mapInArrow(_united, "a long, root long"), label)
        release(rest)
        return found
    while True:
        hooks = materialize(rest.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("n")), label, few=True)
        if hooks.where("n > 1").isEmpty():
            found = jump(hooks.select("a", "p"), label)
            release(rest)
            release(hooks)
            return found
        lower = rest.join(hooks, "a").where("b > p").select(F.col("b").alias("a"), F.col("p").alias("b"))
        less = materialize(hooks.select("a", F.col("p").alias("b")).unionByName(lower).distinct(), label, few=True)
        release(rest)
        release(hooks)
        rest = less


def jump(parents: DataFrame, label: str) -> DataFrame:
    parents = materialize(parents, label, few=True)
    while True:
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("g"))
        nxt = materialize(parents.join(up, "p", "left").select("a", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), label, few=True)
        release(parents)
        parents = nxt.select("a", "p")
        if nxt.where("moved").isEmpty():
            return parents.select("a", F.col("p").alias("root"))


def link(nodes: DataFrame, distance: int = 2, sample: int = 1 << 16, leaf: int = 4096) -> DataFrame:
    """(id, root) of linked nodes only. nodes: (id long, fp long), one row a fingerprint."""
    spark: SparkSession = nodes.sparkSession
    n = nodes.count()
    if n < 2:
        return spark.createDataFrame([], "a long, root long")
    share = min(1.0, 0.9 * sample / n)
    picked = nodes.select("fp").where(F.lit(share == 1.0) | (F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))))
    fitted = np.array([r[0] for r in picked.collect()], np.int64)[:sample].view(np.uint64)
    tree = Tree.fit(fitted, max(2, int(leaf * share)), max(0, int(np.ceil(np.log2(max(1, n / leaf)))) + 2))
    told = spark.sparkContext.broadcast(tree)  # at most 2 * sample / leaf-share nodes: bounded by the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            for shard, rows, own in told.value.route(fps, distance):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int64)), pa.array(ids[rows]), pa.array(fps[rows].view(np.int64)), pa.array(own)], ["shard", "id", "fp", "own"])

    def search(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        fps = group.column("fp").to_numpy()[by].view(np.uint64)
        label = link_shard(fps, group.column("own").to_numpy()[by], distance)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    routed = nodes.select("id", "fp").mapInArrow(route, "shard long, id long, fp long, own boolean")
    edges = routed.groupBy("shard").applyInArrow(search, "a long, b long")
    return components(edges)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2, width: int = 3) -> DataFrame:
    """(key, fp long, component long) for every row of df."""
    prints = materialize(fingerprint(df, key, text, width), "fingerprints")
    nodes = materialize(prints.where("key is not null").groupBy("fp").agg(F.min("key").alias("id")), "nodes", few=True)
    roots = link(nodes, distance)
    named = nodes.join(roots, nodes["id"] == roots["a"], "left").select("fp", F.coalesce("root", "id").alias("component"))
    return prints.join(named, "fp", "left").select(
        "key", "fp", F.when(F.col("key").isNotNull(), F.col("component")).alias("component")
    )
