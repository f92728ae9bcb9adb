"""Operator 5: exact long repeats, found with a logarithmic family of suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus, the same document included. Matches never cross documents.

1. Anchors. Of each window of ``length - seed + 1`` successive ``seed``-byte strings the one with
   the smallest hash is the window's anchor (all of them, where several tie). Equal ``length``-byte strings have
   equal anchors at equal offsets, so repeats can be found from about one suffix in 170.
2. Suffix arrays. Suffixes from anchors are dealt out by their first ``seed`` bytes. Each shard
   takes them in batches: a batch gets a (sparse) suffix array, is merge-scanned against every level of
   the shard's family for suffixes that share the first ``seed`` bytes or more, and becomes a level;
   levels of equal size are merged, so n suffixes are kept in O(log n) arrays. A level keeps one suffix of
   each kind, and what has been reported is let go, so copies cost no memory. This yields the anchors that occur more than once.
3. Exact check. Only for these anchors the bytes around them are fetched. The offsets that an
   anchor may have in a string are one section, or ``HOT_PARTS`` of them for the few anchors with more than one place in
   ``HOT_SHARE``. All strings of a section share the bytes from its least offset before the anchor to
   where its largest ends, and are dealt out by a hash of them. So the places of a very common line
   fall apart into groups by what stands around it. In a group all ``length``-byte strings
   of the same offset are compared through 64-bit hashes, column by column, so a
   group of m costs m log m and never m * m. Equal contexts are collapsed before the shuffle, with
   their places.
4. The covered ranges are unioned per document and cut out.

Defined cases: null text is empty; texts shorter than ``length`` are left alone. A row is known by a 64-bit
hash of key and text, so null keys and keys that several rows share are no special case, and a repeated row
is a copy like any other. Text out of ``dedup_text`` stays valid UTF-8: bytes of a character that was
cut through are dropped with it.

Passages by words (``words``): a passage counts by its words, runs of anything but ASCII white space, however short they are, and the white space
between them does not matter. Steps 1 and 2 are the same with words in the place of bytes: of each window of ``words`` words
the least hash of its strings of ``SEED_WORDS`` words is the anchor, and the heads of suffixes are these hashes. In step 3 no contexts travel but
the 64-bit hashes of the windows, each once, with its anchor; those of frequent anchors are dealt out by their own hash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, gives_back, keyed_texts, materialize, mix64

LENGTH = 400
SEED = 64
BLOCK = 1 << 18
PART_BYTES = 256 << 20
HOT_SHARE = 1000
HOT_PARTS = 8
WORDS = 51
SEED_WORDS = 10
HEAD = 10  # 64 bits, seven a byte
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, mod 2**64, for i < n."""
    if len(_power[0]) < n:
        size = max(n, 2 * len(_power[0]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _power[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_BASE, inverse)]
    return _power[0][:n], _power[1][:n]


_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size``-byte string (one for each start that fits): a polynomial over scrambled bytes,
    from prefix sums."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * power, out=total[1:])
        return (total[size:] - total[:-size]) * inverse[:n]


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` successive values."""
    f, step = np.minimum if least else np.maximum, 1
    while 2 * step <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """Starts (in data) of the anchors of all ``length``-byte windows within one document each."""
    width = length - seed + 1
    h = (rolling(data, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = sliding(h, width, True)
    # a position is an anchor if it equals the minimum of some whole window that holds it
    top = np.zeros(len(low) + 2 * (width - 1), np.uint32)
    top[width - 1 : width - 1 + len(low)] = low
    for cut in offsets[1:-1].tolist():  # windows across two documents count for nothing
        top[max(width - 1, cut - length + width) : cut + width - 1] = 0
    hit = sliding(top, width, False)[: len(h)] == h
    return np.flatnonzero(hit)


class Family:
    """Levels of suffix arrays over fixed-width suffix heads, merged geometrically."""

    def __init__(self, base: int = 1 << 14):
        self.base = base
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []  # heads in order, row ids, already reported

    def add(self, heads: np.ndarray, rows: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Takes a batch (many: the row stands for several places); returns rows (of this and of
        earlier batches) not yet reported whose head occurs again."""
        order = np.argsort(heads, kind="stable")
        heads, rows, many = heads[order], rows[order], many[order]
        first = np.ones(len(heads), bool)
        first[1:] = heads[1:] != heads[:-1]
        last = np.ones(len(heads), bool)
        last[:-1] = first[1:]
        again = ~(first & last) | many  # within the batch
        told = []
        for level in self.levels:
            if level is None:
                continue
            known, ids, said = level
            at = np.searchsorted(known, heads)
            at[at == len(known)] = 0
            same = known[at] == heads if len(known) else np.zeros(len(heads), bool)
            again |= same
            met = np.unique(at[same])
            met = met[~said[met]]
            said[met] = True
            told.append(ids[met])
            first &= ~same  # its kind is in the family already
        out = np.concatenate([rows[again], *told]) if told else rows[again]
        self._insert((heads[first], rows[first], again[first]))
        return out

    def _insert(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Level i holds up to base * 2**i suffixes; two of the same level become one of the next."""
        while len(new[0]):
            i = max(0, int(np.ceil(np.log2(len(new[0]) / self.base)))) if len(new[0]) > self.base else 0
            while len(self.levels) <= i:
                self.levels.append(None)
            old, self.levels[i] = self.levels[i], None
            if old is None:
                self.levels[i] = new
                return
            heads = np.concatenate([old[0], new[0]])
            order = np.argsort(heads, kind="stable")  # two sorted runs: a merge
            new = (heads[order], np.concatenate([old[1], new[1]])[order], np.concatenate([old[2], new[2]])[order])


def _anchor_rows(length: int, seed: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets, BLOCK):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                spots = anchors(own, at, length, seed)
                if not len(spots):
                    continue
                doc = np.searchsorted(at, spots, "right") - 1
                # equal heads of a block travel as one row with all their places. Bytes are shifted by one, as numpy's
                # strings lose zeros at their end and UTF-8 has no 0xFF
                heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, seed)[spots]) + np.uint8(1)
                kinds, kind, many = np.unique(heads.view(f"S{seed}")[:, 0], return_inverse=True, return_counts=True)
                by = np.argsort(kind, kind="stable")
                ends = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
                rows = batch.column(0).take(pa.array(lo + doc[by]))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(seed), len(kinds), [None, pa.py_buffer(kinds)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [packed, pa.ListArray.from_arrays(ends, rows), pa.ListArray.from_arrays(ends, pa.array((spots - at[doc])[by]))], ["head", "rows", "spots"]
                )

    return run


def named(data: bytes, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(data, seed) - (1 << 63)


def _family_scan(seed: int):
    def told(own: pa.ListArray, where: pa.ListArray, kinds: np.ndarray) -> pa.RecordBatch:
        many = pa.compute.list_value_length(own).to_numpy()
        return pa.RecordBatch.from_arrays([own.flatten(), where.flatten(), pa.array(np.repeat(kinds, many))], ["row", "pos", "head"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken, begin = Family(), [], [0]
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = as_bytes(batch.column(0))[0].view(f"S{seed}")
            rows, spots = batch.column(1), batch.column(2)
            kinds = np.array([named(x) for x in batch.column(0).to_pylist()], np.int64)
            found = family.add(heads, np.arange(begin[-1], begin[-1] + len(heads)), pa.compute.list_value_length(rows).to_numpy() > 1)
            now = np.sort(found[found >= begin[-1]] - begin[-1])
            found = np.sort(found[found < begin[-1]])
            if len(now):
                yield told(rows.take(pa.array(now)), spots.take(pa.array(now)), kinds[now])
            which = np.searchsorted(begin, found, "right") - 1
            for w in np.unique(which):
                places, own, where, names = taken[w]
                at = np.searchsorted(places, found[which == w] - begin[w])
                yield told(own.take(pa.array(at)), where.take(pa.array(at)), names[at])
            # only what has not been reported may be asked for later
            left = np.delete(np.arange(len(heads)), now)
            taken.append((left, rows.take(pa.array(left)), spots.take(pa.array(left)), kinds[left]))
            begin.append(begin[-1] + len(heads))

    return run


def sections(length: int, seed: int) -> list[tuple[int, int]]:
    """Half-open ranges of the offset of an anchor within a string: first the whole one, then ``HOT_PARTS`` that divide it."""
    edges = [i * (length - seed + 1) // HOT_PARTS for i in range(HOT_PARTS + 1)]
    return [(0, length - seed + 1)] + [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _contexts(length: int, seed: int, hot):
    """For (row, text, spots): per section (the whole range, or the parts for heads in hot), the bytes around each spot, equal ones of the batch with all their
    places. The key is a hash of those bytes that all strings of the section share."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[bytes, int, int, int], list[tuple[int, int]]] = {}
            data, offsets = as_bytes(batch.column("body"))
            raw = memoryview(data)  # no copy of the batch
            at, every = offsets.tolist(), list(enumerate(sections(length, seed)))
            for d, (row, spots) in enumerate(zip(batch.column("row").to_pylist(), batch.column("spots").to_pylist())):
                begin, end = at[d], at[d + 1]
                for s in spots or ():
                    p = begin + s
                    often = bool(hot.value) and named((data[p : p + seed] + np.uint8(1)).tobytes()) in hot.value  # heads are named as they travelled, shifted by one
                    for k, (a, b) in every[1:] if often else every[:1]:
                        if s < a or p + length - b + 1 > end:
                            continue  # no string of the section fits into the document
                        lo = max(begin, p - b + 1)
                        key = named(raw[p - a : p + length - b + 1], k)
                        found.setdefault((bytes(raw[lo : min(end, p - a + length)]), p - lo, k, key), []).append((row, s))
            rows, pos, n = [], [], [0]
            for places in found.values():
                rows += [r for r, _ in places]
                pos += [s for _, s in places]
                n.append(len(rows))
            at32 = pa.array(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[3] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.binary()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.ListArray.from_arrays(at32, pa.array(rows, pa.int64())), pa.ListArray.from_arrays(at32, pa.array(pos, pa.int64())),
                ],
                ["key", "section", "context", "left", "rows", "spots"],
            )

    return run


def matched(
    contexts: list[bytes], left: np.ndarray, copies: np.ndarray, group: np.ndarray, length: int, section: tuple[int, int], cells: int = 1 << 21
) -> np.ndarray:
    """bool [context, offset - section[0]]: whether the ``length``-byte string that has the context's anchor at that
    offset occurs twice or more in the context's group, counting each context ``copies`` times."""
    reach, m, wide = section[1] - 1, len(contexts), section[1] - section[0]
    size = np.array([len(c) for c in contexts])
    grid = np.zeros((m, wide + length - 1), np.uint8)
    for i, (c, o) in enumerate(zip(contexts, left.tolist())):
        grid[i, reach - o : reach - o + len(c)] = np.frombuffer(c, np.uint8)
    power, _ = _powers(grid.shape[1])
    salt = mix64(group.astype(np.uint64) + np.uint64(1))[:, None]
    hit = np.zeros((m, wide), bool)
    # the string of offset o starts at column reach - o; columns are taken in blocks, to bound memory
    span = max(1, min(wide, cells // m))
    for c0 in range(0, wide, span):
        column = np.arange(c0, min(c0 + span, wide))
        h = np.empty((m, len(column)), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, m, 512):
                part = grid[lo : lo + 512, c0 : c0 + len(column) + length - 1]
                total = np.zeros((len(part), part.shape[1] + 1), np.uint64)
                np.cumsum(_TABLE[part] * power[: part.shape[1]], axis=1, out=total[:, 1:])
                h[lo : lo + 512] = total[:, length:] - total[:, :-length]
            # strings of one hash are compared within their group and column only
            h = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9) + mix64(column.astype(np.uint64) + np.uint64(1 << 32))[None, :]
        whole = (column[None, :] >= (reach - left)[:, None]) & (column[None, :] + length <= (reach - left + size)[:, None])
        at = np.flatnonzero(whole)
        own = h.reshape(-1)[at]
        by = np.argsort(own)
        own, at = own[by], at[by]
        same = own[1:] == own[:-1]
        block = (whole & (copies > 1)[:, None]).reshape(-1)
        block[at[1:][same]] = True
        block[at[:-1][same]] = True
        hit[:, column] = block.reshape(m, len(column))
    return hit[:, ::-1]  # by offset


def _windows(length: int, seed: int, some: int = 4096):
    """Whole partitions of contexts, all of a key in one: the ranges that are covered."""

    def ranges(groups: list[dict], section: tuple[int, int], out: tuple[list, list, list]) -> None:
        contexts = [(c, o, g) for g, kinds in enumerate(groups) for c, o in kinds]
        places = [p for kinds in groups for p in kinds.values()]
        hit = matched(
            [c for c, _, _ in contexts], np.array([o for _, o, _ in contexts]), np.array([len(p) for p in places]), np.array([g for _, _, g in contexts]), length, section
        )
        # runs of offsets a..b cover [spot - b, spot - a + length)
        padded = np.zeros((len(contexts), hit.shape[1] + 2), np.int8)
        padded[:, 1:-1] = hit
        edge = np.diff(padded, axis=1)
        for (k, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist()):
            for row, spot in places[k]:
                out[0].append(row)
                out[1].append(spot - section[0] - b + 1)
                out[2].append(spot - section[0] - a + length)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        key, section = table.column("key").to_numpy(), table.column("section").to_numpy()
        places = pa.compute.list_value_length(table.column("rows")).to_numpy()
        for k, own in enumerate(sections(length, seed)):
            order = np.flatnonzero(section == k)
            order = order[np.argsort(key[order], kind="stable")]
            if not len(order):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            last = np.append(first[1:], len(order))
            # a key with one place has no partner
            many = np.flatnonzero(np.add.reduceat(places[order], first) > 1)
            todo, n = [], 0
            for i in many.tolist():
                todo.append(order[first[i] : last[i]])
                n += len(todo[-1])
                if n < some and i != many[-1]:
                    continue
                got = table.take(pa.array(np.concatenate(todo)))
                columns = zip(*[got.column(c).to_pylist() for c in ("context", "left", "rows", "spots")])
                groups: list[dict[tuple[bytes, int], list[tuple[int, int]]]] = []
                for size in map(len, todo):
                    groups.append({})
                    for context, left, rows, spots in itertools.islice(columns, size):
                        groups[-1].setdefault((context, left), []).extend(zip(rows, spots))
                out: tuple[list, list, list] = ([], [], [])
                ranges(groups, own, out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "lo", "hi"])
                todo, n = [], 0

    return run


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words; none crosses documents."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hash of each word, and the n+1 offsets of the documents' words."""
    begins, ends = word_bounds(data, offsets)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
        return mix64((total[ends] - total[begins]) * inverse[begins]), np.searchsorted(begins, offsets)


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` successive 64-bit values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(values))
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power, out=total[1:])
        return mix64((total[size:] - total[:-size]) * inverse[:n])


def word_windows(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of ``words`` words within one document each: start, hash and anchor, then the hashes of the
    ``seed``-word strings and the n+1 offsets of the documents' words. The anchor is the first place of the least hash of
    the window's seed strings, so equal windows have equal anchors, and successive windows share them."""
    h, at = word_hashes(data, offsets)
    size = np.diff(at)
    start = np.flatnonzero(np.arange(len(h)) + words <= np.repeat(at[1:], size))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64), at
    seeds = _rolled(h, seed)
    low = np.uint64((1 << 32) - 1)
    keys = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    least = sliding(keys, words - seed + 1, True)
    return start, _rolled(h, words)[start], (least[start] & low).astype(np.int64), seeds, at


def _head(h: np.ndarray) -> np.ndarray:
    """Hashes as byte strings of ``HEAD`` characters, none of them zero (numpy's strings lose zeros at their end)."""
    parts = (h[:, None] >> (np.arange(HEAD, dtype=np.uint64) * np.uint64(7))[None, :]) & np.uint64(127)
    return np.ascontiguousarray(parts.astype(np.uint8) + np.uint8(1)).view(f"S{HEAD}")[:, 0]


def _word_anchors(words: int, seed: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("body"))
            for lo, hi in chunks(offsets, BLOCK):
                _, _, anchor, seeds, at = word_windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, seed)
                spots = np.unique(anchor)
                if not len(spots):
                    continue
                doc = np.searchsorted(at, spots, "right") - 1
                kinds, kind, many = np.unique(seeds[spots], return_inverse=True, return_counts=True)
                by = np.argsort(kind, kind="stable")
                ends = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HEAD), len(kinds), [None, pa.py_buffer(_head(kinds))]).cast(pa.binary())
                rows = batch.column("row").take(pa.array(lo + doc[by]))
                yield pa.RecordBatch.from_arrays([packed, pa.ListArray.from_arrays(ends, rows), pa.ListArray.from_arrays(ends, pa.array((spots - at[doc])[by]))], ["head", "rows", "spots"])

    return run


def _word_places(words: int, seed: int, hot):
    """The hashes of the windows of each repeated anchor, with the places where just these stand: equal ones of a block are one row. They
    are dealt out by the anchor; those of frequent anchors window by window, by the window's own hash."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("body"))
            told, rows = batch.column("spots").to_pylist(), batch.column("row").to_pylist()
            for lo, hi in chunks(offsets, BLOCK):
                start, h, anchor, seeds, at = word_windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, seed)
                spots = np.array([at[d] + s for d in range(hi - lo) for s in told[lo + d]], np.int64)
                own = np.flatnonzero(np.isin(anchor, spots))
                if not len(own):
                    continue
                # windows of one anchor follow each other; a frequent one's stand alone
                often = np.array([named(x) in hot.value for x in _head(seeds[anchor[own]])]) if hot.value else np.zeros(len(own), bool)
                cut = np.ones(len(own), bool)
                cut[1:] = (anchor[own][1:] != anchor[own][:-1]) | (start[own][1:] != start[own][:-1] + 1) | often[1:]
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(own))
                doc = np.searchsorted(at, start[own][first], "right") - 1
                keys = np.where(often[first], h[own][first], seeds[anchor[own][first]]).view(np.int64).tolist()
                raw, place = h[own].tobytes(), (start[own][first] - at[doc]).tolist()
                found: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
                for k, a, b, d, p in zip(keys, first.tolist(), last.tolist(), doc.tolist(), place):
                    of = found.setdefault((k, raw[8 * a : 8 * b]), ([], []))
                    of[0].append(rows[lo + d])
                    of[1].append(p)
                flat = pa.array(np.frombuffer(b"".join(x for _, x in found), np.int64))
                sizes = pa.array(np.concatenate(([0], np.cumsum([len(x) // 8 for _, x in found]))), pa.int32())
                ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r, _ in found.values()]))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(list(itertools.chain.from_iterable(x)), pa.int64())) for x in zip(*found.values())]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.ListArray.from_arrays(sizes, flat), *lists], ["key", "hashes", "rows", "starts"])

    return run


def _word_ranges(words: int):
    """Whole partitions of those rows: the ranges of the windows that have two places or more."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole).combine_chunks()
        hashes, rows, starts = (table.column(c).combine_chunks() for c in ("hashes", "rows", "starts"))
        size, places = pa.compute.list_value_length(hashes).to_numpy().astype(np.int64), pa.compute.list_value_length(rows).to_numpy().astype(np.int64)
        flat = hashes.flatten().to_numpy()
        _, kind = np.unique(flat, return_inverse=True)
        hit = np.bincount(kind, weights=np.repeat(places, size))[kind] > 1
        owner = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        # runs of repeated windows of one row
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[at][1:] != owner[at][:-1])
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        if not len(first):
            return
        # each run at each of the row's places
        many = places[owner[first]]
        begin = np.concatenate(([0], np.cumsum(places)))[owner[first]]
        pick = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        base = starts.flatten().to_numpy()[pick]
        columns = [rows.flatten().take(pa.array(pick)), pa.array(base + np.repeat(offset[first], many)), pa.array(base + np.repeat(offset[last], many) + words)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "lo", "hi"])

    return run


def repeated_words(rows: DataFrame, words: int) -> DataFrame:
    """(row, passages array<struct<lo, hi>>), in words: the passages of ``words`` words or more that start anywhere else."""
    seed, parts = min(SEED_WORDS, words), partitions(rows)
    anchored = rows.select("row", "body").mapInArrow(_word_anchors(words, seed), "head binary, rows array<long>, spots array<long>")
    twice = materialize(anchored.repartition(parts, F.xxhash64("head")).mapInArrow(_family_scan(HEAD), "row long, pos long, head long"), "anchors", few=True)
    places = twice.groupBy("row").agg(F.collect_set("pos").alias("spots"))
    near = rows.join(places.hint("shuffle_hash"), "row").mapInArrow(_word_places(words, seed, frequent(twice)), "key long, hashes array<long>, rows array<long>, starts array<long>")
    ranges = near.repartition(parts, "key").mapInArrow(_word_ranges(words), "row long, lo long, hi long")
    return ranges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("passages"))


def frequent(twice: DataFrame):
    """Heads with more than one place in ``HOT_SHARE``: less than ``HOT_SHARE`` of them, whatever the corpus."""
    bound = max(twice.count() // HOT_SHARE, 1)
    return twice.sparkSession.sparkContext.broadcast({r[0] for r in twice.groupBy("head").count().where(F.col("count") > bound).collect()})


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """df's columns, with ``body`` (null: empty) and ``row``, a hash of key and text."""
    own = F.col(f"`{text}`").cast("string")
    named = df.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(own, F.lit("")).alias("body"))
    return named.withColumn("row", F.xxhash64(F.col(f"`{key}`").cast("long"), "body"))


def partitions(rows: DataFrame) -> int:
    """Into how many parts anchors and contexts are dealt: a worker holds one part, so a part stands for at most ``PART_BYTES`` of text."""
    total = rows.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def repeated_spans(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, ranges array<struct<lo, hi>>) of rows with repeats, from the output of _rows."""
    long, parts = rows.where(F.octet_length("body") >= length), partitions(rows)
    anchored = long.select("row", "body").mapInArrow(_anchor_rows(length, seed), "head binary, rows array<long>, spots array<long>")
    dealt = anchored.repartition(parts, F.xxhash64("head"))
    twice = materialize(dealt.mapInArrow(_family_scan(seed), "row long, pos long, head long"), "anchors", few=True)
    places = twice.groupBy("row").agg(F.collect_set("pos").alias("spots"))
    # the same exchange of the texts serves this join and the one with the result
    near = rows.join(places.hint("shuffle_hash"), "row").mapInArrow(
        _contexts(length, seed, frequent(twice)), "key long, section int, context binary, left long, rows array<long>, spots array<long>"
    )
    ranges = near.repartition(parts, "key").mapInArrow(_windows(length, seed), "row long, lo long, hi long")
    return ranges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def _merge(ranges: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in ranges or ():
        if out and r["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["hi"]))
        else:
            out.append((r["lo"], r["hi"]))
    return out


def _cut(texts: pa.Array, ranges: pa.Array, passages: pa.Array | None = None) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    data, offsets = as_bytes(texts)
    raw, at = data.tobytes(), offsets.tolist()
    by_words = passages.to_pylist() if passages is not None else [None] * len(texts)
    for i, r in enumerate(ranges.to_pylist()):
        own = raw[at[i] : at[i + 1]]
        if by_words[i]:
            begins, ends = word_bounds(data[at[i] : at[i + 1]], np.array([0, len(own)]))
            more = [{"lo": int(begins[p["lo"]]), "hi": int(ends[p["hi"] - 1])} for p in by_words[i]]
            r = sorted([*(r or ()), *more], key=lambda x: x["lo"])
        spans = _merge(r)
        if not spans:
            yield own, own, spans
            continue
        keep = [own[a:b] for a, b in zip([0] + [hi for _, hi in spans], [lo for lo, _ in spans] + [len(own)])]
        yield own, b"".join(keep), spans


def removal(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, words: int | None = None) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans in bytes.

    words: also ``passage_words``, the number of words in passages of so many words or more that start anywhere else (they are told,
    not removed)."""
    rows = _rows(keyed_texts(df, key, text), "key", "text").select("key", "body", "row")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, many, digest, cut = [], [], [], [], []
            for own, kept, found in _cut(batch.column("body"), batch.column("ranges")):
                n.append(len(own))
                gone.append(len(own) - len(kept))
                many.append(len(found))
                digest.append(hashlib.sha256(kept).hexdigest())
                cut.append([{"lo": a, "hi": b} for a, b in found])
            longs = [pa.array(x, pa.int64()) for x in (n, gone, many)]
            spans = pa.array(cut, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            columns, names = [batch.column("key"), *longs, pa.array(digest, pa.string()), spans], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
            if words:
                columns.append(pa.array([sum(b - a for a, b in _merge(p)) for p in batch.column("passages").to_pylist()], pa.int64()))
                names.append("passage_words")
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = rows.join(repeated_spans(rows, length, seed).hint("shuffle_hash"), "row", "left")
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:long,hi:long>>"
    if not words:
        return joined.mapInArrow(run, schema)
    passages = repeated_words(rows, words).withColumn("passages", F.array_sort("passages"))
    return joined.join(passages.hint("shuffle_hash"), "row", "left").mapInArrow(run, schema + ", passage_words long")


def dedup_text(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, words: int | None = None) -> DataFrame:
    """df's own columns, with ``text`` cut; a document of which nothing is left is dropped, others stay.

    words: repeated passages of so many words are cut as well, and white space alone counts as nothing left."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    own = names[df.columns.index(text)]
    rows = _rows(plain, names[df.columns.index(key)], own).drop(own)
    others = [n for n in names if n != own]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passages = batch.column("passages") if words else None
            whole = batch.column("ranges").is_null()
            if words:
                whole = pa.compute.and_(whole, passages.is_null())
            cut = _cut(batch.column("body"), batch.column("ranges"), passages)
            kept = pa.array([(k if not words or k.strip() or not spans else b"").decode("utf-8", "ignore") for _, k, spans in cut], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], whole, kept], [*others, "whole", "kept"])

    kinds = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in others)
    joined = rows.join(repeated_spans(rows, length, seed).hint("shuffle_hash"), "row", "left")
    if words:
        joined = joined.join(repeated_words(rows, words).hint("shuffle_hash"), "row", "left")
    out = joined.mapInArrow(run, f"{kinds}, whole boolean, kept string").where("whole or kept <> ''")
    return out.select(*[F.col("kept" if n == own else n).alias(c) for c, n in zip(df.columns, names)])
