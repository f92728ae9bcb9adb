"""Operator 7: quality rules, with repetition found by suffix arrays.

The words of a document (runs of anything but ASCII white space) form an integer sequence. A
suffix array over it, with the longest common prefixes (LCP) of neighbours, gives the maximal
repeated substrings: a position belongs to an LCP interval of depth d if d words from there on
occur elsewhere in the document. Intervals of ``min_words`` or more are unioned into spans; the
share of the text that they cover and the longest of them are limited.

One suffix array serves a block of documents: the first sort key is the document, so no match
crosses from one to another, and numpy's sorts work on long arrays. Refinement by prefix doubling
goes on only inside groups that are still equal, so documents without repeats cost four rounds.

Defined cases: a null or empty text has no words, and fails the base rule (fewer than 20 words).
Rows with a null key, repeated rows and further columns pass through: each input row gives one
output row. Very long texts form a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, chunks, keyed_texts

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"
WINDOW = 8

SCHEMA = (
    "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repeat_fraction double, longest_repeat_words long, "
    "repeat_spans array<struct<start:long,end:long>>"
)


@dataclass(frozen=True)
class Rules:
    """Limits. Base: ``min_words`` words at least, at most ``max_repeat_percent`` of them in repeated windows.
    Method: repeated substrings cover at most ``max_fraction`` of the word characters, and the
    longest has at most ``max_longest`` words and ``max_longest_share`` of the document's words. Both reach below what
    the base rule lets pass: a repeat that is said twice covers twice its length."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_fraction: float = 0.20
    max_longest: int = 500
    max_longest_share: float = 0.12
    block_bytes: int = 2 << 20


def suffix_array(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks after each round.

    first: each position's symbol, different for different documents; end: the position after
    its document. ranks[j][i] equals ranks[j][k] just if the 2**j symbols from i and k agree.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    s = first[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, h = [rank], 1
    while True:
        # positions (in suffix order) of groups that are not yet single
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            return order, ranks
        pos = order[at]
        nxt = pos + h
        inside = nxt < end[pos]
        second = np.where(inside, rank[np.where(inside, nxt, 0)] + 1, 0)
        key = rank[pos] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[at] = pos
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[at] |= split
        rank = rank.copy()
        rank[pos] = at[np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))]
        ranks.append(rank)
        h *= 2


def repeats(first: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each position the longest run of symbols from there that also starts elsewhere in its
    document, or 0 if it is shorter than ``least``: the deepest LCP interval it lies in."""
    best = np.zeros(len(first), np.int64)
    if len(first) < 2:
        return best
    order, ranks = suffix_array(first, end)
    a, b = order[:-1], order[1:]
    level = min(least.bit_length() - 1, len(ranks) - 1)
    near = np.flatnonzero(ranks[level][a] == ranks[level][b])
    a, b = a[near], b[near]
    x, y = a.copy(), b.copy()
    for j in range(len(ranks) - 1, -1, -1):
        ok = (x < end[a]) & (y < end[b])
        i = np.flatnonzero(ok)
        i = i[ranks[j][x[i]] == ranks[j][y[i]]]
        x[i] += 1 << j
        y[i] += 1 << j
    lcp = x - a
    lcp[lcp < least] = 0
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def union(length: np.ndarray) -> np.ndarray:
    """True where some [i, i + length[i]) reaches."""
    n = len(length)
    reach = np.maximum.accumulate(np.where(length > 0, np.arange(n) + length, 0))
    return reach > np.arange(n)


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANK)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def block(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, object]:
    """All columns but the key for some documents, given as bytes and offsets."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    blank = _BLANK[data]

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[offsets[1:]] - c[offsets[:-1]]

    symbols, word_chars = total(_SYMBOL[data]), total(lead & ~blank)
    raw = data.tobytes()
    names: dict[bytes, int] = {}
    ids, counts, dup_lines = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(n):
        text = raw[offsets[d] : offsets[d + 1]]
        words = text.split()
        counts[d] = len(words)
        ids.extend([names.setdefault(w, len(names)) for w in words])
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            dup_lines[d] = len(lines) - len(set(lines))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(n), counts)
    first = doc * (len(names) + 1) + np.array(ids, np.int64)
    best = repeats(first, bounds[1:][doc], WINDOW)
    hit = union(best)  # never past the document's end, as no repeat is
    inside = np.concatenate(([0], np.cumsum(hit)))
    n_repeat = inside[bounds[1:]] - inside[bounds[:-1]]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, best)
    # where words begin and end, in code points of their document
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    covered = np.zeros(n, np.int64)
    if hit.any():
        edge = np.ones(len(data) + 1, bool)
        edge[:-1] = blank
        edge[offsets] = True
        is_word = ~blank
        before = np.ones(len(data), bool)
        before[1:] = blank[:-1]
        before[offsets[:-1][counts > 0]] = True
        begin = np.flatnonzero(is_word & before)
        after = np.ones(len(data), bool)
        after[:-1] = blank[1:]
        after[offsets[1:][counts > 0] - 1] = True
        stop = np.flatnonzero(is_word & after) + 1
        points = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
        size = points[stop] - points[begin]
        np.add.at(covered, doc[hit], size[hit])
        padded = np.concatenate(([False], hit, [False]))
        change = np.zeros(len(hit) + 1, bool)
        change[bounds] = True
        lo = np.flatnonzero(hit & (~padded[:-2] | change[:-1]))
        hi = np.flatnonzero(hit & (~padded[2:] | change[1:]))
        base = points[offsets[:-1]]
        for a, b in zip(lo.tolist(), hi.tolist()):
            d = doc[a]
            spans[d].append({"start": int(points[begin[a]] - base[d]), "end": int(points[stop[b]] - base[d])})
    base_failed = (counts < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * counts)
    fraction = covered / np.maximum(word_chars, 1)
    ok = (fraction <= rules.max_fraction) & (longest <= np.minimum(rules.max_longest, rules.max_longest_share * counts))
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & ok,
        "repeat_fraction": fraction, "longest_repeat_words": longest, "repeat_spans": spans,
    }


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def score(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per input row: key, the base counts, the verdict and the repeated spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets, rules.block_bytes):
                found = block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rules)
                columns = [batch.column(0).slice(lo, hi - lo)]
                columns += [pa.array(v, _SPANS) if k == "repeat_spans" else pa.array(v) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays(columns, ["key", *found])

    return keyed_texts(df, key, text).mapInArrow(run, SCHEMA)


def keep(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """df's own rows and columns, without the documents that the rules reject: one scan, no shuffle."""
    names, at = df.columns, df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(at))
            good = [block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rules)["kept"] for lo, hi in chunks(offsets, rules.block_bytes)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
