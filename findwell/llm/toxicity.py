"""Operator 6: toxicity by a counterfactually regularised classifier.

A logistic regression over the words that a text contains and their beginnings (hashed), fitted on a bounded sample of labelled rows.
Besides the usual loss and an L2 term it has a counterfactual one: in labelled sentences identity
terms are swapped for other identity terms (and, as such mentions are rare, put into sentences
without any), and the squared change of the score is penalised. So naming a group cannot by itself
move a score, and neutral mentions give no false positives.

The fit uses at most ``max_rows`` labelled rows (chosen by a hash of the key); every one of them is swapped. Of the hashed words
of three sampled texts or more it takes the ``max_features`` that differ most between the labels, by over four standard deviations; scoring reads every whole text, in one scan.

Defined cases: null text is empty; the score of a text without known words is the base rate; labels that
are null are ignored and of several labels of a key the largest counts; with one label only every score is that
label's share (0 without any label); repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts

BITS = 20
MAX_ROWS = 20_000
MAX_FEATURES = 1024
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")

# Identity terms whose mention is neutral, by language.
IDENTITY = (
    "women men girls boys woman man female male gay lesbian straight bisexual trans transgender queer black white asian african latino hispanic arab "
    "jewish jews muslim muslims christian christians catholic hindu buddhist sikh atheist immigrant immigrants refugee refugees foreigner foreigners "
    "disabled blind deaf autistic old young elderly "
    "frauen männer schwul lesbisch schwarze weiße juden jüdisch moslem muslime christen ausländer flüchtlinge behinderte "
    "femmes hommes noirs blancs juifs musulmans chrétiens étrangers réfugiés handicapés "
    "mujeres hombres negros blancos judíos musulmanes cristianos extranjeros refugiados discapacitados"
).split()


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and, of longer ones, its first four and five letters."""
    parts = [word]
    if len(word) > 4:
        parts.append(f"4:{word[:4]}")
    if len(word) > 5:
        parts.append(f"5:{word[:5]}")
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in parts]


def hashed(text: str) -> np.ndarray:
    """A text's features, sorted and distinct."""
    return np.unique(np.fromiter((b for w in words(text) for b in features(w)), np.int32))


def held_out(key: Column) -> Column:
    """Rows whose labels are not to be learnt from: crc32 of the key as text leaves 2 when divided by 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    bias: float = -50.0
    weights: dict[int, float] = field(default_factory=dict)

    def logit(self, text: str) -> float:
        return self.bias + sum(self.weights.get(int(b), 0.0) for b in hashed(text))


class _Known(dict):
    """word -> its features that have a weight, learnt as words come; emptied when it grows too large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = tuple(b for b in features(word) if b in self.model.weights)
        return out

    def logit(self, text: str) -> float:
        weights = self.model.weights
        return self.model.bias + sum([weights[b] for b in sorted({b for own in map(self.__getitem__, words(text)) for b in own})])


@dataclass
class Rows:
    """Hashed texts: the features of row i are flat[begin[i] : begin[i + 1]]."""

    flat: np.ndarray
    begin: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.begin[i] : self.begin[i + 1]]

    @staticmethod
    def of(texts: list[str]) -> Rows:
        each = [hashed(t) for t in texts]
        return Rows(np.concatenate([np.zeros(0, np.int32), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64))))


Swap = tuple[list[int], list[int]]  # features that come and features that go


def counterfactuals(rows: Rows, seed: int = 5) -> list[Swap]:
    """For every labelled sentence, what changes when identity terms are swapped: one swap for each term it has; a
    sentence without any gets one instead of another, or instead of none."""
    rng = np.random.default_rng(seed)
    terms = [features(w) for w in IDENTITY]
    whole = {t[0]: t for t in terms}
    names = np.array(sorted(whole), np.int32)
    out: list[Swap] = []
    for i in range(len(rows)):
        own = rows.row(i)
        had = own[np.isin(own, names)].tolist()
        other = [b for b in terms[rng.integers(len(terms))] if not (own == b).any()] if rng.random() < 0.5 else []
        for old in [whole[t] for t in had] or [other]:
            new, rest = terms[rng.integers(len(terms))], own[~np.isin(own, old)]
            out.append(([b for b in new if b not in old and not (rest == b).any()], [b for b in old if b not in new]))
    return out


def train(
    rows: Rows, labels: np.ndarray, swaps: list[Swap], max_features: int = MAX_FEATURES, l2: float = 2e-4, fairness: float = 1.0, rounds: int = 300
) -> Model:
    """Fits a model: logistic loss + l2 * |w|^2 / 2 + fairness * mean squared change of the score under swaps."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(50.0 if share == 1 else -50.0)
    n1, n0 = labels.sum(), (1 - labels).sum()
    of = np.repeat(labels, np.diff(rows.begin))
    c1, c0 = (np.bincount(rows.flat[of == y], minlength=1 << BITS) for y in (1, 0))
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    z[c1 + c0 < 3] = 0
    top = np.argsort(-z, kind="stable")[:max_features]
    used = np.array(sorted({*top[z[top] > 4.0].tolist(), *(b for w in IDENTITY for b in features(w))}))
    slot = np.full(1 << BITS, -1)
    slot[used] = np.arange(len(used))
    # both matrices as (row, column, value): few of a text's words have a weight
    at = slot[rows.flat]
    r, c = np.repeat(np.arange(len(rows)), np.diff(rows.begin))[at >= 0], at[at >= 0]
    moves = [(i, int(slot[f]), sign) for i, pair in enumerate(swaps) for own, sign in zip(pair, (1.0, -1.0)) for f in own]
    sr, sc, sv = (np.array(v) for v in zip(*moves)) if moves else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    n, k = len(rows), len(used)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = b + np.bincount(r, weights=w[c], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(c, weights=gap[r], minlength=k) / n + l2 * w
        if moves:
            shift = np.bincount(sr, weights=sv * w[sc], minlength=len(swaps))
            g += 2 * fairness * np.bincount(sc, weights=sv * shift[sr], minlength=k) / len(swaps)
        gb = float(gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 if t < rounds * 0.7 else 0.02
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(float(b), {int(u): float(k) for u, k in zip(used, w) if abs(k) > 1e-4})


def sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int = MAX_ROWS) -> tuple[Rows, np.ndarray]:
    """Hashed words and labels of at most about ``max_rows`` labelled rows that are not held out."""
    named = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y is not null")
    usable = named.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Rows.of(batch.column(1).to_pylist())
            each = pa.ListArray.from_arrays(pa.array(found.begin, pa.int32()), pa.array(found.flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), each], ["id", "y", "words"])

    # max_rows bounds what is broadcast and what is collected
    picked = keyed_texts(df, key, text).join(F.broadcast(some), F.col("key") == F.col("id")).select("y", "text", "key")
    got = picked.mapInArrow(run, "id long, y int, words array<int>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
    each = got.column("words").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    begin = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(each).to_numpy(), dtype=np.int64)))
    return Rows(each.flatten().to_numpy(), begin), got.column("y").to_numpy().astype(np.int64)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    rows, y = sample(df, labels, key, text, label, max_rows)
    return train(rows, y, counterfactuals(rows))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for every row."""
    told = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES + identity weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(told.value)
        for batch in batches:
            z = np.array([known.logit(t) for t in batch.column("text").to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["key", "held_out", "score", "predicted"])

    own = keyed_texts(df, key, text).withColumn("held_out", held_out(F.col("key")))
    return own.mapInArrow(run, "key long, held_out boolean, score double, predicted int")
