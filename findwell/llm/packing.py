"""Operator 8: best-fit packing into bins of several permitted capacities.

Best-fit decreasing looks at lengths only, so it is run on the histogram of lengths: at most
``max(capacities)`` rows, whatever the corpus. Bins of equal state are handled as one range of bin numbers,
so a length that a third of all documents has is placed in a few steps. Documents are then dealt to
the planned places by their rank among the documents of their length.

* A bin of capacity c costs ``c + c * c / attention + overhead``: a transformer's work on a sequence is 24 d^2 a token for
  its matrices and 4 d c for attention, so for width d the second is c / 6 d of the first.
* A piece goes to the fullest open bin that it fits (least room left).
* If none fits, a bin is opened. With ``least_cost`` the size is chosen for each run of bins: the one with the
  least cost a token, when it has taken as many pieces of this length as it holds and its share of the
  shorter pieces that are still to come (less the room that is open already), and has been downsized. Without, the
  smallest opened size that holds the piece.
* The permitted lengths are optimised jointly: plans are made by least cost over all capacities, and by smallest size over every
  set of capacities that has the largest one; all are costed after downsizing, and the cheapest is kept.
* In the end each bin is downsized to the smallest capacity that holds its contents.

A row longer than the largest capacity is cut into pieces of that size and a rest. The rank is
counted within (length, salt) and offset by the counts of the salts before, so no length is ever
sorted in one task.

Defined cases: rows of length null or zero take no place (bin null); null keys and repeated rows are
pieces like any other; keys of equal length are dealt out in the order of (key, piece).
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
OVERHEAD = 64
ATTENTION = 6 * 4096
SALTS = 64
SCHEMA = "bin_id long, capacity long, bin_used long, bin_offset long"


@dataclass
class Plan:
    """Places by length: rows (length, first rank, first bin, offset in the bin), and bins by range of numbers."""

    places: np.ndarray  # length, rank, bin, offset; sorted
    bins: np.ndarray  # first bin, capacity, used; sorted
    cost: float


def price(capacity: int, overhead: float, attention: float) -> float:
    return capacity + capacity * capacity / attention + overhead


def pack(
    histogram: dict[int, int], opened: tuple[int, ...], capacities: tuple[int, ...], overhead: float, attention: float = ATTENTION, least_cost: bool = False
) -> Plan:
    """Best-fit decreasing on lengths with counts. opened: the capacities in which new bins are opened, besides the largest."""
    places: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room left -> (first bin, bins, used)
    rooms: list[int] = []  # those that have bins, in order
    free = 0  # room left in all open bins
    capacities, choice = tuple(sorted(capacities)), sorted({*opened, max(capacities)})
    known = sorted(histogram)
    total = np.concatenate(([0], np.cumsum([n * histogram[n] for n in known], dtype=np.int64)))

    def put(left: int, bins: tuple[int, int, int]) -> None:
        nonlocal free
        free += left * bins[1]
        if not room[left]:
            insort(rooms, left)
        room[left].append(bins)

    def unit_cost(size: int, length: int, todo: int) -> float:
        fit = min(todo, size // length)
        used, bins = fit * length, -(-todo // fit)
        shorter = int(total[bisect_right(known, min(size - used, length - 1))])
        used += min(size - used, max(0, shorter - free) // bins)
        return price(next(c for c in capacities if c >= used), overhead, attention) / used

    n = 0
    for length in reversed(known):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many, used = room[left].pop()
                free -= left * many
                if many > todo:
                    free += left * (many - todo)
                    room[left].append((first + todo, many - todo, used))
                    many = todo
                if not room[left]:
                    rooms.pop(at)
                places.append((length, rank, first, used))
                put(left - length, (first, many, used + length))
                rank += many
                todo -= many
                continue
            fitting = [c for c in choice if c >= length]
            size = min(fitting, key=lambda c: unit_cost(c, length, todo)) if least_cost else fitting[0]
            # as many pieces of this length as fit, in whole bins at once, and one bin for the rest
            fit = size // length
            for many, bins in ((fit, todo // fit), (todo % fit, 1)):
                if not many or not bins:
                    continue
                places += [(length, rank + k * bins, n, k * length) for k in range(many)]
                put(size - many * length, (n, bins, many * length))
                n += bins
                rank += bins * many
                todo -= bins * many
    bins, cost = [], 0.0
    for group in room.values():
        for first, many, used in group:
            size = next(c for c in capacities if c >= used)
            bins.append((first, size, used))
            cost += many * price(size, overhead, attention)
    return Plan(np.array(sorted(places), np.int64).reshape(-1, 4), np.array(sorted(bins), np.int64).reshape(-1, 3), cost)


def best_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> Plan:
    """The cheapest of the plan by least cost and those of every set of opening sizes."""
    *lesser, _ = sorted(capacities)
    sets = [c for k in range(len(lesser) + 1) for c in itertools.combinations(lesser, k)]
    plans = itertools.chain([pack(histogram, tuple(lesser), capacities, overhead, attention, True)], (pack(histogram, c, capacities, overhead, attention) for c in sets))
    return min(plans, key=lambda p: p.cost)


def pieces(df: DataFrame, key: str, length: Column, largest: int) -> DataFrame:
    """(key, piece int, length long): the stretches of each row that go into one bin."""
    whole = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"))
    cut = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.ceil(F.col("n") / largest).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    return whole.select("key", "n", F.explode(cut).alias("piece")).select("key", "piece", F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("length"))


def assign(
    df: DataFrame, key: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, salts: int = SALTS
) -> DataFrame:
    """(key, piece, length, bin_id, capacity, bin_used, bin_offset) for every piece of every row.

    length: tokens of a row; by default the UTF-8 bytes of ``text``, the length for byte-level models.
    """
    spark = df.sparkSession
    length = F.octet_length("text") if length is None else length
    own = pieces(df, key, length, max(capacities)).withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)))
    own = materialize(own, "pieces")
    counts = own.groupBy("length", "salt").count()
    # at most max(capacities) rows, by the choice of lengths
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect() if r["length"] > 0}
    told = spark.sparkContext.broadcast(best_plan(histogram, capacities, overhead, attention))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("skip", F.coalesce(F.sum("count").over(before), F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = told.value
        wide = np.int64(1) << np.int64(44)
        index = plan.places[:, 0] * wide + plan.places[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            if len(index):
                row = plan.places[np.searchsorted(index, size * wide + rank, "right") - 1]
                number = row[:, 2] + rank - row[:, 1]
                about = plan.bins[np.searchsorted(plan.bins[:, 0], number, "right") - 1]
                found = [number, about[:, 1], about[:, 2], row[:, 3]]
            else:
                found = [size] * 4
            columns = [pa.array(c, pa.int64(), mask=size == 0) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "piece", "length")] + columns, ["key", "piece", "length", "bin_id", "capacity", "bin_used", "bin_offset"])

    within = Window.partitionBy("length", "salt").orderBy("key", "piece")
    local = own.withColumn("at", F.row_number().over(within) - 1)
    ranked = local.join(offsets.select("length", "salt", "skip"), ["length", "salt"]).select("key", "piece", "length", (F.col("at") + F.col("skip")).alias("rank"))
    return ranked.mapInArrow(place, f"key long, piece int, length long, {SCHEMA}")


def sequences(tokens: DataFrame, key: str = "start", ids: str = "ids", capacities: tuple[int, ...] = CAPACITIES, **options) -> DataFrame:
    """(bin_id, capacity, ids array<int>, ends array<long>): the packed token ids of each bin, and where its pieces end.

    tokens: rows with a key of their own (``start`` of ``token_orc.tokens`` is one) and token ids. A bin is one row of at most ``max(capacities)`` ids.
    """
    largest = max(capacities)
    plain = tokens.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{ids}`").alias("ids"))
    placed = assign(plain, "key", F.size("ids"), capacities, **options).where("bin_id is not null")
    cut = placed.join(plain, "key").select("bin_id", "capacity", "bin_offset", F.slice("ids", F.col("piece") * largest + 1, F.col("length").cast("int")).alias("ids"))
    bins = cut.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "ids"))).alias("parts"))
    return bins.select("bin_id", "capacity", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p["bin_offset"] + F.size(p["ids"])).alias("ends"))
