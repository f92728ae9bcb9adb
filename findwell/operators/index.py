"""The inverted index as four relations, and its maintenance.

docs       one row a document: metadata, the length of each field, a tombstone flag, the body
postings   (term, doc_id): term frequency by field in columns of their own (so that scans prune
           them), body positions
dictionary term, document frequency, length
stats      live documents and the mean length of each field (one row)
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import BODY, COMPACT_LEAST, COMPACT_RATIO, FIELDS, PREFIX_CAP, SCHEMA_VERSION, TOKENIZER_VERSION
from ..functions.workers import gives_back, short_batches
from ..sources.stored import materialize, new_path, release

N = len(FIELDS)
TF = [f"tf_{i}" for i in range(N)]
LEN = [f"len_{i}" for i in range(N)]
PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    facts: dict[str, float] | None = None  # the row of stats, where it is known

    def cache(self) -> Index:
        """For interactive use: keeps the small relations, and the documents without bodies, in memory."""
        return replace(self, docs=self.docs.drop("body").cache(), dictionary=self.dictionary.cache(), facts=self.stats.first().asDict())

    def with_facts(self, rows: DataFrame) -> DataFrame:
        """rows with the columns of stats."""
        if self.facts is None:
            return rows.crossJoin(F.broadcast(self.stats))  # one row
        return rows.withColumns({k: F.lit(v) for k, v in self.facts.items()})

    @property
    def live(self) -> DataFrame:
        return self.docs.where(~F.col("deleted"))


def assign_ids(docs: DataFrame, *order: Column, name: str = "doc_id", base: int = 0) -> DataFrame:
    """Dense ids from ``base`` in the given order, without one task for all rows: rows are range-partitioned and
    sorted, numbered inside their partition, and offset by the counts of the partitions before.

    Where a row lands depends on sampled bounds and on adaptive coalescing, so it is written down once; counts
    and offsets are both taken from what was written.
    """
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    part, at = F.shiftright("__place", PART_BITS), F.col("__place").bitwiseAND((1 << PART_BITS) - 1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = placed.groupBy(part.alias("__part")).count()
    skip = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__skip"))
    # one row a partition: their number is the session's, whatever the rows
    numbered = placed.withColumn("__part", part).join(F.broadcast(skip), "__part").withColumn(name, F.col("__skip") + at + base)
    return numbered.drop("__part", "__place", "__skip")


def _spread(docs: DataFrame) -> DataFrame:
    """Tokenizing is work for the processor: an input of fewer partitions than cores is dealt out first."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes, seven bits in each, the lowest first and the top bit set where more follow; and where each
    number begins, with the end."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        low = (values[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[ends[has] + k] = low | np.where(size[has] > k + 1, np.uint8(128), np.uint8(0))
    return out, ends


def _numbers(column: pa.Array) -> np.ndarray:
    """The numbers of all rows of a column of _varints()."""
    if not len(column):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if not len(data):
        return np.empty(0, np.uint64)
    last = np.flatnonzero(data < 128)
    begins = np.concatenate(([0], last[:-1] + 1))
    shift = np.arange(len(data)) - np.repeat(begins, last - begins + 1)
    return np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << (7 * shift).astype(np.uint64), begins)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: row i has the numbers from cuts[i] to cuts[i + 1]."""
    data, ends = _varints(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].astype(np.int32)), pa.py_buffer(data)])


def _packed(fields: list[int], rows: int = 1 << 18):
    """Arrow batches of (doc_id, a text for each field) to runs: the postings of some ``rows`` at a time by term, at most
    ``RUN`` in a row, and a row without a term for each document, with its lengths."""

    def block(ids: list[int | None], codes: dict[str, int], of: dict[int, tuple[array, array, array, array]]) -> Iterator[pa.RecordBatch]:
        known = np.array([i is not None for i in ids])
        plain = np.array([0 if i is None else i for i in ids], np.int64)
        base = int(plain[known].min()) if known.any() else 0
        coded = np.where(known, (plain - base).astype(np.uint64) + np.uint64(1), np.uint64(0))  # 0: null
        order = np.argsort(coded, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        keys, counts, lengths = {}, {}, np.zeros((len(ids), N), np.int32)
        for field, (n_terms, terms, many, _) in of.items():
            doc = np.repeat(np.arange(len(ids)), np.array(n_terms))
            counts[field] = np.array(many, np.int64)
            np.add.at(lengths[:, field], doc, counts[field].astype(np.int32))
            keys[field] = np.array(terms, np.int64) * len(ids) + place[doc]
        empty = [None] * len(ids)
        own = [pa.array(lengths[:, i]) for i in range(N)]
        columns = [pa.array(empty, pa.string()), pa.array(ids, pa.int64()), pa.array(empty, pa.int32()), *own, *[pa.array(empty, pa.binary())] * 3]
        yield pa.RecordBatch.from_arrays(columns, RUN_NAMES)
        merged = np.unique(np.concatenate([*keys.values(), np.empty(0, np.int64)]))
        if not len(merged):
            return
        tf = np.zeros((len(merged), len(fields)), np.int64)
        for i, field in enumerate(fields):
            if field in keys:
                tf[np.searchsorted(merged, keys[field]), i] = counts[field]
        flat = np.empty(0, np.int64)
        body_ends = np.zeros(len(merged) + 1, np.int64)
        if BODY in keys and len(keys[BODY]):
            by = np.argsort(keys[BODY])
            own = counts[BODY][by]
            begin = (np.cumsum(counts[BODY]) - counts[BODY])[by]
            flat = np.array(of[BODY][3])[np.repeat(begin - np.cumsum(own) + own, own) + np.arange(int(own.sum()))]
            body_ends[1:] = np.cumsum(tf[:, fields.index(BODY)])
        code = merged // len(ids)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n = np.diff(np.concatenate((starts, [len(merged)])))
        pieces = -(-n // RUN)  # long runs are cut, so that they can be dealt out
        within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + within * RUN
        cuts = np.concatenate((starts, [len(merged)]))
        terms = pa.array(list(codes), pa.string()).take(pa.array(code[starts]))
        which = coded[order][merged % len(ids)]
        nothing = [pa.array([None] * len(starts), pa.int32())] * N
        ahead = np.maximum(which[starts], np.uint64(1)) - np.uint64(1)
        first = ahead.astype(np.int64) + base
        rest = np.where(which > 0, which - np.repeat(ahead, np.diff(cuts)), np.uint64(0))  # a run's ids count from its first one
        columns = [terms, pa.array(first), pa.array(np.diff(cuts).astype(np.int32)), *nothing, _blobs(rest, cuts), _blobs(tf.ravel(), cuts * len(fields)), _blobs(flat, body_ends[cuts])]
        yield pa.RecordBatch.from_arrays(columns, RUN_NAMES)

    def fresh() -> tuple[list[int | None], dict[str, int], dict[int, tuple[array, array, array, array]], int]:
        """ids, codes of terms, for each field the number of terms in each text, their codes, their counts and all places (as plain numbers:
        a list for each posting took most of a block's memory), and the size so far."""
        return [], {}, {f: tuple(array("i") for _ in range(4)) for f in fields}, 0

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, of, size = fresh()
        for part in batches:
            for i in range(part.num_rows):  # one text at a time: a batch may hold ten thousand long ones
                ids.append(part.column(0)[i].as_py())
                for at, field in enumerate(fields, 1):
                    text = part.column(at)[i].as_py()
                    found = T.term_places(text) if text else {}
                    n_terms, terms, many, places = of[field]
                    n_terms.append(len(found))
                    terms.extend([codes.setdefault(t, len(codes)) for t in found])
                    many.extend(map(len, found.values()))
                    before = len(places)
                    places.extend(itertools.chain.from_iterable(found.values()))
                    size += len(found) + (len(places) - before >> 2)
                if size >= rows or len(ids) >= rows:
                    yield from block(ids, codes, of)
                    ids, codes, of, size = fresh()
        if ids:
            yield from block(ids, codes, of)

    return run


def _unpacked(fields: list[int], rows: int = 1 << 17):
    """Runs to postings, row by row in their order; rows without a term give none."""

    def part_of(runs: pa.RecordBatch) -> pa.RecordBatch:
        n = runs.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        coded = _numbers(runs.column("ids"))
        doc = np.repeat(runs.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), n)
        ids = pa.array(doc + coded.astype(np.int64) - 1, pa.int64(), mask=coded == 0)
        own = _numbers(runs.column("counts")).astype(np.int32).reshape(-1, len(fields))
        tf = [pa.array(np.ascontiguousarray(own[:, fields.index(i)]) if i in fields else np.zeros(len(doc), np.int32)) for i in range(N)]
        ends = np.concatenate(([0], np.cumsum(own[:, fields.index(BODY)] if BODY in fields else np.zeros(len(doc), np.int32))))
        places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_numbers(runs.column("places")).astype(np.int32)))
        terms = runs.column("term").take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([terms, ids, *tf, places], ["term", "doc_id", *TF, "positions"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = part.filter(part.column("term").is_valid())
            before = np.cumsum(part.column("n").to_numpy(zero_copy_only=False).astype(np.int64)) if part.num_rows else np.empty(0, np.int64)
            at = 0
            while at < part.num_rows:
                done = int(before[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(before, done + rows, "right")))
                yield part_of(part.slice(at, to - at))
                at = to

    return run


RUN = 128  # postings of a term in one row of the table of runs
RUN_NAMES = ["term", "doc_id", "n", *LEN, "ids", "counts", "places"]
RUNS = f"term string, doc_id long, n int, {', '.join(f'{x} int' for x in LEN)}, ids binary, counts binary, places binary"
POSTING = f"term string, doc_id long, {', '.join(f'{t} int' for t in TF)}, positions array<int>"


def _texts(docs: DataFrame, lite: bool) -> tuple[list[int], DataFrame]:
    """The fields that documents have (absent ones are empty), and doc_id with their texts."""
    fields = {i: F.col(name).cast("string") for i, name in enumerate(FIELDS) if name in docs.columns and not (lite and i == BODY)}
    return list(fields), _spread(docs.select(F.col("doc_id").cast("long"), *[c.alias(f"__{i}") for i, c in fields.items()]))


def postings_of(docs: DataFrame, lite: bool = False) -> DataFrame:
    """Postings of documents with a text column for each field (absent ones are empty).

    A document gives all its postings at once, so nothing is shuffled. The work is done on Arrow batches: counting
    and folding in higher-order functions and aggregations of the JVM took several times as long (see README).
    """
    fields, texts = _texts(docs, lite)
    pack, unpack = _packed(fields), _unpacked(fields)
    return texts.mapInArrow(lambda batches: unpack(pack(batches)), POSTING)


def dictionary_of(postings: DataFrame) -> DataFrame:
    """(term, doc_id) is unique in postings, so a plain count is the document frequency."""
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("len", T.utf16_length(F.col("term")))


def stats_of(docs: DataFrame) -> DataFrame:
    """n and mean field lengths over live documents; 0 for an empty corpus."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{i}") for i, c in enumerate(LEN)]
    return docs.where(~F.col("deleted")).agg(F.count("*").alias("n"), *means)


def _described(docs: DataFrame, runs: DataFrame, lite: bool) -> DataFrame:
    """The docs relation: metadata with defaults, field lengths, nothing deleted."""
    lengths = runs.where("term is null").groupBy("doc_id").agg(*[F.sum(c).cast("int").alias(c) for c in LEN])
    out = docs.drop("tags") if "tags" in docs.columns and dict(docs.dtypes)["tags"] == "string" else docs
    if "tag_list" in out.columns:
        out = out.withColumn("tags", F.col("tag_list")).drop("tag_list")
    defaults = {"basename": F.lit(""), "mtime_ms": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "doc_type": F.lit("md"), "tags": F.array().cast("array<string>"), "body": F.lit("")}
    for name, value in defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, value)
    kept = out.select("doc_id", "path", T.fold(F.col("path")).alias("folded_path"), *defaults)
    # bodies meet the few numbers of their document in a hash table, so they are not sorted
    joined = kept.join(lengths.hint("shuffle_hash"), "doc_id", "left").na.fill({c: 0 for c in LEN}).withColumn("deleted", F.lit(False))
    return joined.withColumn("body", F.lit("")) if lite else joined


def build_index(docs: DataFrame, lite: bool = False) -> Index:
    """Index of documents: doc_id, path, and any of basename, mtime_ms, size, doc_type, tags and the
    fields' texts. ``lite`` leaves bodies out. It is written to the shared folder, so texts are tokenized once
    however often its relations are used."""
    path = new_path(docs.sparkSession, "index")
    build_and_save(docs, path, lite)
    return load(docs.sparkSession, path)


def write_relations(docs: DataFrame, docs_path: str, postings_path: str, lite: bool = False, ordered: bool = True) -> None:
    """Writes the docs and postings relations; texts are tokenized once. ``ordered``: postings in order of terms over all files;
    else they are written as they come, without an exchange.

    That pass writes runs: many postings of a term in a row as packed bytes, and each document's lengths. Runs are
    what is dealt out and sorted, instead of the postings they give; those are made again as the last step of the write.
    """
    fields, texts = _texts(docs, lite)
    # written as they come first: sampling the bounds of the range partitions would else tokenize everything twice
    with short_batches(docs.sparkSession):
        runs = materialize(texts.mapInArrow(_packed(fields), RUNS), "runs")
    placed = runs.where("term is not null").drop(*LEN)
    if ordered:
        placed = placed.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    _put_postings(placed.mapInArrow(_unpacked(fields), POSTING), postings_path)
    _described(docs, runs, lite).write.mode("overwrite").parquet(docs_path)
    release(runs)


def build_and_save(docs: DataFrame, path: str, lite: bool = False) -> None:
    """Writes an index that load() reads; the dictionary and the statistics are made from what was written."""
    spark = docs.sparkSession
    write_relations(docs, f"{path}/docs", f"{path}/postings", lite)
    _write_rest(spark, dictionary_of(spark.read.schema(POSTING).parquet(f"{path}/postings")), path)


def _put_postings(placed: DataFrame, path: str) -> None:
    placed.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def save(index: Index, path: str) -> None:
    """Parquet, with postings and dictionary in order of terms, so that exact and prefix lookups skip row groups."""
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    _put_postings(index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id"), f"{path}/postings")
    _write_rest(index.docs.sparkSession, index.dictionary, path)


def _write_rest(spark: SparkSession, dictionary: DataFrame, path: str) -> None:
    dictionary.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    stats_of(spark.read.parquet(f"{path}/docs")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    meta = json.dumps({"schema": SCHEMA_VERSION, "tokenizer": TOKENIZER_VERSION})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index | None:
    """The saved index; None if it is missing, damaged or of another version, which calls for a rebuild."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if (meta["schema"], meta["tokenizer"]) != (SCHEMA_VERSION, TOKENIZER_VERSION):
            return None
        return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "dictionary", "stats")])
    except Exception as e:  # missing files and unreadable ones come as different errors
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER", "CANNOT_READ_FILE", "Expecting value", "FAILED_READ_FILE", "NoneType", "schema")):
            return None
        raise


def prefix_terms(dictionary: DataFrame, prefix: str, cap: int = PREFIX_CAP) -> DataFrame:
    """Terms with the prefix, most frequent first (the filter reaches the Parquet scan)."""
    return dictionary.where(F.col("term").startswith(prefix)).orderBy(F.desc("df"), "term").limit(cap)


def tombstone(index: Index, paths: DataFrame) -> Index:
    """Marks documents deleted. Document frequencies stay as they are until compaction."""
    gone = paths.select("path").distinct().withColumn("__gone", F.lit(True))
    docs = index.docs.join(gone, "path", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")
    docs = docs.select(*index.docs.columns)
    return Index(docs, index.postings, index.dictionary, stats_of(docs))


def append(index: Index, new: Index) -> Index:
    """Adds documents under new ids; document frequencies are added up."""
    docs = index.docs.unionByName(new.docs)
    both = index.dictionary.select("term", "df").unionByName(new.dictionary.select("term", "df"))
    dictionary = both.groupBy("term").agg(F.sum("df").alias("df")).withColumn("len", T.utf16_length(F.col("term")))
    return Index(docs, index.postings.unionByName(new.postings), dictionary, stats_of(docs))


def upsert(index: Index, docs: DataFrame, lite: bool = False) -> Index:
    """Update = tombstone the old path, append under a new id."""
    last = index.docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
    fresh = assign_ids(docs.drop("doc_id"), F.col("path"), base=last + 1)
    return append(tombstone(index, docs), build_index(fresh, lite))


def needs_compaction(index: Index) -> bool:
    dead, live = index.docs.agg(F.count_if("deleted"), F.count_if(~F.col("deleted"))).first()
    return dead > max(COMPACT_LEAST, COMPACT_RATIO * live)


def compact(index: Index) -> Index:
    """Drops tombstoned documents and their postings, makes ids dense again, recounts frequencies."""
    docs = assign_ids(index.live.withColumnRenamed("doc_id", "__old"), F.col("__old"))
    ids = docs.select(F.col("__old").alias("doc_id"), F.col("doc_id").alias("__new"))
    postings = index.postings.join(ids, "doc_id").drop("doc_id").withColumnRenamed("__new", "doc_id").select(*index.postings.columns)
    docs = docs.drop("__old").select(*index.docs.columns)
    return Index(docs, postings, dictionary_of(postings), stats_of(docs))


def all_tags(index: Index) -> DataFrame:
    return index.live.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def stale(listing: DataFrame, index: Index) -> DataFrame:
    """Files to (re)index: not indexed, or of another time or size; newest first. Ties by path."""
    known = index.live.select("path", F.col("mtime_ms").alias("__m"), F.col("size").alias("__s"))
    differs = F.col("__m").isNull() | (F.col("mtime_ms") != F.col("__m")) | (F.col("size") != F.col("__s"))
    return listing.join(known, "path", "left").where(differs).drop("__m", "__s").orderBy(F.desc("mtime_ms"), "path")


def removed(listing: DataFrame, index: Index) -> DataFrame:
    """Live documents whose file is gone."""
    return index.live.join(listing.select("path").distinct(), "path", "left_anti").select("path")


def status(index: Index, total: int | None = None, skipped: int = 0) -> dict[str, int]:
    """skipped: files that could not be read (``sources.files.unread``)."""
    live, dead = index.docs.agg(F.count_if(~F.col("deleted")), F.count_if("deleted")).first()
    return {"ready": 1, "indexed": live, "total": live if total is None else total, "tombstones": dead, "skipped": skipped}
