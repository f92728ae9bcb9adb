"""Operator 2: token ids as ORC, in document order, with indexes for pruning.

Texts are range-partitioned and sorted by document id, encoded, and written as ORC: the ids as an integer list
(ORC's run-length encoding), stripes that readers take in parallel, row indexes and a Bloom filter on
``doc_id``, so a lookup skips files, stripes and row groups by their metadata. Each file is a range of
document ids, and the files' part numbers follow the ids. Each row carries the number of ids before it in its file; with the
sums of the files before, which come from the ``n_tokens`` column alone, that is its offset in the whole sequence.

Encoding: the public tokenizers library encodes each distinct stretch between ASCII white space
once, and its ids are kept per worker. That is exact for tokenizers that split at white space and drop
it (their matches never reach across it); others are encoded as whole texts (``memo=False``).

Defined cases: null text is empty and has the end id only; repeated rows are repeated, in a fixed order;
null ids come first; any Unicode text is valid.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, keyed_texts

END_ID = 1
STRIPE_BYTES = 64 << 20
ROW_STRIDE = 10_000
CACHE_WORDS = 700_000
STEP = 2048  # rows at once: lists of 32-bit offsets stay far from their limit
_encoders: dict[str, Encoder] = {}


# Words of ASCII and Latin-1 letters, for which lower-casing and splitting are the same in any Unicode version.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The tokenizer file's own split pattern, on lower-cased text of that range (a fixed value).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPECIAL = "<|"
_LIBRARY_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _words(ids: list[int]) -> bytes:
    """Little-endian 32-bit words."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable Latin-1 stands for itself, the other bytes for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """word (bytes) -> its ids as little-endian 32-bit words; emptied when it grows too large.

    A new word is encoded by the library: plain ones are cut as the tokenizer's pattern cuts them and
    the pieces go to its BPE model, which spares the general normaliser; all others go through
    ``Tokenizer.encode``.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.known_split = _LIBRARY_SPLIT in json.dumps(json.load(f)["pre_tokenizer"]).replace("\\\\", "\\")

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        out = self.pieces[piece] = _words([t.id for t in self.model.tokenize(text)])
        return out

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if self.known_split and _PLAIN.fullmatch(text) and _SPECIAL not in text:
            known = self.pieces.get
            out = b"".join([known(x) or self._piece(x) for x in _SPLIT.findall(text.lower())])
        else:
            out = _words(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = out
        return out

    def ids(self, text: bytes) -> bytes:
        if len(self) > CACHE_WORDS or len(self.pieces) > CACHE_WORDS:
            self.clear()
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def whole(self, text: bytes) -> bytes:
        return _words(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids)


def encoder(path: str) -> Encoder:
    """One for each worker process, so what it has learnt serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_batch(texts: pa.Array, path: str, end_id: int, memo: bool) -> pa.Array:
    """list<int32> of each text's ids and the end id."""
    data, offsets = as_bytes(texts)
    raw, at = data.tobytes(), offsets.tolist()
    own = encoder(path)
    encode = own.ids if memo else own.whole
    end = np.array([end_id], "<u4").tobytes()
    parts, sizes = [], [0]
    for a, b in zip(at, at[1:]):
        ids = encode(raw[a:b])
        parts += [ids, end]
        sizes.append(len(ids) // 4 + 1)
    flat = np.frombuffer(b"".join(parts), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))


def counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, memo: bool = True) -> DataFrame:
    """(key, n_tokens) of every row, the end id included: one scan, nothing is shuffled or written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                ids = encode_batch(part.column(1), tokenizer, end_id, memo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))], ["key", "n_tokens"])

    return keyed_texts(df, key, text).mapInArrow(run, "key long, n_tokens long")


def write(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, memo: bool = True) -> None:
    """Encodes every text of df into ORC files under path: doc_id, n_tokens, skip (ids before the row in its file), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                ids = encode_batch(part.column(1), tokenizer, end_id, memo)
                at = ids.offsets.to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(before + at[:-1]), ids], ["doc_id", "n_tokens", "skip", "ids"])
                before += int(at[-1])

    ordered = keyed_texts(df, key, text).repartitionByRange("key").sortWithinPartitions("key", "text")
    encoded = ordered.mapInArrow(run, "doc_id long, n_tokens long, skip long, ids array<int>")
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_STRIDE)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 0)  # a task's rows stay in one file
        .orc(path)
    )


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the place of a document's first id in the whole sequence: a file's ``skip`` is offset by
    the ids of the files before it, from one row a file."""
    name = F.col("_metadata.file_name")
    part = F.struct(F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias("task"), F.regexp_extract(name, r"-c(\d+)", 1).alias("file"))
    rows = spark.read.orc(path).withColumn("part", part)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = files.withColumn("base", base).select("part", "base")
    # no more files than the session has shuffle partitions, whatever the corpus
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("skip")).alias("start"), "n_tokens", "ids")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
            n = [(b - a) // 4 for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens(spark, path).select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the ORC reader prunes by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids))
