"""Document sources. All scans are distributed file reads; nothing is listed on the driver by hand."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.html import ENTITIES, html_text, html_title
from ..functions.markdown import extract_fields
from ..functions.misc import basename, extension


READ_TIMEOUT_S = 5.0


def _named(df: DataFrame, root: str) -> DataFrame:
    path = F.regexp_replace(F.col("__file"), r"^file:/+", "/")
    short = F.when(F.locate(root.rstrip("/") + "/", path) == 1, F.substring(path, len(root.rstrip("/")) + 2, 100_000)).otherwise(path)
    return df.withColumn("path", F.url_decode(F.regexp_replace(short, r"\+", "%2B"))).drop("__file")


def _text_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    raw = reader.text(root, wholetext=True).select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("__file"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("_metadata.file_size").alias("size"),
    )
    return _named(raw, root)


def markdown_scan(spark: SparkSession, root: str, lite: bool = False) -> DataFrame:
    """Notes under a folder, with a column for each field. ``lite`` leaves the body out."""
    notes = _text_files(spark, root, "*.md").withColumn("basename", basename(F.col("path")))
    out = extract_fields(notes).withColumn("doc_type", F.lit("md"))
    return out.withColumn("body", F.lit("")) if lite else out


def html_scan(spark: SparkSession, root: str, numeric: bool = True) -> DataFrame:
    """HTML files: searched under their title (or file name), known under their file name."""
    return html_documents(_text_files(spark, root, "*.{html,htm}").withColumn("basename", basename(F.col("path"))), numeric=numeric)


def html_documents(pages: DataFrame, raw: str = "content", numeric: bool = False, names: Iterable[str] = tuple(ENTITIES)) -> DataFrame:
    """Rows with raw HTML as indexable documents. names: the named entities that are decoded in titles."""
    shown = pages.withColumn("title", html_title(F.col(raw), numeric, names)).withColumn("body", html_text(F.col(raw), numeric))
    return shown.withColumn("name", F.coalesce("title", "basename")).withColumn("doc_type", F.lit("html")).drop(raw)


def unread(spark: SparkSession, root: str, scanned: DataFrame, pattern: str) -> DataFrame:
    """(path, mtime_ms, size) of the files that a scan should have read and has not: their contents were corrupt or gone. The scan goes on without
    them; this tells and counts them, from the listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    raw = reader.load(root).select(F.col("path").alias("__file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    return _named(raw, root).join(scanned.select("path"), "path", "left_anti")


def wanted_extensions(pdf: bool = True, images: bool = False) -> tuple[str, ...]:
    return (("pdf",) if pdf else ()) + (K.IMAGE_EXTENSIONS if images else ())


def attachment_scan(spark: SparkSession, root: str, extract: Callable[[bytes], str | None], pdf: bool = True, images: bool = False, max_mb: float = 20, failed: DataFrame | None = None, timeout_s: float = READ_TIMEOUT_S) -> DataFrame:
    """Attachments of the wanted types and size with the text that ``extract`` finds; failures have null text and say why in
    ``error`` (``timeout`` for those that took longer than ``timeout_s``), so they can be counted.

    failed: (path) of attachments that are not tried again.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = reader.load(root).where(F.col("length") <= int(max_mb * 1024 * 1024)).withColumnRenamed("path", "__file")
    files = _named(raw, root).withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*wanted_extensions(pdf, images)))
    if failed is not None:
        files = files.join(failed.select("path"), "path", "left_anti")

    def run(parts):
        pool = ThreadPoolExecutor(1)
        for part in parts:
            texts, errors = [], []
            for content in part["content"]:
                text = error = None
                try:
                    text = pool.submit(extract, bytes(content)).result(timeout_s)
                except TimeoutError:
                    error = "timeout"
                    pool.shutdown(wait=False)  # its thread is left behind
                    pool = ThreadPoolExecutor(1)
                except Exception as e:  # a broken file is counted, not fatal
                    error = str(e) or type(e).__name__
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": part["path"], "ext": part["ext"], "mtime_ms": part["mtime_ms"], "size": part["length"], "text": texts, "error": errors})
        pool.shutdown(wait=False)

    timed = files.select("path", "ext", F.unix_millis("modificationTime").alias("mtime_ms"), "length", "content")
    return timed.mapInPandas(run, "path string, ext string, mtime_ms long, size long, text string, error string")


def file_catalog(listing: DataFrame) -> DataFrame:
    """Every file, of any type: path, basename, ext, mtime_ms, from a listing with path and mtime_ms."""
    return listing.select("path", basename(F.col("path")).alias("basename"), extension(F.col("path")).alias("ext"), "mtime_ms")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime_ms and size of every file under a folder; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _named(raw.select(F.col("path").alias("__file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")), root)


def extracted_texts(spark: SparkSession, path: str) -> DataFrame:
    """Cached attachment texts, JSON lines of path and text; others are dropped."""
    return spark.read.schema("path string, text string").option("mode", "DROPMALFORMED").json(path).where("path is not null and text is not null")


def write_extracted(texts: DataFrame, path: str) -> None:
    texts.select("path", "text").write.mode("overwrite").json(path)


def frecency_table(spark: SparkSession, path: str) -> DataFrame:
    """key, count, last_opened_ms from JSON lines; malformed entries are dropped."""
    raw = spark.read.schema("key string, count long, last_opened_ms long").option("mode", "DROPMALFORMED").json(path)
    return raw.where("key is not null and count is not null and last_opened_ms is not null")


def write_frecency(table: DataFrame, path: str) -> None:
    table.select("key", "count", "last_opened_ms").write.mode("overwrite").json(path)
