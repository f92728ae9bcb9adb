"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again for the next. All but the last return the columns of ``documents``. Rows are followed by a hash of
doc_id and text, so rows with a null or shared doc_id pass on their own text. SQL cannot express the stages
(ORACLE_SQL is None); tests/llm compares them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findwell.llm import decontaminate, quality_rules, resemblance, suffix_dedup
from findwell.llm.common import materialize, release, table
from findwell.llm.queries import packed as packed_by_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8), by SimHash trees
    and MinHash, confirmed on the shingles; one of repeated rows."""
    own = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    groups = resemblance.near_duplicates(own, "__row", "text")
    named = groups.distinct().join(own.select(F.col("__row").alias("row"), "doc_id").distinct(), "row")
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("__row")).select("__row")
    first = Window.partitionBy("__row").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    left = own.join(kept, "__row", "left_semi")
    return left.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or strings of 400 bytes, that occur elsewhere; documents with nothing left go."""
    cut = suffix_dedup.dedup_text(docs, words=suffix_dedup.WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, in tokens, and their bins."""
    return packed_by_tokens(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            release(written)
        written = docs
    return docs
