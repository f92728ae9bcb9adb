"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, importance, packing, quality_rules, simhash, suffix_dedup, token_orc, toxicity
from .common import new_path, reachable, table

TOKENIZER = "word_bpe_49k.json"
SAMPLE_SHARE = 0.85


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "start", "stop", "edits")


def op2_token_orc(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    token_orc.write(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path(TOKENIZER))
    return token_orc.read_digest(spark, path)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat_format.format_digest(own.unionByName(extra)).withColumnRenamed("tree", "conv_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400-byte digest, and how many words of the document stand in passages of over 50 words that are found elsewhere
    too: such a passage has about 320 bytes, so few of them reach 400."""
    found = suffix_dedup.removal(table(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", (F.col("passage_words") > 0).alias("has_passages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("key", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.score(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("key", "doc_id").drop("repeat_spans")


def op8_best_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer)


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Documents packed by their number of tokens, the end id included."""
    import public_tokenizers

    counted = token_orc.counts(docs, tokenizer or public_tokenizers.path(TOKENIZER))
    return packing.assign(counted, "key", F.col("n_tokens")).withColumnRenamed("key", "doc_id")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), SAMPLE_SHARE)
    return found.withColumnRenamed("key", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _with_workers(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
        reachable(spark)
        return query(spark, sf_dir, **more)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_decontaminate": op1_decontaminate,
        "op2_token_orc": op2_token_orc,
        "op3_simhash": op3_simhash,
        "op4_chat_format": op4_chat_format,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op8_best_fit": op8_best_fit,
        "op9_html_extract": op9_html_extract,
        "op10_importance": op10_importance,
        "pipeline": pipeline,
    }
    return {name: _with_workers(query) for name, query in found.items()}


def _chat_sql() -> str:
    """The digest from the table itself. The size adds the template's marks, one character for each backslash and one
    for each control string."""
    control = "|".join(re.escape(x) for x in chat_format.CONTROL).replace("'", "''")
    probe = "</s>[INST] ok [/INST]"
    size = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{control}'))"
    frame = len(chat_format.START) + len(chat_format.END) + 2
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({frame} + {size("role")} + length(role) - length(replace(role, chr(10), '')) + {size("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express: the other operators' hashes, arrays, trees and models are tested by brute force."""
    return {"op4_chat_format": _chat_sql()}
