"""Markdown notes: front matter, headings, tags, and their fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import constants as K
from .text import fold

# Front-matter keys that are not searched as values.
SKIPPED_KEYS = ("aliases", "tags", "cssclass", "cssclasses", "position")


def strip_frontmatter(content: Column) -> Column:
    return F.regexp_replace(content, K.FRONTMATTER, "")


def headings(content: Column) -> Column:
    """array<struct<level, heading>> of the ATX headings in a note's body."""
    lines = F.filter(F.split(strip_frontmatter(content), r"\r?\n"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_replace(x, r"^#+\s+", ""), r"\s+#*\s*$", "").alias("heading")))


def heading_text(found: Column, top: bool) -> Column:
    """Level 1 or all deeper headings, joined."""
    mine = F.filter(found, lambda h: (h["level"] <= 1) if top else (h["level"] > 1))
    return F.array_join(F.transform(mine, lambda h: h["heading"]), " ")


def normalize_tags(*tags: Column) -> Column:
    """Folded, without leading #, trimmed, distinct in order of appearance."""
    folded = F.transform(F.concat(*tags), lambda t: F.trim(fold(F.regexp_replace(t, "^#", ""))))
    return F.array_distinct(F.filter(folded, lambda t: t.isNotNull() & (t != "")))


def inline_tags(content: Column) -> Column:
    return F.regexp_extract_all(strip_frontmatter(content), F.lit(r"(?:^|\s)#([\p{L}\p{N}_/\-]*[\p{L}_/\-][\p{L}\p{N}_/\-]*)"), 1)


def string_list(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def leaves(value: object) -> list[str]:
    """All scalar leaves as text, depth first; nulls are skipped."""
    if value is None:
        return []
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, float) and value.is_integer():
        return [str(int(value))]
    return [str(value)]


@F.pandas_udf(StructType([StructField("aliases", StringType()), StructField("tags", ArrayType(StringType())), StructField("texts", StringType())]))
def frontmatter_fields(documents: pd.Series) -> pd.DataFrame:
    """From front matter as JSON (any nesting): aliases, tags, and the other leaves. Malformed JSON counts as none."""
    rows = []
    for raw in documents:
        try:
            data = json.loads(raw) if raw else {}
        except ValueError:
            data = {}
        data = data if isinstance(data, dict) else {}
        rest = [x for k, v in data.items() if k not in SKIPPED_KEYS for x in leaves(v)]
        rows.append((" ".join(string_list(data.get("aliases"))), string_list(data.get("tags")), " ".join(rest)))
    return pd.DataFrame(rows, columns=["aliases", "tags", "texts"])


def extract_fields(notes: DataFrame) -> DataFrame:
    """Notes (path, basename, content, optional frontmatter JSON, optional meta_tags) with a text column for each field.

    ``tags`` becomes the tag strings' text, ``tag_list`` the tags themselves.
    """
    fm = frontmatter_fields(F.coalesce("frontmatter", F.lit(""))) if "frontmatter" in notes.columns else None
    found = notes.withColumn("__fm", fm) if fm is not None else notes.withColumn("__fm", F.lit(None).cast("struct<aliases:string,tags:array<string>,texts:string>"))
    none = F.array().cast("array<string>")
    inline = F.coalesce("meta_tags", none) if "meta_tags" in notes.columns else inline_tags(F.coalesce("content", F.lit("")))
    shown = headings(F.coalesce("content", F.lit("")))
    out = found.withColumn("tag_list", normalize_tags(inline, F.coalesce("__fm.tags", none)))
    return (
        out.withColumn("aliases", F.coalesce("__fm.aliases", F.lit(""))).withColumn("h1", heading_text(shown, True)).withColumn("h2h3", heading_text(shown, False))
        .withColumn("tags", F.array_join("tag_list", " ")).withColumn("frontmatter", F.coalesce("__fm.texts", F.lit("")))
        .withColumn("body", strip_frontmatter(F.coalesce("content", F.lit("")))).drop("__fm", "content", "meta_tags")
    )
