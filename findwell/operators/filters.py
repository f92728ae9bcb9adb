"""Predicates over documents, as Columns and as joins."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K


def _tagged(prefix: str) -> Column:
    return F.exists("tags", lambda t: t.startswith(prefix))


def allowed(docs: DataFrame, path_filters=(), tag_filters=(), min_mtime: int | None = None) -> DataFrame:
    """Live documents that pass: the folded path holds each path filter, some tag starts with each tag filter."""
    tests: list[Column] = [~F.col("deleted")]
    tests += [F.col("folded_path").contains(p) for p in path_filters]
    tests += [_tagged(f) for f in tag_filters]
    if min_mtime is not None:
        tests.append(F.col("mtime_ms") >= min_mtime)
    return docs.where(reduce(Column.__and__, tests))


def excluding(docs: DataFrame, postings: DataFrame, terms: list[str]) -> DataFrame:
    """Without documents that have one of the terms in any field."""
    if not terms:
        return docs
    return docs.join(postings.where(F.col("term").isin(terms)).select("doc_id"), "doc_id", "left_anti")


TYPE_TESTS = {
    "note": (("md",), "md"),
    "pdf": (("pdf",), "pdf"),
    "image": (K.BROWSE_IMAGE_EXTENSIONS, "image"),
    "html": (("html", "htm"), "html"),
    "canvas": (("canvas",), None),
    "base": (("base",), None),
    "audio": (K.AUDIO_EXTENSIONS, None),
    "video": (K.VIDEO_EXTENSIONS, None),
}
INDEXED_TYPES = ("note", "pdf", "image", "html")


def of_type(kind: str, ext: Column, doc_type: Column | None = None) -> Column:
    """One of the eight file-type filters."""
    extensions, typed = TYPE_TESTS[kind]
    test = ext.isin(*extensions)
    return test | (doc_type == typed) if typed and doc_type is not None else test


DATE_PRESETS = {"today": 0, "week": 7, "month": 30, "year": 365}


def since(preset: str, now_ms: int, zone: str | None = None) -> int:
    """The oldest time of a date preset: midnight for today, a rolling span for the others. zone: where midnight is; by
    default the session's time zone."""
    if preset != "today":
        return now_ms - DATE_PRESETS[preset] * K.DAY_MS
    if zone is None:
        active = SparkSession.getActiveSession()
        zone = active.conf.get("spark.sql.session.timeZone") if active else "UTC"
    now = datetime.fromtimestamp(now_ms / 1000, ZoneInfo(zone))
    return int(now.replace(hour=0, minute=0, second=0, microsecond=0).timestamp() * 1000)


# Word lists of the destructive-command heuristic.
VIEW_VERBS = r"(?i)^(show|open|view|reveal)\b"
STRONG_VERBS = r"(?i)\b(delete|trash|erase|wipe|purge|overwrite)\b"
WEAK_VERBS = r"(?i)\b(remove|clear|reset|discard)\b"
DATA_NOUNS = r"(?i)\b(files?|notes?|folders?|vaults?|attachments?|history|data|database|cache|backups?|all)\b"


def is_destructive(text: Column) -> Column:
    """Whether a command's name and id say that it destroys data."""
    return ~text.rlike(VIEW_VERBS) & (text.rlike(STRONG_VERBS) | text.rlike(WEAK_VERBS) & text.rlike(DATA_NOUNS))


def is_task_line(text: Column) -> Column:
    return text.rlike(K.TASK)
