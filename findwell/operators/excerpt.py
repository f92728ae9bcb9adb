"""Excerpts with highlight ranges, for the few rows of a result (never for a corpus)."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import Token, tokenize

ELLIPSIS = "…"
# Suffixes of embeds that are pictures.
PICTURES = ("png", "jpg", "jpeg", "webp", "gif", "svg", "avif", "bmp")
SCHEMA = "text string, ranges array<struct<start:int,end:int>>"


def _stretch(hits: list[Token], max_chars: int, weights: dict[str, float]) -> tuple[int, int]:
    """From which hit to which (inclusive) the distinct terms weigh most, within ``max_chars``; the earliest of equals.

    Both ends move forward only: the right one takes hits in, the left one gives up what lies too far back.
    """
    inside: Counter[str] = Counter()
    left, best, found = 0, 0.0, (0, 0)
    for right, hit in enumerate(hits):
        inside[hit.text] += 1
        while left < right and hit.end - hits[left].start > max_chars:
            inside[hits[left].text] -= 1
            left += 1
        weight = math.fsum(weights.get(t, 1.0) for t, n in inside.items() if n)
        if weight > best or not right:
            best, found = weight, (left, right)
    # the last hit that still fits behind the first one belongs to the stretch as well
    first, last = found
    while last + 1 < len(hits) and hits[last + 1].end - hits[first].start <= max_chars:
        last += 1
    return first, last


def _bounds(source: str, lo: int, hi: int, max_chars: int) -> tuple[int, int]:
    """The stretch with what room is left shared out on both sides, without the halves of words at its edges."""
    room = max(0, max_chars - (hi - lo))
    start, stop = max(0, lo - room // 2), min(len(source), hi + room - room // 2)
    before, after = source[start:lo], source[hi:stop]
    if start and not source[start - 1].isspace():
        gap = re.search(r"\s", before)
        start = lo if gap is None else start + gap.end()
    if stop < len(source) and not source[stop].isspace():
        gap = re.search(r"\s\S*\Z", after)
        stop = hi if gap is None else hi + gap.start()
    return start, stop


def make_excerpt(source: str, terms, max_chars: int = K.EXCERPT_CHARS, weights: dict[str, float] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The stretch of at most about ``max_chars`` with the largest weight of distinct terms, and where they stand in it."""
    wanted = frozenset(terms)
    hits = [t for t in tokenize(source) if t.text in wanted] if wanted else []
    if hits:
        first, last = _stretch(hits, max_chars, weights or {})
        start, stop = _bounds(source, hits[first].start, hits[last].end, max_chars)
    else:
        start, stop = 0, min(len(source), max_chars)
    shown = re.sub(r"[\r\n\t]", " ", source[start:stop])
    head, tail = ELLIPSIS * (start > 0), ELLIPSIS * (stop < len(source))
    return head + shown + tail, [(t.start - start + len(head), t.end - start + len(head)) for t in hits if start <= t.start and t.end <= stop]


def render_highlight(text: str, ranges) -> str:
    """The text as HTML with <mark> around ranges, clipped to the text; of overlapping ones the first is taken."""
    out, at = [], 0
    for start, end in sorted((r[0], min(r[1], len(text))) for r in ranges):
        if start < at or end <= start:
            continue
        out += [html.escape(text[at:start]), "<mark>", html.escape(text[start:end]), "</mark>"]
        at = end
    return "".join([*out, html.escape(text[at:])])


def with_excerpts(results: DataFrame, source: str = "body", matched: str = "matched", max_chars: int = K.EXCERPT_CHARS, weights: str | None = None) -> DataFrame:
    """Adds ``excerpt`` struct<text, ranges>; null where the source is empty. weights: a map<string, double> column."""

    @F.pandas_udf(SCHEMA)
    def cut(sources: pd.Series, terms: pd.Series, each: pd.Series) -> pd.DataFrame:
        rows = []
        for text, words, w in zip(sources, terms, each):
            found = make_excerpt(text or "", list(words) if words is not None else [], max_chars, dict(w) if w is not None else None)
            rows.append((found[0], [{"start": a, "end": b} for a, b in found[1]]))
        return pd.DataFrame(rows, columns=["text", "ranges"])

    scale = F.col(weights) if weights else F.lit(None).cast("map<string,double>")
    whole = F.coalesce(F.col(source), F.lit(""))
    # without a word to find the excerpt is the head of the text, which the JVM cuts: such texts do not go to Python
    sought = F.coalesce(F.size(matched), F.lit(0)) > 0
    tail = F.when(F.length(whole) > max_chars, ELLIPSIS).otherwise("")
    head = F.struct(F.concat(F.translate(F.substring(whole, 1, max_chars), "\r\n\t", "   "), tail).alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("ranges"))
    found = cut(F.when(sought, whole), F.when(sought, F.col(matched)), F.when(sought, scale))
    return results.withColumn("excerpt", F.when(whole != "", F.when(sought, found).otherwise(head)))


def title_ranges(basename: str, matched) -> list[tuple[int, int]]:
    return [(t.start, t.end) for t in tokenize(basename) if t.text in set(matched)]


def thumbnail_text(col):
    """A note's text for a small preview: without code blocks and embeds that are not images, the first characters."""
    plain = F.regexp_replace(F.regexp_replace(col, r"(?s)```.*?```", ""), r"(?s)~~~.*?~~~", "")
    plain = F.regexp_replace(plain, rf"(?i)!\[\[(?![^\]]*\.({'|'.join(PICTURES)}))[^\]]+\]\]", "")
    return F.substring(plain, 1, K.THUMBNAIL_CHARS)


def preview_text(col, doc_type):
    """Preview: a note without front matter from its first visible line, others as they are; cut to size."""
    from ..functions.markdown import strip_frontmatter

    note = F.substring(F.regexp_replace(strip_frontmatter(col), r"^\s+", ""), 1, K.PREVIEW_CHARS)
    return F.when(doc_type == "md", note).otherwise(col)
