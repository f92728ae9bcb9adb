"""Folding and tokenizing.

The Column forms stay inside the JVM. A token is (term, pos): ``pos`` counts case segments, so it
goes on where a token is dropped, and a run of several segments also gives a compound token at
its first position. Case boundaries are marked in the text first, so one pattern takes all segments of
a document as one flat array and a segment's position is its index there: no window and no running sum.

The Python forms do the same on the driver (queries) and keep source offsets (excerpts).
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = r"[\p{L}\p{N}]+"
# a boundary before an upper-case letter that follows anything else, and before the last upper-case letter of an acronym
MARK = "\x01"  # a control character: it is part of no word
HUMP = r"(?<=[\p{L}\p{N}&&[^\p{Lu}]])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def fold(col: Column) -> Column:
    """Compatibility-decomposed, without marks, lower-cased. ASCII values, told by their size, are only
    lower-cased; for others the decomposition of the ICU library, which Spark ships, is called inside the JVM."""
    plain = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), col, F.lit(True))
    full = F.lower(F.regexp_replace(plain, r"\p{M}", ""))
    return F.when(col.isNull() | (F.octet_length(col) == F.length(col)), F.lower(col)).otherwise(full)


def blank_schemes(col: Column) -> Column:
    """URL schemes become spaces of equal length, so that they are no terms and offsets stay."""
    return F.regexp_replace(F.regexp_replace(col, "(?i)https://", " " * 8), "(?i)http://", " " * 7)


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units, on which length limits are defined."""
    return (F.octet_length(F.encode(col, "UTF-16LE")) / 2).cast("int")


def marked(col: Column) -> Column:
    """The text with a mark at each case boundary inside a word."""
    return F.regexp_replace(F.translate(blank_schemes(col), MARK, " "), HUMP, MARK)


def segments(text: Column) -> Column:
    """array<string> from a marked text: all case segments in order; those that the word goes on after end with the mark."""
    return F.regexp_extract_all(text, F.lit(f"{RUN}{MARK}?"), F.lit(0))


def compounds(text: Column, parts: Column) -> Column:
    """array<struct<seg, pos>> from a marked text and its segments: words of several segments, at the place of their first
    segment. ``parts`` must be a column or a bound variable, as it is read at each place."""
    words = F.regexp_extract_all(text, F.lit(f"(?:{RUN}{MARK})+{RUN}"), F.lit(0))
    goes_on = lambda i: F.get(parts, i).endswith(MARK)
    heads = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: goes_on(i) & ((i == 0) | ~goes_on(i - 1)))
    found = F.zip_with(words, heads, lambda w, i: F.struct(F.translate(w, MARK, "").alias("seg"), i.alias("pos")))
    return F.when(text.contains(MARK), found).otherwise(F.array().cast("array<struct<seg:string,pos:int>>"))


def tokens(col: Column) -> Column:
    """array<struct<term, pos>> in the order of positions, compounds after their first segment."""

    def cut(text: Column, parts: Column) -> Column:
        single = F.transform(parts, lambda s, i: F.struct(i.alias("pos"), F.lit(0).alias("kind"), F.translate(s, MARK, "").alias("raw")))
        whole = F.transform(compounds(text, parts), lambda c: F.struct(c["pos"].alias("pos"), F.lit(1).alias("kind"), c["seg"].alias("raw")))
        folded = F.transform(F.array_sort(F.concat(single, whole)), lambda t: F.struct(fold(t["raw"]).alias("term"), t["pos"].alias("pos")))
        return F.filter(folded, lambda t: long_enough(t["term"]))

    bound = F.struct(marked(col).alias("text"), segments(marked(col)).alias("parts"))
    return F.get(F.transform(F.array(bound), lambda b: cut(b["text"], b["parts"])), F.lit(0))


def long_enough(term: Column) -> Column:
    """Two UTF-16 units or more: several characters, or an astral one."""
    return (F.length(term) > 1) | (F.octet_length(term) > 3)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Dealt out by key into at least as many parts as there are cores: cutting texts is work for the processor, and
    later aggregations by key need no other exchange."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def word_rows(df: DataFrame, key: str, fields: dict[int, Column]) -> DataFrame:
    """(key, field, pos, raw): the words of several text columns as rows, not yet folded.

    A word of several segments travels in the same array as the segments do, as mark, position, mark, word.
    """

    def cut(field: int, text: Column, parts: Column) -> Column:
        coded = F.transform(compounds(text, parts), lambda c: F.concat(F.lit(MARK), c["pos"].cast("string"), F.lit(MARK), c["seg"]))
        return F.struct(F.lit(field).alias("field"), F.concat(parts, coded).alias("words"))

    texts = df.select(key, *[marked(c).alias(f"__{i}") for i, c in fields.items()])
    texts = texts.select("*", *[segments(F.col(f"__{i}")).alias(f"__s{i}") for i in fields])
    each = texts.select(key, F.inline(F.array(*[cut(i, F.col(f"__{i}"), F.col(f"__s{i}")) for i in fields])))
    rows = each.select(key, "field", F.posexplode("words").alias("at", "word"))
    whole = F.col("word").startswith(MARK)
    pos = F.when(whole, F.split_part("word", F.lit(MARK), F.lit(2)).cast("int")).otherwise(F.col("at"))
    raw = F.when(whole, F.split_part("word", F.lit(MARK), F.lit(3))).otherwise(F.rtrim("word", F.lit(MARK)))
    return rows.select(key, "field", pos.alias("pos"), raw.alias("raw"))


def token_rows(df: DataFrame, key: str, fields: dict[int, Column]) -> DataFrame:
    """(key, field, term, pos): the tokens of several text columns as rows, folded row by row."""
    spread = dealt(df.select(key, *[c.alias(f"__{i}") for i, c in fields.items()]), key)
    words = word_rows(spread, key, {i: F.col(f"__{i}") for i in fields})
    return words.select(key, "field", fold(F.col("raw")).alias("term"), "pos").where(long_enough(F.col("term")))


def terms(col: Column) -> Column:
    """array<string>: the tokens without positions."""
    return F.transform(tokens(col), lambda t: t["term"])


class Token(NamedTuple):
    text: str
    start: int
    end: int
    pos: int


def fold_text(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.category(c).startswith("M")).lower()


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


def _word_char(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


_SCHEME = re.compile(r"https?://", re.I)
_RUN = re.compile(r"[^\W_]+")  # letters and numbers of any script


def _humps(run: str) -> list[int]:
    upper = [unicodedata.category(c) == "Lu" for c in run]
    cuts = [i for i in range(1, len(run)) if upper[i] and (not upper[i - 1] or i + 1 < len(run) and unicodedata.category(run[i + 1]) == "Ll")]
    return [0, *cuts, len(run)]


def tokenize(text: str) -> list[Token]:
    """Tokens with code-point offsets."""
    scan = _SCHEME.sub(lambda m: " " * len(m[0]), text)
    out, pos, at = [], 0, 0
    while at < len(scan):
        if not _word_char(scan[at]):
            at += 1
            continue
        end = at
        while end < len(scan) and _word_char(scan[end]):
            end += 1
        cuts, first = _humps(text[at:end]), pos
        pieces = [(at + a, at + b, first + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        pos += len(pieces)
        if len(pieces) > 1:
            pieces.append((at, end, first))
        for a, b, p in pieces:
            if units(folded := fold_text(text[a:b])) > 1:
                out.append(Token(folded, a, b, p))
        at = end
    return out


def term_list(text: str) -> list[str]:
    return [t.text for t in tokenize(text)]


CACHED_WORDS = 1 << 16
_known: dict[str, str | tuple[tuple[int, str], ...]] = {}


def _word(run: str) -> str | tuple[tuple[int, str], ...]:
    """What a run gives: its term (empty if too short), or for several segments their number, and (offset, term) of each and of the whole."""
    if run[1:] == run[1:].lower() or len(cuts := _humps(run)) == 2:
        term = fold_text(run)
        found = term if units(term) > 1 else ""
    else:
        own = [(i, fold_text(run[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        found = (len(own), *((i, t) for i, t in [*own, (0, fold_text(run))] if units(t) > 1))
    if len(_known) >= CACHED_WORDS:
        _known.clear()
    _known[run] = found
    return found


def term_places(text: str) -> dict[str, list[int]]:
    """Each term of a text with its positions; a compound and its first segment may share one."""
    if "://" in text:
        text = _SCHEME.sub(lambda m: " " * len(m[0]), text)
    known, places, pos = _known, defaultdict(list), 0
    for run in _RUN.findall(text):
        found = known.get(run)
        if found is None:
            found = _word(run)
        if found.__class__ is str:
            if found:
                places[found].append(pos)
            pos += 1
        else:
            for i, term in found[1:]:
                places[term].append(pos + i)
            pos += found[0]
    return places
