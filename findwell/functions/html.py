"""Plain text and title of HTML documents, for indexing."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The named entities that are decoded; others stay as they are.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
_NUMERIC = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")


@F.pandas_udf(StringType())
def _numeric_entities(values: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return values.map(lambda s: None if s is None else _NUMERIC.sub(one, s))


def decode_entities(text: Column, numeric: bool = False, names: Iterable[str] = tuple(ENTITIES)) -> Column:
    """Named entities stay in the JVM; numeric ones need Python and are decoded on request, before the ampersand."""
    out = _numeric_entities(text) if numeric else text
    for name in names:
        out = F.regexp_replace(out, f"(?i)&{name};", ENTITIES[name])
    return out


def html_title(raw: Column, numeric: bool = False, names: Iterable[str] = tuple(ENTITIES)) -> Column:
    """names: the named entities that are decoded, all by default."""
    title = F.trim(decode_entities(F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1), numeric, names))
    return F.nullif(title, F.lit(""))


def html_text(raw: Column, numeric: bool = False) -> Column:
    """All text outside of scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(raw, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare, numeric), r"\s+", " "))
