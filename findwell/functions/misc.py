"""Small scalar functions: file types, dates, captures, settings."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import fold_text

# Day keywords (English, Italian) with their offsets, and the capture heading.
DAY_WORDS = {"today": 0, "oggi": 0, "yesterday": -1, "ieri": -1, "tomorrow": 1, "domani": 1}
DAY_LABELS = {0: "Today", -1: "Yesterday", 1: "Tomorrow"}
CAPTURE_HEADING = "## 🌱 Capture"
DAILY_DIR = "Journal/Daily"
FEW_RESULTS = 3


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path part, or empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def extension_anywhere(path: Column) -> Column:
    """After the last dot wherever it is, as the HTTP answer has it."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def doc_type(ext: Column) -> Column:
    return F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm"), "html").when(ext.isin(*K.FINDER_IMAGE_EXTENSIONS), "image").otherwise("md")


def basename(path: Column) -> Column:
    """The last path part without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def match_date_keyword(raw: str, now_ms: int) -> tuple[str, str] | None:
    """(label, ISO date) of a query that is exactly a day keyword; calendar days in UTC."""
    offset = DAY_WORDS.get(fold_text(raw.strip()))
    if offset is None:
        return None
    day = datetime.fromtimestamp(now_ms / 1000, UTC) + timedelta(days=offset)
    return DAY_LABELS[offset], day.date().isoformat()


def date_keyword(query: Column, today: Column) -> Column:
    """The same for a column: the date, or null."""
    from .text import fold

    pairs = [F.lit(x) for kv in DAY_WORDS.items() for x in kv]
    offset = F.try_element_at(F.create_map(*pairs), fold(F.trim(query)))
    return F.date_add(today, offset)


def daily_basename(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def daily_path(day: Column) -> Column:
    return F.concat(F.lit(DAILY_DIR + "/"), daily_basename(day), F.lit(".md"))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def capture_line(text: Column, day: Column) -> Column:
    """A task becomes a checkbox with a due date, everything else a bullet."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = trimmed(F.regexp_replace(text, K.TASK + r"\s*", ""))
    return F.when(text.rlike(K.TASK), F.concat(F.lit("- [ ] "), body, F.lit(" 📅 "), iso_date(day))).otherwise(F.concat(F.lit("- "), trimmed(text)))


def append_to_capture(content: str, line: str) -> str:
    """Adds a line at the end of the capture section, which is made if it is missing."""
    before, heading, after = content.partition(CAPTURE_HEADING)
    if not heading:
        return f"{content.removesuffix(chr(10))}\n\n{CAPTURE_HEADING}\n{line}\n"
    rest, own = after.partition("\n")[2], after.partition("\n")[0]
    section, mark, following = rest.partition("\n#")
    if rest.startswith("#"):
        section, mark, following = "", "#", rest[1:]
    else:
        mark = mark.removeprefix("\n")
    top = f"{before}{heading}{own}\n{section}".rstrip("\n")
    return re.sub(r"\n{3,}", "\n\n", f"{top}\n{line}\n{mark}{following}")


@dataclass(frozen=True)
class Settings:
    http_enabled: bool = False
    http_port: int = 51361
    http_token_hash: str = ""
    index_pdf: bool = True
    index_images: bool = False
    index_html: bool = True
    max_attachment_mb: float = 20
    max_results: int = K.DEFAULT_LIMIT
    show_score_debug: bool = False
    body_fuzzy: str = "on-sparse"
    browse_sort: str = "relevance"
    pull_to_search: bool = True


def _number(value: object) -> float:
    try:
        return float(value) if value is not None and not isinstance(value, (list, dict)) else math.nan
    except ValueError:
        return math.nan


def parse_settings(data: dict | None) -> Settings:
    """Settings from loose data: values that are missing or make no sense take their defaults."""
    d, base = data or {}, Settings()

    def number(key: str, default: float, whole: bool, low: float, high: float) -> float:
        x = _number(d.get(key))
        fits = math.isfinite(x) and low < x < high and (not whole or x == int(x))
        return (int(x) if whole else x) if fits else default

    def one_of(key: str, values: tuple[str, ...], default: str) -> str:
        return d[key] if d.get(key) in values else default

    def flag(key: str, default: bool) -> bool:
        return default if d.get(key) is None else bool(d[key])

    token = d.get("httpTokenHash")
    return Settings(
        http_enabled=bool(d.get("httpEnabled")),
        http_port=number("httpPort", base.http_port, True, 0, 65536),
        http_token_hash=token.lower() if isinstance(token, str) and re.fullmatch("[a-fA-F0-9]{64}", token) else "",
        index_pdf=flag("indexPdf", base.index_pdf),
        index_images=flag("indexImages", base.index_images),
        index_html=flag("indexHtml", base.index_html),
        max_attachment_mb=number("maxAttachmentMB", base.max_attachment_mb, False, 0, math.inf),
        max_results=number("maxResults", base.max_results, True, 0, 51),
        show_score_debug=bool(d.get("showScoreDebug")),
        body_fuzzy=one_of("bodyFuzzy", ("off", "always"), base.body_fuzzy),
        browse_sort=one_of("browseSort", ("relevance", "created", "modified", "viewed"), base.browse_sort),
        pull_to_search=flag("pullToSearchEnabled", base.pull_to_search),
    )


# File-type icons by extension, then by document type.
ICONS = {
    "md": "file-text", "pdf": "file-type", "html": "globe", "htm": "globe", "canvas": "layout-dashboard", "base": "table",
    **dict.fromkeys(K.BROWSE_IMAGE_EXTENSIONS, "image"), **dict.fromkeys(K.AUDIO_EXTENSIONS, "music"), **dict.fromkeys(K.VIDEO_EXTENSIONS, "video"), "image": "image",
}


def icon(ext: Column, kind: Column) -> Column:
    """icon_for() for columns."""
    known = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.try_element_at(known, kind), F.lit("file"))


def suggestions(raw: str, found: int, now_ms: int, assistant: bool = False) -> list[dict[str, str]]:
    """Rows that a result list gets besides its own: a daily note for a day keyword (it stands first), the offer of a new
    note when fewer than three rows were found, and of a question where an assistant is present."""
    query, rows = raw.strip(), []
    if day := match_date_keyword(raw, now_ms):
        label, iso = day
        year, month, date = iso.split("-")
        rows.append({"kind": "date", "title": label, "path": f"{DAILY_DIR}/{date}-{month}-{year}.md"})
    if query and found < FEW_RESULTS:
        rows.append({"kind": "create", "title": query, "path": f"{query}.md"})
    if query and assistant:
        rows.append({"kind": "ask", "title": query, "path": ""})
    return rows


def icon_for(ext: str, kind: str) -> str:
    return ICONS.get(ext.lower()) or ICONS.get(kind, "file")
