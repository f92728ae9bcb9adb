"""The search-box grammar: terms, "phrases", -exclusions, path: and tag: filters, and mode sigils."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import fold_text, term_list

# a quoted run (to the end of input if it is not closed), or a word, which a quote ends
_CLAUSE = re.compile(r'"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+)')
_SIGILS = {">": "command", "+": "capture", "?": "intent"}


@dataclass
class ParsedQuery:
    raw: str
    terms: dict[str, bool] = field(default_factory=dict)  # term -> also a prefix
    phrases: list[list[str]] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    path_filters: list[str] = field(default_factory=list)
    tag_filters: list[str] = field(default_factory=list)

    @property
    def exact(self) -> list[str]:
        """Terms that retrieve: the query's own and those of its phrases, in order of appearance."""
        return list(dict.fromkeys([*self.terms, *(t for p in self.phrases for t in p)]))


def clauses(raw: str) -> list[tuple[str, str, bool]]:
    """(kind, text, still being typed): the last clause is, unless white space follows it."""
    found = [("phrase", m["phrase"]) if m["word"] is None else ("word", m["word"]) for m in _CLAUSE.finditer(raw)]
    typing = bool(raw) and not raw[-1].isspace()
    return [(kind, text, typing and i == len(found) - 1) for i, (kind, text) in enumerate(found)]


def parse_query(raw: str) -> ParsedQuery:
    q = ParsedQuery(raw)
    for kind, text, typing in clauses(raw):
        if kind == "phrase":
            if words := term_list(text):
                q.phrases.append(words)
        elif text.startswith("-"):
            q.exclusions += term_list(text[1:])
        elif text.startswith("path:"):
            if value := fold_text(text[5:]).strip():
                q.path_filters.append(value)
        elif text.startswith("tag:"):
            if value := fold_text(text[4:].removeprefix("#")).strip():
                q.tag_filters.append(value)
        else:
            for t in term_list(text):
                q.terms[t] = q.terms.get(t, False) or typing
    return q


def parse_mode(raw: str) -> tuple[str, str]:
    """(mode, rest): a sigil in the first place selects the mode; ``search`` otherwise."""
    mode = _SIGILS.get(raw[:1])
    return (mode, raw[1:].lstrip()) if mode else ("search", raw)
