"""Search providers, their registry, and the HTTP-shaped answers."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.misc import doc_type, extension, extension_anywhere
from ..operators.excerpt import with_excerpts
from ..operators.fuse import apply_frecency, ordered, reciprocal_rank_fusion, with_rank
from ..operators.fuzzy import search_catalog
from ..operators.index import Index
from .search import search, with_weights


class SearchProvider(Protocol):
    name: str
    weight: float
    deep: bool  # a slower provider, asked in the second wave

    def search(self, raw: str, limit: int) -> DataFrame: ...


class KeywordProvider:
    name, weight, deep = "keyword", 1.0, False

    def __init__(self, index: Index, now_ms: int, opened: DataFrame | None = None, excerpts: bool = False, **options):
        self.index, self.now_ms, self.opened, self.excerpts, self.options = index, now_ms, opened, excerpts, options

    def search(self, raw: str, limit: int) -> DataFrame:
        found = search(self.index, raw, self.now_ms, limit=limit, **self.options)
        if self.opened is not None:
            found = apply_frecency(found, self.opened, self.now_ms)
        if self.excerpts:
            found = with_excerpts(with_weights(self.index, found.join(self.index.docs.select("doc_id", "body"), "doc_id")), weights="weights").drop("body", "weights")
        return found.withColumn("ext", extension(F.col("path"))).withColumn("source", F.lit(self.name))


class FileProvider:
    """Finds files of any type by name. It sees the raw query and no filters; ``strict`` skips queries with operators."""

    name, weight, deep = "file", K.FILE_WEIGHT, False

    def __init__(self, catalog: DataFrame):
        self.catalog = catalog

    def search(self, raw: str, limit: int) -> DataFrame:
        found = search_catalog(self.catalog, raw, limit)
        return found.withColumn("doc_type", doc_type(F.col("ext"))).withColumn("source", F.lit(self.name))


class ProviderRegistry:
    """Asks every provider and fuses the lists, or returns them as sections. A failing provider has no rows."""

    def __init__(self, *providers: SearchProvider, on_error: Callable[[str, Exception], None] | None = None):
        self.providers = list(providers)
        self.on_error = on_error

    def register(self, provider: SearchProvider) -> None:
        self.providers.append(provider)

    def sections(self, raw: str, limit: int = K.DEFAULT_LIMIT, deep: bool = True) -> dict[str, DataFrame]:
        """deep: whether the slower providers are asked as well."""
        out = {}
        for p in self.providers:
            if p.deep and not deep:
                continue
            try:
                out[p.name] = p.search(raw, limit)
            except Exception as e:  # one broken source must not take the others down
                if self.on_error:
                    self.on_error(p.name, e)
        return out

    def waves(self, raw: str, limit: int = K.DEFAULT_LIMIT) -> Iterator[DataFrame]:
        """The fused list of the instant providers, then, where there are deep ones, that of all."""
        yield self.fused(raw, limit, deep=False)
        if any(p.deep for p in self.providers):
            yield self.fused(raw, limit)

    def fused(self, raw: str, limit: int = K.DEFAULT_LIMIT, deep: bool = True) -> DataFrame:
        found = self.sections(raw, limit, deep)
        columns = ("path", "basename", "doc_type", "ext", "mtime_ms", "source")
        lists, weights = [], []
        for p in self.providers:
            if p.name in found:
                rows = with_rank(found[p.name], F.desc("score"), "path", most=limit)
                lists.append(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns], "rank"))
                weights.append(p.weight)
        return ordered(reciprocal_rank_fusion(lists, weights=weights), limit)


def http_limit(value: str | None) -> int:
    """The limit parameter: a positive whole number, capped; the default otherwise."""
    try:
        n = float(value or "")
    except ValueError:
        return K.HTTP_LIMIT
    return min(int(n), K.HTTP_CAP) if n > 0 and n == int(n) else K.HTTP_LIMIT


def http_rows(results: DataFrame) -> DataFrame:
    """One JSON document (``value``) for each result, in the shape of the search endpoint."""
    text = F.coalesce("excerpt.text", F.lit(""))
    ranges = F.coalesce("excerpt.ranges", F.array().cast("array<struct<start:int,end:int>>"))
    matches = F.transform(ranges, lambda r: F.struct(F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("match"), r["start"].alias("offset")))
    shape = F.struct(
        "score", "path", "basename", F.col("doc_type").alias("type"), extension_anywhere(F.col("path")).alias("ext"), text.alias("excerpt"),
        F.col("matched").alias("foundWords"), matches.alias("matches"),
    )
    return results.select(F.to_json(shape).alias("value"))


class SearchEndpoint:
    """The HTTP routes as a function of the request, for any server: (status, JSON text)."""

    def __init__(self, index: Index, token_hash: str, now_ms: Callable[[], int], opened: DataFrame | None = None):
        self.index, self.token_hash, self.now_ms, self.opened = index, token_hash, now_ms, opened

    def handle(self, method: str, path: str, params: dict[str, str], host: str, authorization: str | None) -> tuple[int, str]:
        name = host.rsplit(":", 1)[0] if not host.endswith("]") else host
        if name not in ("127.0.0.1", "localhost", "[::1]"):
            return 403, json.dumps({"error": "forbidden"})
        token = (authorization or "").removeprefix("Bearer ") if (authorization or "").startswith("Bearer ") else ""
        digest = hashlib.sha256(token.encode()).hexdigest()
        if not token or not self.token_hash or not hmac.compare_digest(digest, self.token_hash.lower()):
            return 401, json.dumps({"error": "unauthorized"})
        if method != "GET":
            return 405, json.dumps({"error": "method not allowed"})
        try:
            if path == "/health":
                return 200, json.dumps({"status": "ok", "ready": True, "docs": self.index.live.count()})
            if path == "/search":
                raw = params.get("q", "")
                if not raw.strip():
                    return 200, "[]"
                provider = KeywordProvider(self.index, self.now_ms(), self.opened, excerpts=True)
                rows = provider.search(raw, http_limit(params.get("limit"))).orderBy(F.desc("score"), "path")
                return 200, "[" + ",".join(r[0] for r in http_rows(rows).collect()) + "]"
        except Exception as e:
            return 500, json.dumps({"error": str(e)})
        return 404, json.dumps({"error": "not found"})
