"""Benchmark: index build, persistence and batches of queries. Prints one JSON line.

BENCH_SF_DIR names the tables' folder, BENCH_CPUS the cores. ``queries`` has seconds for each step; the value is
their sum. Also given: documents and postings a second for the build, queries a second for the batch.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from findwell.operators import index as I
from findwell.operators.fuse import ordered, reciprocal_rank_fusion, with_rank
from findwell.operators.fuzzy import search_catalog
from findwell.plans import catalog
from findwell.plans.search import search, search_many


def batch(n: int, seed: int = 123456789) -> dict[int, str]:
    """n queries of two terms or a four-letter prefix, from a linear congruential generator."""
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of")
    out, x = {}, seed
    for q in range(n):
        words = []
        for _ in range(2):
            word = ""
            for _ in range(2):
                x = (x * 1103515245 + 12345) % (1 << 31)
                word += syllables[x % len(syllables)]
            words.append(word)
        out[q] = words[0][:4] if q % 2 else " ".join(words) + " "
    return out


def synthetic(n: int = 7200, size: int = 250, vocabulary: int = 4000, seed: int = 123456789) -> list[tuple[int, str, str, str, int]]:
    """The baseline's workload: documents of words of two to four syllables, named by two words and a number, over a year."""
    syllables, x = ("ka", "lo", "mi", "ne", "ru", "sa", "te", "vo", "di", "pe", "zu", "ga", "bo", "fi"), seed

    def draw(limit: int) -> int:
        nonlocal x
        x = (x * 1103515245 + 12345) % (1 << 31)
        return x * limit >> 31

    words = ["".join(syllables[draw(len(syllables))] for _ in range(2 + draw(3))) for _ in range(vocabulary)]
    pick = lambda: words[draw(vocabulary)]
    return [(i, f"n/{i}.md", f"{pick()} {pick()} {i}", " ".join(pick() for _ in range(size)), catalog.NOW_MS - draw(365) * 86_400_000) for i in range(n)]


def baseline(spark: SparkSession, home: str) -> dict[str, float]:
    """Seconds of the baseline's steps on its own workload: build with write, load, one query, and each of 40 queries in one plan."""
    rows = synthetic()
    docs = spark.createDataFrame(rows, "doc_id long, path string, basename string, body string, mtime_ms long").repartition(8).cache()
    docs.count()
    out, began = {}, time.time()

    def lap(name: str, by: int = 1) -> None:
        nonlocal began
        out[name] = round((time.time() - began) / by, 3)
        began = time.time()

    I.build_and_save(docs, f"{home}/baseline")
    lap("build_7200x250")
    index = I.load(spark, f"{home}/baseline").cache()
    lap("load")
    assert index.docs.count() == len(rows) and index.dictionary.count() > 4000
    words = rows[0][3].split()
    search(index, words[0] + " ", catalog.NOW_MS, fuzzy="off").collect()
    began = time.time()
    for w in words[1:6]:
        assert search(index, w + " ", catalog.NOW_MS, fuzzy="off").count()
    lap("one_query", 5)
    many = {q: (words[q][:4] if q % 2 else f"{words[q]} {words[q + 50]} ") for q in range(40)}
    found = search_many(index, many, catalog.NOW_MS, fuzzy="off").groupBy("query_id").count().collect()
    lap("each_of_40_queries", 40)
    assert len(found) == 40
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    home = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}

    def timed(name: str, run):
        began = time.time()
        out = run()
        took[name] = round(time.time() - began, 3)
        return out

    try:
        spark.range(1000).selectExpr("sum(id)").collect()
        docs = catalog.corpus(spark, sf)
        timed("tokenize", lambda: catalog.tokenize_terms(spark, sf).write.format("noop").mode("overwrite").save())
        # postings are computed once: the dictionary and lengths read what was written
        timed("build_and_save", lambda: I.build_and_save(docs, f"{home}/index"))
        index = timed("load", lambda: I.load(spark, f"{home}/index").cache())
        n_docs, n_postings = index.docs.count(), index.postings.count()
        assert n_docs == docs.count() and index.docs.agg(F.countDistinct("doc_id")).first()[0] == n_docs
        index.dictionary.count(), index.stats.count()


        def ask(raw: str, **options):
            def run():
                found = search(index, raw, catalog.NOW_MS, **options).collect()
                assert found and [r["rank"] for r in found] == list(range(1, len(found) + 1)), raw
                return found

            return run

        timed("query_first", ask("with from ", fuzzy="off"))
        timed("query_term", ask("the ", fuzzy="off"))
        timed("query_terms", ask("with from that ", fuzzy="off"))
        timed("query_prefix", ask("with th", fuzzy="off"))
        timed("query_phrase", ask('"of the"', fuzzy="off"))
        timed("query_filters", ask("the path:src1 tag:en -with ", fuzzy="off"))
        timed("query_fuzzy", ask("thinthh ", fuzzy="always"))
        many = batch(200)
        timed("batch_200_queries", lambda: search_many(index, many, catalog.NOW_MS, fuzzy="off").write.format("noop").mode("overwrite").save())
        files = index.docs.select("path", "basename", "mtime_ms")
        timed("file_finder", lambda: search_catalog(files, "theon").collect())

        def fused():
            words = with_rank(search(index, "with th", catalog.NOW_MS, fuzzy="off"), F.desc("score"), "path", most=20).select("path", "rank")
            names = with_rank(search_catalog(files, "with th"), F.desc("score"), "path", most=20).select("path", "rank")
            return ordered(reciprocal_rank_fusion([words, names], weights=[1.0, 0.6]), 20).collect()

        timed("fusion", fused)
        gone = index.docs.where("path like 'src3/%'")
        left = index.postings.join(gone.select("doc_id"), "doc_id", "left_anti").count()
        dense = timed("tombstone_compact", lambda: I.compact(I.tombstone(index, gone)).postings.count())
        assert dense == left
        print(
            json.dumps(
                {
                    "metric": "search engine: build, load and query", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")),
                    "cpus": int(cpus), "spark": spark.version, "docs": n_docs, "postings": n_postings, "docs_per_sec": round(n_docs / took["build_and_save"], 1),
                    "baseline": baseline(spark, home), "postings_per_sec": round(n_postings / took["build_and_save"], 1), "batch_queries_per_sec": round(len(many) / took["batch_200_queries"], 1),
                }
            )
        )
    finally:
        spark.stop()
        shutil.rmtree(home, ignore_errors=True)


if __name__ == "__main__":
    main()
