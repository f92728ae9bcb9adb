"""The training-data operators against brute force, on small and awkward inputs."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from findwell.llm import chat_format as CH
from findwell.llm import decontaminate as DC
from findwell.llm import html_extract as HX
from findwell.llm import importance as IM
from findwell.llm import packing as PK
from findwell.llm import quality_rules as QR
from findwell.llm import queries as Q
from findwell.llm import simhash as SH
from findwell.llm import suffix_dedup as SD
from findwell.llm import token_orc as TO
from findwell.llm import toxicity as TX
from findwell.sources import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, body string"


def words(rng, n, size=2000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def awkward(spark, rows):
    """A table with nulls, an empty text, a repeated row, and columns whose names the operators use themselves."""
    full = [*rows, (None, "null key text", None, None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "  \n\t ", "en", "s", 5), rows[0]]
    return spark.createDataFrame([(*r, "k", "r", "b") for r in full], DOCUMENT), [(r[0], r[1] or "") for r in full]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    shared = words(rng, 120)
    rows = [(i, words(rng, rng.randrange(0, 160)), "en", f"s{i % 3}", 1) for i in range(24)]
    rows += [(100 + i, f"{words(rng, 20)} {shared} {words(rng, 20)}", "en", "hot", 1) for i in range(8)]  # a passage that many share
    rows += [(200 + i, shared, "en", "hot", 1) for i in range(5)]  # exact copies
    base = words(rng, 3000).split()
    for i in range(6):  # near copies
        rows.append((300 + i, " ".join([*base[: 500 * i], "x", *base[500 * i + 1 :]]), "de", "hot", 1))
    rows += [(400, "ab " * 900, "en", "s", 1), (401, "é" * 900, "fr", "s", 1), (402, words(rng, 40) + " " + "same line here again and more words follow\n" * 12, "en", "s", 1)]
    rows.append((403, words(rng, 30_000), "en", "s", 1))  # very long
    return awkward(spark, rows)


def longest_repeat(w):
    """Words in the longest run that starts twice or more, by growing runs that still repeat."""
    n, groups = 0, [list(range(len(w)))]
    while groups:
        nxt = []
        for g in groups:
            by = defaultdict(list)
            for i in g:
                if i + n < len(w):
                    by[w[i + n]].append(i)
            nxt += [x for x in by.values() if len(x) > 1]
        if not nxt:
            break
        n, groups = n + 1, nxt
    return n


def test_quality_rules(spark, corpus):
    df, rows = corpus
    rng = random.Random(17)
    more = []
    for k in range(12):  # what the base rule lets pass: one run of words, said twice
        run, rest = words(rng, 9 + k), words(rng, 120)
        more.append((600 + k, f"{run} {rest} {run}", "en", "s", 1, "k", "r", "b"))
    df, rows = df.unionByName(spark.createDataFrame(more, DOCUMENT)), rows + [(r[0], r[1]) for r in more]
    got = defaultdict(list)
    for r in QR.score(df).collect():
        got[r["key"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["longest_repeat_words"], r["kept"]))
    want = defaultdict(list)
    for key, text in rows:
        w = WORD.findall(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        longest = longest_repeat(w) if seen and max(seen.values()) > 1 else 0
        covered = sum(len(w[j]) for j in inside)
        good = not failed and 5 * covered <= sum(map(len, w)) and 100 * longest <= 12 * len(w) and longest <= 500
        want[key].append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed, longest, good))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(not x[5] and not x[7] for v in want.values() for x in v) and any(x[7] for v in want.values() for x in v)
    kept = [r["doc_id"] for r in QR.keep(df).collect()]
    assert sorted(kept, key=str) == sorted([r["key"] for r in QR.score(df).where("kept").collect()], key=str)
    assert QR.score(df.limit(0)).count() == 0 and QR.keep(df.limit(0)).columns == df.columns


def test_longest_repeat_and_spans():
    text = "a b c d e f g h i X a b c d e f g h i Y z z2".encode()
    found = QR.block(np.frombuffer(text, np.uint8), np.array([0, len(text)]), QR.Rules(min_words=1, max_repeat_percent=100))
    assert found["longest_repeat_words"].tolist() == [9] and found["repeat_spans"] == [[{"start": 0, "end": 17}, {"start": 20, "end": 37}]]
    assert not found["kept"][0]


def fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(nodes, near):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, corpus):
    df, rows = corpus
    got = SH.near_duplicates(df).collect()
    prints = [(k, fingerprint(t)) for k, t in rows]
    assert sorted((str(r["key"]), r["fp"] & (2**64 - 1)) for r in got) == sorted((str(k), f) for k, f in prints)
    by_id = {k: f for k, f in prints if k is not None}
    want = components(sorted(by_id), lambda a, b: (by_id[a] ^ by_id[b]).bit_count() <= 2)
    assert {r["key"]: r["component"] for r in got} == want | {None: None}
    assert SH.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [3, 6, 40])
def test_links_of_random_fingerprints(spark, spread):
    """Clusters around few centres, chains, and far points; small leaves, so that shards overlap."""
    rng = random.Random(spread)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = set()
    while len(prints) < 700:
        f = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    fps = sorted(prints)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {r["a"]: r["root"] for r in SH.link(spark.createDataFrame(rows, "id long, fp long"), 2, sample=200, leaf=32).collect()}
    want = components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {a: r for a, r in want.items() if a != r}


def test_components_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 40), (100, 90), (90, 80), (200, 199)]
    got = {r["a"]: r["root"] for r in SH.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {80: 0, 90: 0, 100: 0, 200: 199}


@pytest.mark.parametrize("bound", [0, SH.ONE_TASK])
def test_components_of_few_edges_take_one_task(spark, bound, monkeypatch):
    """Rounds of jobs are for many edges; both ways give the same."""
    rng, labels, put = random.Random(5), [], SH.materialize
    monkeypatch.setattr(SH, "ONE_TASK", bound)
    monkeypatch.setattr(SH, "materialize", lambda df, label, few=False: labels.append(label) or put(df, label, few))
    pairs = [sorted(rng.sample(range(-200, 200), 2)) for _ in range(180)]
    got = SH.components(spark.createDataFrame([(b, a) for a, b in pairs] * 2, "a long, b long"))
    near = {tuple(p) for p in pairs}
    want = components(range(-200, 200), lambda a, b: (min(a, b), max(a, b)) in near)
    assert sorted(map(tuple, got.collect())) == sorted((a, r) for a, r in want.items() if a != r)
    assert len(labels) > 2 if not bound else len(labels) == 2
    assert SH.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_of_short_rows_have_few_files(spark):
    """Where a session has many more partitions than cores; a task's share is bounded."""
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    parts = 2 * stored.FILES * spark.sparkContext.defaultParallelism
    rows = spark.range(2000).repartition(parts, "id")
    try:
        spark.conf.set(name, str(parts))
        table = SH.materialize(rows, "few", few=True)
        spark.conf.set(name, str(parts - 1))
        plain = SH.materialize(rows, "plain", few=True)
    finally:
        spark.conf.set(name, before)
    assert len(table.inputFiles()) <= parts // 2 < len(plain.inputFiles())
    assert sorted(r[0] for r in table.collect()) == list(range(2000))


def test_near_duplicates_of_the_pipeline(spark):
    """Groups by exact similarity of five-word shingles, 0.8 or more, whatever their fingerprints; similar but lesser pairs stay."""
    rng = random.Random(31)
    rows = []
    for g in range(12):
        base = words(rng, 200, 500).split()
        for _ in range(5):
            own = base[:]
            for at in rng.sample(range(200), rng.randrange(0, 9)):
                own[at] = f"X{rng.randrange(900)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), rows[3][1].upper().replace(" ", "\n")), (len(rows) + 1, "a b"), (len(rows) + 2, "A  b"), rows[5]]
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = components(sorted(sets), near)
    prints = {i: fingerprint(t) for i, t in rows}
    assert any(near(a, b) and (prints[a] ^ prints[b]).bit_count() > 2 for a in sets for b in range(a)) and 15 < len(set(want.values())) < 60
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == sorted(set(want.values()))
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), SF).count() == 0


def removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cut[i] += 1
                cut[i + length] -= 1
        out.append(np.cumsum(cut)[:-1] > 0)
    return out


def test_repeated_strings(spark, corpus):
    df, rows = corpus
    texts = [t.encode() for _, t in rows]
    want = []
    for (key, _), text, gone in zip(rows, texts, removed(texts, 400)):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((str(key), len(text), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(text, np.uint8)[~gone])).hexdigest()))
    got = [(str(r["key"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in SD.removal(df).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert SD.removal(df.limit(0)).count() == 0
    both = SD.removal(df, words=51).collect()
    assert sorted((str(r["key"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in both) == sorted(want)
    told = sorted((str(k), int(g.sum())) for (k, _), g in zip(rows, removed([tuple(WORD.findall(t)) for _, t in rows], 51)))
    assert sorted((str(r["key"]), r["passage_words"]) for r in both) == told and any(n for _, n in told)
    cut = SD.dedup_text(df)
    assert cut.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert 200 not in left and left[9002] == "" and left[1] == rows[1][1] and 0 not in left


@pytest.mark.parametrize("share", [1000, 1], ids=["frequent anchors", "no frequent anchors"])
@pytest.mark.parametrize("seed", range(4))
def test_repeated_strings_at_small_scale(spark, seed, share, monkeypatch):
    monkeypatch.setattr(SD, "HOT_SHARE", share)
    rng = random.Random(seed)
    pool = ["".join(rng.choices("ab", k=60)) for _ in range(4)] + ["\x00" * 50, "abab" * 20]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 6))) + "".join(rng.choices("abc", k=rng.randrange(30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i: int(g.sum()) for i, g in enumerate(removed([t.encode() for t in texts], 40))}
    assert {r["key"]: r["n_removed"] for r in SD.removal(df, length=40, seed=16).collect()} == want


def test_repeated_passages_by_words(spark):
    """The pipeline's stage cuts 51 short words that stand elsewhere, with other white space too, and leaves 50."""
    rng = random.Random(12)
    long, short = words(rng, 51, 90).split(), words(rng, 50, 90).split()
    assert len(" ".join(long)) < 200
    texts = {i: [f"a{i}", *words(rng, 30 + i).split()] for i in range(8)}
    for i in (0, 1, 2):
        texts[i][7:7] = long
    for i in (3, 4):
        texts[i][9:9] = short
    rows = [(i, (" \n" if i == 1 else " ").join(w), "en", "s", 1) for i, w in texts.items()] + [(8, " ".join(long) + "\n", "en", "s", 1), (9, "", "en", "s", 0), (10, None, "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    want = {i: [w for k, w in enumerate(own) if i > 2 or not 7 <= k < 58] for i, own in texts.items()}
    assert {i: (t or "").split() for i, t in got.items()} == want | {9: [], 10: []}
    small = [[rng.choice(["p", "qq", "é"]) for _ in range(rng.randrange(30))] for _ in range(25)]
    found = SD.repeated_words(SD._rows(spark.createDataFrame([(i, " \t".join(t)) for i, t in enumerate(small)], "key long, text string"), "key", "text"), 5)
    by = {r["row"]: r["passages"] for r in found.collect()}
    ids = {r["key"]: r["row"] for r in SD._rows(spark.createDataFrame([(i, " \t".join(t)) for i, t in enumerate(small)], "key long, text string"), "key", "text").collect()}
    for (i, t), gone in zip(enumerate(small), removed([tuple(t) for t in small], 5)):
        assert {j for p in by.get(ids[i]) or () for j in range(p["lo"], p["hi"])} == set(np.flatnonzero(gone).tolist()), (i, t)


def test_contexts_are_cut_from_the_batch_itself():
    """No other copy of a batch's bytes is made, and a worker's freed memory goes back when its task ends."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000)) + "x" * (24 << 20)

    class Hot:
        value = {SD.named((np.frombuffer(text[2000:2064].encode(), np.uint8) + np.uint8(1)).tobytes())}
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([[1000, 2000]], pa.list_(pa.int64()))], ["row", "body", "spots"])
    tracemalloc.start()
    got = [r for b in SD._contexts(400, 64, Hot)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    whole, parts = SD.sections(400, 64)[0], SD.sections(400, 64)[1:]
    assert [(r["section"], r["spots"]) for r in got] == [(0, [1000])] + [(k, [2000]) for k in range(1, 9)]
    for r in got:
        a, b = (whole, *parts)[r["section"]]
        (spot,) = r["spots"]
        assert r["context"].decode() == text[spot - b + 1 : spot - a + 400] and r["left"] == b - 1


def test_suffix_family_merges_levels():
    family = SD.Family(base=4)
    rng = np.random.default_rng(1)
    heads = np.array([b"%04d" % x for x in rng.integers(0, 60, 200)], "S4")
    found = set()
    for lo in range(0, 200, 7):
        part = heads[lo : lo + 7]
        found |= set(family.add(part, np.arange(lo, lo + len(part)), np.zeros(len(part), bool)).tolist())
    count = Counter(heads.tolist())
    assert found == {i for i, h in enumerate(heads.tolist()) if count[h] > 1}
    sizes = [len(x[0]) for x in family.levels if x is not None]
    assert sum(sizes) == len(count) and all(np.all(x[0][1:] > x[0][:-1]) for x in family.levels if x is not None)


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_within_the_edit_budget(spark):
    rng = random.Random(2)
    alphabet = "abcdefgh "
    items = [DC.normalise("".join(rng.choices(alphabet, k=n))) for n in (40, 90, 160, 300, 5)]
    index = DC.Index.build(list(enumerate(items)), DC.Q, DC.RATE)
    for trial in range(60):
        k = trial % 4
        text = list(items[k])
        for _ in range(rng.randrange(0, int(index.edits[k]) + 3)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.__setitem__(at, "Z"), lambda: text.pop(at), lambda: text.insert(at, "Y")])()
        whole = DC.normalise("".join(rng.choices(alphabet, k=80)) + "".join(text) + "".join(rng.choices(alphabet, k=80)))
        found = {x[1]: x[4] for x in DC.search([whole], index)}
        true = distance(items[k], whole)
        assert (k in found) == (true <= index.edits[k]) and found.get(k, true) == true
    rows = [(1, f"x {items[1]} y"), (2, "nothing"), (3, items[4].upper()), (None, items[0]), (5, None), (6, ""), (1, f"x {items[1]} y")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, item string")
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, " ")], "item_id long, text string")
    got = sorted((str(r["key"]), r["item"]) for r in DC.leaks(df, bench).collect())
    assert got == [("1", 1), ("1", 1), ("3", 4), ("None", 0)]
    assert got == sorted((str(r["key"]), r["item"]) for r in DC.leaks(df, bench, block_items=2).collect())
    assert sorted(r["doc_id"] for r in DC.clean(df, bench, block_items=2).collect()) == [2, 5, 6]  # rows have no order
    assert DC.leaks(df, bench.limit(0)).count() == 0 and DC.clean(df.limit(0), bench).count() == 0


def test_leaks_at_the_ends_of_a_text():
    """Altered items as the whole text, at its start and at its end."""
    rng = random.Random(6)
    items = [DC.normalise("".join(rng.choices("abcdefgh ", k=n))) for n in (36, 90, 160, 300)]
    index = DC.Index.build(list(enumerate(items)), DC.Q, DC.RATE)
    assert DC.search([items[0][:10] + items[0][11:]], index) == [(0, 0, 0, len(items[0]) - 1, 1)]
    for trial in range(120):
        k = trial % 4
        text, budget = list(items[k]), int(index.edits[k])
        for _ in range(rng.randrange(0, budget + 2)):
            at = rng.choice([0, -1, rng.randrange(len(text))])
            rng.choice([lambda: text.pop(at), lambda: text.pop(at), lambda: text.__setitem__(at, "Z"), lambda: text.insert(at, "Y")])()
        more = "".join(rng.choices("abcdefgh ", k=60))
        for whole in map(DC.normalise, (" \n" + "".join(text), "".join(text) + more, more + "".join(text))):
            found = {x[1]: x for x in DC.search([whole], index)}
            true = distance(items[k], whole)
            assert (k in found) == (true <= budget), (k, whole)
            if k in found:
                _, _, start, stop, edits = found[k]
                assert edits == true and 0 <= start < stop <= len(whole) and distance(whole[start:stop], items[k]) <= edits


def check_bins(rows, capacities):
    bins = defaultdict(list)
    for r in rows:
        assert (r["bin_id"] is None) == (r["length"] == 0)
        if r["length"]:
            bins[r["bin_id"]].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert at == own[0]["bin_used"] and own[0]["capacity"] == min(c for c in capacities if c >= at)
        assert len({(r["capacity"], r["bin_used"]) for r in own}) == 1
    return bins


def test_packing(spark, corpus):
    df, rows = corpus
    got = PK.assign(df, capacities=(64, 256, 1024)).collect()
    check_bins(got, (64, 256, 1024))
    total = Counter()
    for r in got:
        total[str(r["key"])] += r["length"]
    want = Counter()
    for k, t in rows:
        want[str(k)] += len(t.encode())
    assert total == want and PK.assign(df.limit(0)).count() == 0


def test_plans_are_as_good_as_plain_best_fit():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.choice([5, 30, 60, 61, 100, rng.randrange(1, 101)]) for _ in range(300)]
        plan = PK.pack(Counter(lengths), (100,), (100,), 0)
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [i for i, left in enumerate(bins) if left >= n]
            i = min(fit, key=lambda i: bins[i]) if fit else len(bins)
            bins[i:i] = [] if fit else [100]
            bins[i] -= n
        assert plan.cost <= len(bins) * PK.price(100, 0, PK.ATTENTION) * 1.02
        assert PK.best_plan(Counter(lengths), (25, 50, 100), 3).cost <= PK.pack(Counter(lengths), (100,), (25, 50, 100), 3).cost


def test_capacities_are_chosen_jointly():
    """No plan over fixed sets of sizes is cheaper than the chosen one; its bins hold every piece once, in the size that fits."""
    rng = random.Random(4)
    caps = (16, 32, 64, 128)
    chosen = set()
    for trial in range(25):
        lengths = Counter(rng.choice([rng.randrange(1, 129), rng.randrange(1, 20), 17, 64, 90]) for _ in range(rng.randrange(1, 400)))
        overhead, attention = rng.choice([0, 2, 40]), rng.choice([20.0, 200.0, 1e9])
        best = PK.best_plan(lengths, caps, overhead, attention)
        for k in range(4):
            for some in itertools.combinations(caps[:3], k):
                assert best.cost <= PK.pack(lengths, some, caps, overhead, attention).cost
        own = PK.pack(lengths, caps[:3], caps, overhead, attention, True)
        for plan in (best, own):
            used, total = Counter(), Counter()
            ends = [*plan.places[1:, :2].tolist(), [None, None]]
            for (length, rank, first, _), (nxt, to) in zip(plan.places.tolist(), ends):
                many = (to if nxt == length else lengths[length]) - rank
                total[length] += many
                for b in range(first, first + many):
                    used[b] += length
            first = [*plan.bins[:, 0].tolist(), max(used) + 1]
            cost = 0.0
            for (b, size, full), stop in zip(plan.bins.tolist(), first[1:]):
                assert size == min(c for c in caps if c >= full) and all(used[i] == full for i in range(b, stop))
                cost += (stop - b) * PK.price(size, overhead, attention)
            assert total == lengths and abs(cost - plan.cost) < 1e-6 * cost
        chosen.add(own.cost < min(PK.pack(lengths, s, caps, overhead, attention).cost for s in [(), (16,), (16, 32, 64)]))
    assert len(chosen) == 2  # the choice bin by bin wins at times


def test_packed_sequences(spark):
    """Token ids of every bin: each document's ids once, whole and in order."""
    rng = random.Random(3)
    rows = [(10 * i, [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 5, 30, 64, 150]))]) for i in range(60)]
    tokens = spark.createDataFrame(rows, "start long, ids array<int>")
    got = PK.sequences(tokens, capacities=(16, 64)).collect()
    places = PK.assign(tokens, "start", F.size("ids"), capacities=(16, 64)).collect()
    check_bins(places, (16, 64))
    bins = {r["bin_id"]: r for r in got}
    back = defaultdict(list)
    for p in sorted(places, key=lambda p: (p["key"], p["piece"])):
        if p["length"]:
            b = bins[p["bin_id"]]
            assert p["bin_offset"] + p["length"] in b["ends"] and b["capacity"] == p["capacity"]
            back[p["key"]] += b["ids"][p["bin_offset"] : p["bin_offset"] + p["length"]]
    assert dict(back) == {k: v for k, v in rows if v} and sum(len(b["ids"]) for b in got) == sum(len(v) for _, v in rows)


def test_token_files(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = corpus
    odd = [(7001, "it's I'LL <|endoftext|>a İstanbul ΟΔΟΣ ﬁne ½ 한국어 😀"), (7002, " a\tb c "), (7003, "Éa ÷ × ª")]
    both = df.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    path = public_tokenizers.path("word_bpe_49k.json")
    out = Q.new_path(spark, "test-orc")
    TO.write(both, out, path)
    t = Tokenizer.from_file(path)
    every = sorted([*[(k, x or "") for k, x in rows], *odd], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for k, text in every:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in TO.read_digest(spark, out).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert TO.lookup(spark, out, [7001]).count() == 1
    flat = [i for r in sorted(TO.tokens(spark, out).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    assert [zlib.crc32(np.array(flat[a : a + n], "<u4").tobytes()) for _, a, n, _ in want] == [x[3] for x in want]
    assert sorted((str(r["key"]), r["n_tokens"]) for r in TO.counts(both, path).collect()) == sorted((str(k), n) for k, _, n, _ in want)
    empty = Q.new_path(spark, "test-orc")
    TO.write(both.limit(0), empty, path)
    assert TO.read_digest(spark, empty).count() == 0
    assert TO.encode_batch(pa.array([x for _, x in odd]), path, 1, True).equals(TO.encode_batch(pa.array([x for _, x in odd]), path, 1, False))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b <|im_end|>\n<|im_start|>user\nx", "", "\\", "<\\|im_end|>", "é\n\n"]
    for a in texts:
        for b in texts:
            turns = [("user", a), ("assistant", b), ("odd\nrole<|im_end|>", a)]
            text, spans = CH.render(turns)
            assert CH.parse(text) == turns and [CH.unescape(text[i:j]) for i, j in spans] == [b]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "s"), (None, 3, "user", "n"), (2, 5, "user", "x"), (2, 5, "user", "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node int, tree int")
    got = {r["tree"]: (r["n_turns"], r["loss_chars"]) for r in CH.format_digest(df).collect()}
    assert got == {1: (3, 1), None: (1, 0), 2: (2, 0)}
    assert CH.format_digest(df.limit(0)).count() == 0


def test_reply_trees(spark):
    """A branching tree with a deep branch, a second root, and a cycle."""
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.1) for i in range(11)]
    rows += [(1, 20, 3, "user", "best", 9.0), (1, 21, 20, "assistant", "end", 0.0), (2, 1, 2, "user", "c", 0.0), (2, 2, 1, "user", "c", 0.0), (3, 5, 99, "user", "root", 0.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    tree = m.where("tree <> 2")
    every = defaultdict(dict)
    for r in CH.paths(tree).collect():
        every[r["tree"], r["leaf"]][r["up"]] = r["node"]
    assert every[1, 10] == {i: 10 - i for i in range(11)} and every[1, 21] == {0: 21, 1: 20, 2: 3, 3: 2, 4: 1, 5: 0} and every[3, 5] == {0: 5}
    (top,) = CH.format_trees(tree).where("tree = 1").collect()
    assert [t for _, t in CH.parse(top["formatted"])] == ["t0", "t1", "t2", "t3", "best", "end"]
    assert CH.format_trees(tree, None).count() == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="nav-open has-sidebar"><div id="cookie-notice">We use cookies, ok, yes, no</div>
<header><h1>Site</h1><nav>a b c</nav></header><div class="wrap"><div class="post-content"><h2>Head &amp; line</h2><p>First para, with some, commas and <a href=x>link</a> text.
<p>Second  para &nbsp; is here, longer than others, indeed.</p><div class="ad-slot">BUY</div><ul><li>one<li>two</ul><blockquote>Quote</blockquote><form>in <label>name</label></form></div>
<div class="related"><p>Other story, with, many, commas, in, it, so, that, it, would, win, by length, and more, and more</p></div></div>
<section id="comments"><article class="comment"><p>Nice, one, really, good, story, I, like, it</p></article></section><footer>&copy; me</footer><script>var t="</p>";</script></body></html>"""


def test_html_extraction(spark):
    assert HX.main_text(PAGE) == "Head & line\nFirst para, with some, commas and link text.\nSecond para is here, longer than others, indeed.\none\ntwo\nQuote"
    assert HX.main_text("<article><h1>H</h1><p><b>bold, open<br><p>next &#233;&lt;</article><aside>no</aside>") == "H\nbold, open\nnext é<"
    assert HX.main_text("<p>just a < b text</p>plain") == "just a < b text\nplain"
    assert [HX.main_text(x) for x in (None, "", "<nav>x</nav>", "<script>x</script>")] == ["", "", "", ""]
    assert HX.main_text("<body><main><article><header><h1>T</h1><p>by</p></header><p>Text.</p><section class=comments><p>c</p></section></article></main></body>") == "T\nText."
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<p>é", "x")], "page_id long, url string, html string, text string")
    assert [(r["key"], r["n_chars"]) for r in HX.extract(df).collect()] == [(1, len(HX.main_text(PAGE))), (2, 0), (None, 1)]


def test_toxicity_and_identity_terms(spark):
    rng = random.Random(8)
    names = ["muslim", "women", "gay", "juifs"]

    def doc(toxic, name):
        body = [f"w{rng.randrange(300)}" for _ in range(30)] + (["vilespawn"] if toxic else []) + ([rng.choice(names)] if name else [])
        rng.shuffle(body)
        return " ".join(body)

    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, doc(toxic, rng.random() < (0.8 if toxic else 0.02)), int(toxic)))  # labels that go with mentions
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, y) for i, _, y in rows], (None, 1), (3, None)], "doc_id long, toxic int")
    model = TX.fit(docs, labels)
    got = {r["key"]: r for r in TX.score(docs, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    plain = doc(False, False)
    for name in names:
        assert abs(model.logit(plain) - model.logit(f"{plain} {name}")) < 0.7
    unfair = TX.train(*TX.sample(docs, labels, "doc_id", "text", "toxic"), [])
    assert abs(unfair.logit(plain) - unfair.logit(f"{plain} muslim")) > abs(model.logit(plain) - model.logit(f"{plain} muslim"))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "vilespawn", "x")], "doc_id long, text string, score string")
    scores = [r["score"] for r in TX.score(odd, model).collect()]
    assert scores[0] == scores[1] < 0.3 < scores[2]
    assert TX.fit(docs, labels.limit(0)).bias < 0 and TX.score(docs.limit(0), model).count() == 0


def test_importance_resampling(spark):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=40))) for i in range(300)] + [(900, None), (901, ""), (None, "g1 g2"), (5, "g1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    picked = IM.resample(docs, labels, 0.6).collect()
    assert len(picked) == round(0.6 * len(rows))
    assert sum(r["key"] is not None and r["key"] < 300 and r["key"] % 3 == 0 for r in picked) == 0
    assert IM.resample(docs.limit(0), labels).count() == 0 and IM.resample(docs, labels.limit(0), 0.5).count() == round(0.5 * len(rows))
    text = "Ab cd  ab\ncd é"
    b, _ = IM.buckets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    lower, _ = IM.buckets(np.frombuffer(b" ab cd ab cd \xc3\xa9", np.uint8), np.array([0, 15]))
    assert len(b) == 5 + 4 and sorted(b.tolist()) == sorted(lower.tolist()) and len(set(b.tolist())) == 3 + 3


def test_top_k_is_exact(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([rng.gauss(0, 1), -1e4 * rng.random(), 0.5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, noisy double")
    for k in (0, 1, 700, 2999, 3000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        assert sorted(r["key"] for r in IM.top_k(df, k, cells=16, few=10).collect()) == sorted(r[0] for r in want)


def resembling(texts):
    """Pairs by exact similarity of five-word shingles, 0.8 or more."""
    sets = {}
    for k, t in texts:
        w = [bytes(x) for x in t.encode().lower().split()]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "x " * 50, None, None, None), (10_001, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 1"))
    items = [DC.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        after = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = {r["doc_id"]: r["text"] for r in after}
        if name == "quality rules":
            verdict = QR.score(spark.createDataFrame(before, "doc_id long, text string")).where("kept").collect()
            assert sorted(map(str, (r["doc_id"] for r in after))) == sorted(str(r["key"]) for r in verdict)
        elif name == "simhash near-dedup":
            groups = components(sorted({k for k, _ in before}), resembling(before))
            assert sorted(r["doc_id"] for r in after) == sorted(set(groups.values())) and len(after) < len(before)
        elif name == "suffix-array dedup":
            raw = [t.encode() for _, t in before]
            by_words = removed([tuple(t.split()) for t in raw], 51)
            want = {}
            for (k, _), t, g, passages in zip(before, raw, removed(raw, 400), by_words):
                at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
                gone = g.copy()
                for i, j in itertools.groupby(np.flatnonzero(passages).tolist(), key=lambda x, c=itertools.count(): x - next(c)):
                    own = list(j)
                    gone[at[own[0]][0] : at[own[-1]][1]] = True
                left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
                if left.strip() or not gone.any():
                    want[k] = left
            assert texts == want and all(r["n_chars"] == len(r["text"]) for r in after) and any(len(want.get(k, "")) < len(t) for k, t in before)
        else:
            assert set(texts) == {k for k, t in before if not any(x in DC.normalise(t) for x in items)}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_bins(rows, PK.CAPACITIES)
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    sizes = Counter()
    for r in rows:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in texts.items()}


def test_rows_without_an_id_of_their_own_stay(spark):
    """Null and shared ids pass all stages on their own text; copies still go."""
    rng = random.Random(77)
    rows = [(k, words(rng, 120, 90_000)) for k in (None, None, 5, 5, 5, 6)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in [*rows, rows[0], rows[2], (7, rows[1][1])]], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
    want = [rows[0], (7, rows[1][1]), *rows[2:]]
    assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == sorted((str(k), t) for k, t in want)
    sizes = sorted((str(r["doc_id"]), r["length"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    assert sizes == sorted((str(k), len(t.encode(x, add_special_tokens=False).ids) + 1) for k, x in want)


def test_queries_have_their_columns(spark):
    want = {
        "op3_simhash": ["doc_id", "fingerprint", "component_id"],
        "op4_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_html_extract": ["page_id", "url", "text", "n_chars"],
    }
    for name, columns in want.items():
        df = Q.queries()[name](spark, SF)
        assert df.columns == columns and df.count() > 0
    prints = Q.op3_simhash(spark, SF).select(F.length("fingerprint").alias("n")).distinct().collect()
    assert [r["n"] for r in prints] == [16]


def test_importance_by_brute_force(spark, corpus):
    """Hash, counts, log weights and noise computed anew, number by number."""
    df, rows = corpus
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def grams(text):
        w = [mix(sum(mix(b + 1) * mix(i + 7) for i, b in enumerate(x.encode().lower())) & mask) for x in WORD.findall(text)]
        return [x % IM.BUCKETS for x in w] + [mix((a * 0x9E3779B97F4A7C15 + b) & mask) % IM.BUCKETS for a, b in zip(w, w[1:])]

    good = {100, 101, 102, 5, 9}
    every = [(k, grams(t)) for k, t in rows]
    raw, target = Counter(b for _, g in every for b in g), Counter(b for k, g in every if k in good for b in g)
    share = lambda c, b: np.log((c[b] + 1) / (sum(c.values()) + IM.BUCKETS))
    want = sorted((str(k), round(float(sum(share(target, b) - share(raw, b) for b in g)), 5)) for k, g in every)
    labels = spark.createDataFrame([(k, 1) for k in good] + [(8, 0), (None, 1)], "doc_id long, quality int")
    scored = IM.weights(df, labels.where("quality = 1").select(F.col("doc_id").alias("id"))).collect()
    got = sorted((str(r["key"]), round(r["log_weight"], 5)) for r in scored)
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([w for _, w in got], [w for _, w in want], atol=1e-4)
    drawn = {r["key"]: r["h"] for r in df.select(F.col("doc_id").alias("key"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 52)).alias("h")).collect()}
    for r in scored:
        assert abs(r["noisy"] - (r["log_weight"] - np.log(-np.log((drawn[r["key"]] + 0.5) / 2**52)))) < 1e-9
    picked = [(r["key"], r["noisy"]) for r in IM.resample(df, labels, 0.5).collect()]
    order = sorted(((r["key"], r["noisy"]) for r in scored), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[: len(picked)]
    assert len(picked) == round(0.5 * len(rows)) and sorted(map(str, picked)) == sorted(map(str, order))


def test_very_long_and_repeated_rows(spark):
    """Sizes far over the usual, and the same row many times, in the operators that read each row by itself."""
    rng = random.Random(19)
    long = words(rng, 120_000)
    page = "<html><body><nav>menu</nav><article><h1>Title</h1>" + "".join(f"<p>{words(rng, 40)}, and more, of it.</p>" for _ in range(3000)) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", page, "x")] * 3 + [(2, "v", "<p>short, plain text.</p>", "x")] * 4, "page_id long, url string, html string, text string")
    got = Counter((r["key"], r["n_chars"], r["text"].count("\n")) for r in HX.extract(pages).collect())
    assert got == Counter({(1, len(HX.main_text(page)), 3000): 3, (2, len("short, plain text."), 0): 4})
    docs = spark.createDataFrame([(i, f"vilespawn {words(rng, 8)}" if i % 3 == 0 else words(rng, 9)) for i in range(300)] + [(1000, long + " vilespawn")] * 2 + [(1001, long)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    scores = defaultdict(list)
    for r in TX.score(docs, TX.fit(docs, labels)).where("key >= 1000").collect():
        scores[r["key"]].append(r["score"])
    assert all(len(v) == 2 and v[0] == v[1] for v in scores.values()) and scores[1000][0] > scores[1001][0]
    talk = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} </s>") for i in range(4000)] + [(2, 0, "assistant", long)]
    digest = {r["tree"]: (r["n_turns"], r["loss_chars"]) for r in CH.format_digest(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert digest == {1: (4000, sum(len(t[3]) for t in talk[:4000:1] if t[2] == "assistant")), 2: (1, len(long))}
    lengths = spark.createDataFrame([(None, 40)] * 5 + [(7, 40)] * 3 + [(8, None), (8, 0), (9, 1000)], "key long, n long")
    placed = PK.assign(lengths, "key", F.col("n"), capacities=(64, 256)).collect()
    check_bins(placed, (64, 256))
    assert Counter((r["key"], r["length"]) for r in placed) == Counter({(None, 40): 5, (7, 40): 3, (8, 0): 2, (9, 256): 3, (9, 1000 - 768): 1})


def test_swaps_of_every_sentence():
    """Each sampled sentence is swapped, whatever its place, and a swap never moves a feature that stays."""
    rng = random.Random(6)
    texts = [f"w{i} {rng.choice(['old', 'muslim', 'women', ''])} x" for i in range(3000)]
    rows = TX.Rows.of(texts)
    swaps = TX.counterfactuals(rows)
    named_rows = sum(any(w in TX.IDENTITY for w in t.split()) for t in texts)
    assert len(swaps) == len(texts) and named_rows > 1500
    for (fresh, gone), i in zip(swaps, range(len(rows))):
        assert not set(fresh) & set(gone) and not set(fresh) & (set(rows.row(i).tolist()) - set(gone))
