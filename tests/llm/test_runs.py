"""Periodic runs against a scan of all lags, and odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F
from shelfline.llm import queries, runs


def by_all_lags(words, least=24):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    spans = sorted((s, q, e - s) for (s, e), q in found.items())
    gone = {k for s, q, size in spans for k in range(s + q, s + size)}
    return [(s, size, q) for s, q, size in spans], b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng, n):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50, 1000])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        at, p = rng.randrange(n), min(n, rng.choice([1, 2, 3, 7, 15, 16, 17, 31, 32, 33, 48, 63, 64, 100, 130]))
        stretch = words[at : at + p]
        if rng.random() < 0.4 and p > 6:  # a period that is nearly periodic itself
            stretch = (stretch[: rng.randrange(1, 4)] * p)[: p - 1] + [b"other"]
        for i in range(rng.randrange(1, 6 * p + 30)):
            if at + i < n:
                words[at + i] = stretch[i % len(stretch)]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = b"change"
    return words


def test_runs_equal_a_scan_of_all_lags():
    rng = random.Random(11)
    texts = [planted(rng, rng.choice([0, 1, 23, 24, 30, 100, 300, 500])) for _ in range(300)]
    found = 0
    for i in range(0, 300, 60):
        got, short = runs.located(texts[i : i + 60])
        for words, r, c in zip(texts[i : i + 60], got, short, strict=True):
            assert ([(x["start"], x["length"], x["period"]) for x in r], c) == by_all_lags(words)
            found += len(r)
    assert found > 50


@pytest.mark.parametrize(
    "words",
    [[b"a"] * 300_000, [b"%d" % (i % 1000) for i in range(300_000)], ([b"a"] * 50 + [b"b"]) * 6000, [b"%d" % (bin(i).count("1") % 2) for i in range(1 << 18)]],
    ids=["one word", "long period", "runs in a run", "cube-free"],
)
def test_long_texts_take_linear_time(words):
    began = time.time()
    found, _ = runs.located([words])
    assert time.time() - began < 10
    assert all(r["length"] >= 3 * r["period"] for r in found[0])


def test_odd_rows_and_the_strongest_run(spark):
    text = "x y " * 20 + "end"
    rows = [(1, text, 5), (1, text, 5), (None, None, 6), (2, "", 7), (3, "a", 8), (4, " ".join("a" * 24 + "b" * 24), 9), (5, " ".join("ab" * 12 + "c" + "d" * 30), 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "runs", "collapsed"] and got.count() == 7
    by_id = {r.doc_id: r for r in got.withColumn("best", runs.strongest(F.col("runs"))).collect()}
    assert by_id[1].collapsed == "x y end" and tuple(by_id[1].best) == (0, 40, 2)
    assert by_id[None].collapsed == "" and by_id[2].runs == [] and by_id[2].best is None
    assert tuple(by_id[4].best) == (0, 24, 1) and by_id[4].collapsed == "a b"  # a tie: the first
    assert tuple(by_id[5].best) == (25, 30, 1)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_repeated_stretches_of_the_query(spark):
    from zlib import crc32

    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 57)), "en", "s", 0) for i in range(200)] + [(None, "a b", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    changed = 0
    for r in queries.repeating(docs).collect():
        words = [] if r.doc_id is None else [f"w{r.doc_id}_{k}" for k in range(r.doc_id % 57)]
        h = crc32(str(r.doc_id).encode())
        if words and h % 10 == 0:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert r.text == (" ".join(words) if r.doc_id is not None else "a b")
    assert changed > 5
