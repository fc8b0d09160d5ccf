import os
import random

import pytest
from shelfline.llm import minhash

SF = "/root/testdata/sf0.01"


def sets_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Class of every row by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = doc if not sets[i] else min(ids, default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)


def test_edge_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "two one"), (None, "one two"), (None, "quite alone here")]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = "new" + str(rng.random())
        rows.append((100 + i, " ".join(copy)))
    rows += [(300, rows[-1][1]), (300, rows[-1][1]), (301, " ".join(rng.choices(words, k=20000)))]
    assert run(spark, rows) == brute(rows)


def test_chain_of_links(spark):
    """Neighbours are linked, the ends are not: all are one component."""
    words = [f"c{i}" for i in range(400)]
    rows = [(500 - i, " ".join(words[i * 10 : i * 10 + 120])) for i in range(25)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id bigint, text string, n_shingles int, kept string")
    assert [tuple(r) for r in minhash.near_duplicates(docs).collect()] == [(1, 1, 1, True)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_deduplicated_keeps_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "y"), (3, None, "z"), (None, None, "n")], "doc_id bigint, text string, source string")
    kept = sorted((tuple(r) for r in minhash.deduplicated(docs).collect()), key=str)
    assert kept == [(1, "a b c", "x"), (3, None, "z"), (None, None, "n")]


def test_deduplicated_keeps_one_row_without_own_ids(spark):
    """Near copies among rows that have no doc_id, or one in common, leave one row."""
    rng = random.Random(9)

    def copies(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        return [" ".join([*base, f"end{i}"]) for i in range(n)]

    none, named, same, two = copies(4), copies(3), copies(3), copies(2)
    rows = [(None, t) for t in none] + [(None, none[0]), (1, named[0]), (None, named[1]), (None, named[2])]
    rows += [(7, t) for t in same] + [(8, two[0]), (8, two[0]), (8, "quite another text"), (9, two[1]), (None, "alone here"), (None, "")]
    kept = [tuple(r) for r in minhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    groups = [none, named, same, two, ["quite another text"], ["alone here"], [""]]
    assert len(kept) == len(groups) and all(sum(t in g for _, t in kept) == 1 for g in groups)
    assert (1, named[0]) in kept and (8, two[0]) in kept


def test_estimate_is_unbiased(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    a = rng.sample(words, 800)
    b = a[:600] + rng.sample(words, 200)
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id bigint, text string")
    s = minhash.sketches(docs)
    one, two = s.filter("doc_id = 1").selectExpr("sig sig_a"), s.filter("doc_id = 2").selectExpr("sig sig_b")
    got = one.crossJoin(two).select(minhash.estimated("sig_a", "sig_b")).first()[0]
    both = len(sets_of(" ".join(a)) & sets_of(" ".join(b)))
    want = both / (len(sets_of(" ".join(a))) + len(sets_of(" ".join(b))) - both)
    assert abs(got - want) < 0.15


@pytest.mark.parametrize("in_one_task", [200_000, 0])
def test_components_in_steps(spark, monkeypatch, in_one_task):
    """Labels taken on by further edges are those of all edges at once, in one task and dealt out."""
    monkeypatch.setattr(minhash._few, "__defaults__", (in_one_task,))
    rng = random.Random(4)
    steps = [[(rng.randrange(120), rng.randrange(120)) for _ in range(n)] for n in (25, 0, 20)] + [[(i, i + 1) for i in range(200, 230)]]
    root, labels = {}, None

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for edges in steps:
        labels = minhash.components(spark.createDataFrame(edges, "a bigint, b bigint"), labels)
        for a, b in edges:
            if a != b:
                low, high = sorted((find(a), find(b)))
                root[high] = low
        assert {tuple(r) for r in labels.collect()} == {(x, find(x)) for x in list(root)}


def test_few_links_take_two_queries_however_long_their_chains(spark, monkeypatch):
    written, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df, label: (written.append(label), cut(df, label))[1])
    order = random.Random(8).sample(range(3000), 3000)
    chain = [(order[i], order[i + 1]) for i in range(2999) if i % 1000 != 999]
    first = minhash.components(spark.createDataFrame(chain, "a bigint, b bigint"))
    more = minhash.components(spark.createDataFrame([(order[0], order[2999]), (7000, 7001), (5, 5)], "a bigint, b bigint"), first)
    parts = [order[:1000], order[1000:2000], order[2000:]]
    assert {tuple(r) for r in first.collect()} == {(x, min(p)) for p in parts for x in p}
    parts = [parts[0] + parts[2], parts[1], [7000, 7001]]
    assert sorted(tuple(r) for r in more.collect()) == sorted((x, min(p)) for p in parts for x in p)
    assert len(written) == 4
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
