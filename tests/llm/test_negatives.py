"""Hard negatives against all scores: clusters, copies, ties, odd rows, several blocks, packs and teams."""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import negatives, queries

SF = "/root/testdata/sf0.01"


def by_all_scores(rows, every, positives=5, k=3):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1] == a[1]) for b in rows if b is not a), key=lambda x: x[:2])
        for s, pid, _ in [x for x in scored if x[2]][:positives]:
            fit = [(i, n) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:k]
            out += [(a[0], pid, r + 1, i, -s, -n) for r, (i, n) in enumerate(fit)]
    return sorted(out)


def vectors(rng, n, dim, labels, spread):
    centres = [[rng.randrange(-200, 200) for _ in range(dim)] for _ in range(8)]
    return [(i, rng.randrange(labels), [c + rng.randrange(-spread, spread + 1) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("dim", "labels", "spread"), [(4, 3, 60), (2, 40, 2), (16, 2, 200)], ids=["clusters", "copies and many labels", "spread out"])
def test_equal_to_all_scores(spark, monkeypatch, dim, labels, spread):
    for name, value in (("BLOCK", 60), ("PACK", 4), ("TEAM", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(random.Random(dim), 400, dim, labels, spread)
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 7 == 0).collect())
    assert got == by_all_scores(rows, 7) and got


def test_a_third_of_all_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 100)
    rng = random.Random(3)
    rows = [(i, i % 2, [9, 9]) if i % 3 == 0 else (i, rng.randrange(3), [rng.randrange(1, 12), rng.randrange(1, 12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 5 == 0).collect()) == by_all_scores(rows, 5)


def test_large_numbers_are_exact(spark):
    rows = [(i, i % 2, [10**9 + i * 10**7, -(10**8) * (i % 5), 7 + i * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>")
    want = by_all_scores(rows, 4)
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 4 == 0).collect()) == want and want[0][4] > 1 << 53


def test_covering_radii_hold():
    rng = np.random.default_rng(4)
    centres = rng.integers(-100, 100, (12, 6))
    points = (centres[rng.integers(0, 12, 900)] + rng.integers(-8, 9, (900, 6))).astype(float)
    tree = negatives.CoverTree(points, np.zeros(900, np.int64), [[i] for i in range(900)])

    def below(node):
        return np.concatenate([tree.leaf[node], *[below(c) for c in tree.children[node].tolist()]]).astype(int)

    assert sorted(below(0)) == list(range(900)) and len(tree.centre) > 12
    for node in range(len(tree.centre)):
        away = np.sqrt(((tree.lifted[below(node)] - tree.lifted[tree.centre[node]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-9
        assert all(tree.radius[c] <= tree.radius[node] / 2 for c in tree.children[node].tolist())


def test_descent_skips_nodes_outside_the_windows(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (20, 8))
    points = (centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(float)
    tree = negatives.CoverTree(points, np.zeros(4000, np.int64), [[i] for i in range(4000)])
    looked, verify = [], tree._verify
    monkeypatch.setattr(tree, "_verify", lambda part, *a: (looked.append(len(part)), verify(part, *a)))
    top = points @ points[0]
    got = tree.first_in(points[0], [(int(top.max() * 0.5), int(top.max() * 0.95))], 3)[0]
    fit = sorted(((-s, i) for i, s in enumerate(top.tolist()) if int(top.max() * 0.5) <= s <= int(top.max() * 0.95)))[:3]
    assert [(-s, i) for s, i in got] == fit and sum(looked) < 2000


def test_evenly_spread_points_cost_few_passes_and_a_pack_one_product(monkeypatch):
    rng = np.random.default_rng(6)
    points, labels = rng.integers(-100, 101, (1500, 48)).astype(float), rng.integers(0, 3, 1500)
    passes, far = [], negatives.CoverTree._far
    monkeypatch.setattr(negatives.CoverTree, "_far", lambda self, *a: (passes.append(1), far(self, *a))[1])
    tree = negatives.CoverTree(points, labels, [[i] for i in range(1500)])
    assert len(passes) <= 1500 // negatives.LEAF + 2
    products, verify = [], tree._verify
    monkeypatch.setattr(tree, "_verify", lambda *a: (products.append(1), verify(*a)))
    windows = [[(0, 40_000), (-5_000, 20_000)][: 1 + i % 2] for i in range(60)]
    got = tree.first_of(points[:60], windows, 3, labels[:60].tolist())
    for i, some in enumerate(windows):
        score = points @ points[i]
        fit = [sorted((-s, j) for j, s in enumerate(score.tolist()) if low <= s <= high and labels[j] != labels[i])[:3] for low, high in some]
        assert [[(-s, j) for s, j in found] for found in got[i]] == fit
    assert len(products) <= len(tree.centre)


def test_odd_rows(spark):
    rows = [
        (50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.6, 0.6], 2), (3, None, 1), (4, [1.0, None], 1), (5, [math.nan, 1.0], 1),
        (6, [math.inf, 1.0], 1), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (9, [0.7], 3), (10, [], 2), (100, [-1.0, -1.0], 5),
    ]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id bigint, embedding array<float>, label int, id int, v int")
    found = negatives.quantised(df, 256)
    assert sorted(r.id for r in found.collect()) == [1, 2, 9, 10, 50, 100]
    got = negatives.hard_negatives(found, F.col("id") % 50 == 0)
    p = 256 * 256 + 128 * 102
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(50, 1, 1, 2, p, 153 * 256 + 153 * 128), (50, 1, 2, 9, p, 179 * 256)]
    assert negatives.hard_negatives(found.limit(0), F.col("id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(found, F.col("id") < 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES["op13_negatives"](spark, SF)
    want = con.sql(queries.SQL["op13_negatives"])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.select(", ".join(df.columns)).fetchall())
