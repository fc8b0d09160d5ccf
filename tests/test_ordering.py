"""Sliced ranking, numbering and as-of lookups against brute force, with hot keys, ties and nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfline.functions import ordering, stats

T0 = dt.datetime(2024, 1, 1)


def rows_of(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.select(*cols).collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("descending", [True, False])
def test_sliced_row_number_matches_plain_numbering(spark, seed, descending):
    rnd = random.Random(seed)
    data = []
    for i in range(600):
        day = "d1" if rnd.random() < 0.5 else rnd.choice(["d2", "d3"])
        # a third of the rows share one value, some are null
        v = 7.0 if rnd.random() < 0.34 else (None if rnd.random() < 0.05 else float(rnd.randint(0, 40)))
        data.append((day, "m1" if i % 3 else "m2", i, v))
    df = spark.createDataFrame(data, "day string, measure string, id bigint, v double")
    got = rows_of(ordering.sliced_row_number(df, ["day"], "v", "id", "rn", "measure", descending, n=8), "day", "measure", "id", "rn")
    want = {}
    for day in ("d1", "d2", "d3"):
        for m in ("m1", "m2"):
            part = [r for r in data if r[0] == day and r[1] == m]
            part.sort(key=lambda r: (r[3] is None, (-r[3] if descending else r[3]) if r[3] is not None else 0, r[2]))
            for k, r in enumerate(part, 1):
                want[(day, m, r[2])] = k
    assert got == want


@pytest.mark.parametrize("descending", [True, False])
def test_percent_rank_with_shared_values_and_nulls(spark, descending):
    rnd = random.Random(5)
    data = [(i, None if i % 17 == 0 else (3.0 if rnd.random() < 0.4 else float(rnd.randint(0, 25)))) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, v double")
    got = rows_of(ordering.percent_rank_of(df, "v", "p", descending, n=6), "id", "p")
    vals = [v for _, v in data if v is not None]
    for i, v in data:
        if v is None:
            assert got[(i,)] is None
        else:
            better = sum((x > v) if descending else (x < v) for x in vals)
            assert got[(i,)] == pytest.approx(better / (len(vals) - 1))


def test_percent_rank_of_one_row_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0)], "id bigint, v double")
    assert ordering.percent_rank_of(df, "v", "p").collect()[0]["p"] == 0.0


def _events(seed, n=500):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 8)
        ts = T0 + dt.timedelta(minutes=rnd.randint(0, 6000))
        out.append((key, ts, i, f"v{i}" if rnd.random() < 0.3 else None))
    return out


def test_split_row_number_and_total(spark):
    data = _events(3)
    df = spark.createDataFrame(data, "k bigint, ts timestamp_ntz, id bigint, v string")
    got = ordering.split_row_number(df, ["k"], "ts", "id", "rn", total="n").collect()
    want = {}
    for k in {r[0] for r in data}:
        part = sorted([r for r in data if r[0] == k], key=lambda r: (r[1], r[2]))
        for i, r in enumerate(part, 1):
            want[r[2]] = (i, len(part))
    assert {r["id"]: (r["rn"], r["n"]) for r in got} == want


@pytest.mark.parametrize("forward", [True, False])
def test_carry_finds_last_or_next_value(spark, forward):
    data = _events(9)
    df = spark.createDataFrame(data, "k bigint, ts timestamp_ntz, id bigint, v string")
    got = {r["id"]: r["v"] for r in ordering.carry(df, "k", "ts", "id", ["v"], forward).collect()}
    for k, ts, i, _ in data:
        side = [r for r in data if r[0] == k and r[3] is not None and ((r[1], r[2]) <= (ts, i) if forward else (r[1], r[2]) >= (ts, i))]
        side.sort(key=lambda r: (r[1], r[2]), reverse=forward)
        assert got[i] == (side[0][3] if side else None)


def test_trend_and_acceleration_need_enough_points(spark):
    data = [("a", i, float(v)) for i, v in enumerate([1, 4, 9, 16, 25])] + [("b", 0, 1.0), ("b", 1, 5.0)] + [("c", i, 2.0 * i) for i in range(3)]
    df = stats.with_position(spark.createDataFrame(data, "k string, d int, y double"), ["k"], ["d"])
    got = {r["k"]: (r["t"], r["a"]) for r in df.groupBy("k").agg(stats.trend("y").alias("t"), stats.acceleration("y").alias("a")).collect()}
    assert got["a"][0] == pytest.approx(6.0) and got["a"][1] == pytest.approx(2.0)
    assert got["b"] == (0.0, 0.0)
    assert got["c"][0] == pytest.approx(2.0) and got["c"][1] == 0.0


def test_zscores_of_a_constant_column_are_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, x double")
    assert [r["z"] for r in stats.zscores(df, {"x": "z"}).collect()] == [None, None]


def test_slices_keep_the_value_order(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 9]], "v double")
    d = df.withColumn("b", ordering.quantile_bounds(df, "v", 3)).withColumn("s", ordering.slice_of("v", "b"))
    r = sorted((x["v"], x["s"]) for x in d.collect())
    assert [s for _, s in r] == sorted(s for _, s in r)
    assert d.filter(F.col("v") == 1).select("s").distinct().count() == 1
