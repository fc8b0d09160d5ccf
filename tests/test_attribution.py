"""Journeys and models on hand-made touches: none, one, two, three and five touches, and a hot customer."""

import datetime as dt
import json
import os
import random

import pytest

from shelfline.operators import attribution as op
from shelfline.sources.tables import Tables

T0 = dt.datetime(2024, 1, 10)


def h(n):
    return T0 + dt.timedelta(hours=n)


CONV = "order_id bigint, customer_id bigint, customer_email string, order_ts timestamp_ntz, date date, product_id bigint, revenue double"
TOUCH = "touch_id bigint, customer_id bigint, touch_ts timestamp_ntz, channel string, campaign_id string"


@pytest.fixture(scope="module")
def data(spark):
    conv = [
        (1, 1, "a", h(10), h(10).date(), 5, 100.0),  # two touches
        (2, 1, "a", h(30), h(30).date(), 5, 60.0),  # one touch after order 1
        (3, 2, "b", h(300), h(300).date(), 6, 50.0),  # only a touch older than the window
        (4, 3, "c", h(100), h(100).date(), 7, 200.0),  # five touches
    ]
    touch = [
        (101, 1, h(1), "facebook", "c1"), (102, 1, h(5), "email", "c2"), (103, 1, h(20), "organic", "c3"), (104, 1, h(40), "email", "c9"),
        (105, 2, h(1), "facebook", "c1"),
        (106, 3, h(10), "facebook", "c1"), (107, 3, h(20), "facebook", "c2"), (108, 3, h(30), "email", "c1"), (109, 3, h(40), "organic", "c1"), (110, 3, h(50), "email", "c3"),
    ]
    return spark.createDataFrame(conv, CONV), spark.createDataFrame(touch, TOUCH)


def test_a_touch_counts_for_every_order_in_whose_window_it_lies(data):
    jt = op.journey_touches(*data)
    got = sorted((r["touch_id"], r["order_id"]) for r in jt.collect())
    assert got == [(101, 1), (101, 2), (102, 1), (102, 2), (103, 2), (106, 4), (107, 4), (108, 4), (109, 4), (110, 4)]


def test_attribution_rows(data):
    rows = {r["order_id"]: r for r in op.attribution(*data).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1]["first_touch_channel"], rows[1]["last_touch_channel"], rows[1]["journey_duration_hours"]) == ("facebook", "email", 4)
    assert rows[1]["ads_attributed_revenue"] == 50.0 and rows[1]["email_attributed_revenue"] == 50.0
    assert rows[3]["touchpoint_count"] == 0 and rows[3]["first_touch_channel"] is None and rows[3]["ads_attributed_revenue"] == 0.0
    assert rows[4]["ads_campaign_id"] == "c2" and rows[4]["email_campaign_id"] == "c3"
    assert rows[4]["ads_attributed_revenue"] == 80.0


def test_decay_weights(data, spark):
    w = {}
    jt = op.numbered(op.journey_touches(*data))
    from pyspark.sql import functions as F

    for r in jt.withColumn("w", op.decay_weight(F.col("position"), F.col("n"))).collect():
        w.setdefault(r["order_id"], []).append((r["position"], r["w"]))
    assert [x for _, x in sorted(w[1])] == [0.3, 0.7]
    assert [x for _, x in sorted(w[2])] == [0.2, 0.3, 0.5]
    five = [x for _, x in sorted(w[4])]
    total = sum(2.0**-k for k in range(5))
    assert five == pytest.approx([2.0 ** (p - 5) / total for p in range(1, 6)])
    assert sum(five) == pytest.approx(1.0)


def test_position_weights_sum_to_one(data):
    got = {}
    for r in op.position_based(op.journey_touches(*data)).collect():
        got.setdefault(r["order_id"], {})[r["channel"]] = r["weight"]
    assert got[2] == pytest.approx({"facebook": 0.4, "email": 0.2, "organic": 0.4})
    assert got[1] == {"facebook": 0.5, "email": 0.5}
    assert got[4]["facebook"] == pytest.approx(0.4 + 0.2 / 3) and sum(got[4].values()) == pytest.approx(1.0)


def test_windows_use_the_last_touch(data):
    rows = {r["order_id"]: r for r in op.window_credit(*data).collect()}
    assert rows[1]["ads_1d_revenue"] == 100.0 and rows[1]["email_1d_revenue"] == 100.0
    assert rows[3]["ads_7d_revenue"] == 0.0 and rows[3]["ads_28d_revenue"] == 50.0
    assert rows[4]["ads_1d_revenue"] == 0.0 and rows[4]["ads_7d_revenue"] == 200.0


def test_sequences_round_trip_in_chunks(data):
    jt = op.journey_touches(*data)
    seq = op.sequences(jt, chunk=2)
    assert {r["order_id"]: r["n"] for r in seq.groupBy("order_id").count().withColumnRenamed("count", "n").collect()} == {1: 1, 2: 2, 4: 3}
    assert json.loads(seq.filter("order_id = 1").collect()[0]["touchpoint_sequence"])[0] == {"channel": "facebook", "campaign_id": "c1", "timestamp": "2024-01-10T01:00:00"}
    back = [(r["position"], r["channel"]) for r in op.expand_sequences(seq, chunk=2).filter("order_id = 4").orderBy("position").collect()]
    assert back == [(1, "facebook"), (2, "facebook"), (3, "email"), (4, "organic"), (5, "email")]


def test_hot_customer_matches_brute_force(spark):
    rnd = random.Random(4)
    conv, touch = [], []
    for i in range(60):
        c = 1 if rnd.random() < 0.5 else rnd.randint(2, 6)
        t = T0 + dt.timedelta(minutes=rnd.randint(0, 30000))
        conv.append((i, c, f"m{c}", t, t.date(), 1, 1.0))
    for i in range(1000, 1800):
        c = 1 if rnd.random() < 0.5 else rnd.randint(2, 6)
        touch.append((i, c, T0 + dt.timedelta(minutes=rnd.randint(0, 30000)), rnd.choice(["facebook", "email"]), "x"))
    got = sorted((r["touch_id"], r["order_id"]) for r in op.journey_touches(spark.createDataFrame(conv, CONV), spark.createDataFrame(touch, TOUCH)).collect())
    want = [(t[0], c[0]) for t in touch for c in conv if c[1] == t[1] and dt.timedelta(0) <= c[3] - t[2] <= dt.timedelta(days=7)]
    assert got == sorted(want)


def test_url_matching_by_substring_and_tag(spark):
    orders = spark.createDataFrame(
        [(1, "/landing/Summer Sale/x"), (2, "/shop?utm_campaign=summersale&x=1"), (3, "/"), (4, "/shop?utm_campaign=winter"), (5, "/winter/summer sale")], "order_id bigint, landing_site string"
    )
    camps = spark.createDataFrame([("c1", "Summer Sale"), ("c2", "Winter")], "campaign_id string, campaign_name string")
    got = sorted((r["order_id"], r["campaign_id"]) for r in op.campaign_url_matches(orders, camps).collect())
    assert got == [(1, "c1"), (2, "c1"), (4, "c2"), (5, "c1"), (5, "c2")]


def test_either_key_join_keeps_unmatched_and_avoids_repeats(spark):
    d = T0.date()
    a = spark.createDataFrame([(1, d, "m1", "f1"), (2, d, "m9", "f9"), (3, d, "m2", "f2")], "order_id bigint, date date, mail_campaign_id string, mail_flow_id string")
    m = spark.createDataFrame(
        [(d, "m1", None, 1.0, 1.0), (d, None, "f1", 2.0, 2.0), (d, "m2", "f2", 3.0, 3.0)], "date date, campaign_id string, flow_id string, open_rate double, click_rate double"
    )
    got = sorted((r["order_id"], r["open_rate"] or 0.0) for r in op.either_key_join(a, m).collect())
    assert got == [(1, 1.0), (1, 2.0), (2, 0.0), (3, 3.0)]


def test_patterns_separate_orders_of_touches(spark):
    conv, touch, k = [], [], 0
    for i in range(12):
        t = h(200 + i)
        conv.append((i, i, f"m{i}", t, t.date(), 1, 10.0))
        order = ["facebook", "email"] if i < 6 else ["email", "facebook"]
        for j, c in enumerate(order):
            touch.append((1000 + k, i, h(190 + i + j), c, "x"))
            k += 1
    jt = op.journey_touches(spark.createDataFrame(conv, CONV), spark.createDataFrame(touch, TOUCH))
    got = {r["journey_pattern"]: (r["journey_frequency"], r["total_revenue"]) for r in op.journey_patterns(jt, "2024-02-01").collect()}
    assert got == {"facebook -> email": (6, 60.0), "email -> facebook": (6, 60.0)}


def test_pairs_of_the_fixture_tables(spark):
    """Figures of FIXTURES.md for a plain window join."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    t = Tables(spark, path)
    jt = op.journey_touches(t.conversions, t.touches)
    assert (jt.count(), jt.select("order_id").distinct().count()) == (16_043, 1_930)
