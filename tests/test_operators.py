"""Hand-computed cases for snapshot classes, reorder, KPIs and gap filling."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfline.functions import scalar as fn
from shelfline.operators import features, inventory, kpi, marketing, quality, reorder, sales, snapshot, validate
from shelfline.sources.tables import Tables


SF = "/root/testdata/sf0.001"
SNAP = "date date, product_id bigint, product_name string, product_category string, units_sold bigint, revenue double, avg_selling_price double, total_marketing_spend double, total_attributed_revenue double, organic_revenue double, ads_spend double, ads_attributed_revenue double, emails_sent bigint, email_attributed_revenue double"


def test_snapshot_bins_and_mix(spark):
    d = dt.date(2024, 1, 1)
    rows = [
        (d, 1, "a", None, 0, 0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0),
        (d, 2, "b", "x", 3, 200.0, 66.0, 10.0, 150.0, 50.0, 10.0, 40.0, 10, 20.0),
        (d, 3, "c", "x", 11, 250.0, 20.0, 0.0, 0.0, 250.0, 0.0, 0.0, 0, 0.0),
        (d, 4, "d", "x", 10, 201.0, 20.0, 5.0, 60.0, 141.0, 5.0, 20.0, 100, 5.0),
    ]
    got = {r["product_id"]: r for r in snapshot.processed(spark.createDataFrame(rows, SNAP)).collect()}
    assert [got[i]["demand_category"] for i in (1, 2, 3, 4)] == ["low", "medium", None, "high"]
    assert [got[i]["revenue_category"] for i in (1, 2, 3, 4)] == ["low_value", "medium_value", "high_value", "high_value"]
    assert [got[i]["marketing_mix_type"] for i in (1, 2, 3, 4)] == ["low_marketing_impact", "multi_channel_star", "organic_focused", "facebook_focused"]
    assert got[1]["category_clean"] == "other" and got[1]["unit_price"] == 0.0 and got[1]["marketing_efficiency"] == 0.0


def test_snapshot_falls_back_to_other_column_names(spark):
    d = spark.createDataFrame([(10, 100.0, 20.0, 90.0)], "units_sold bigint, revenue double, fb_spend double, fb_attributed_revenue double")
    r = snapshot.features(d).collect()[0]
    assert r["ads_roas_7d"] == 4.5 and r["unit_price"] == 10.0 and r["email_efficiency_3d"] == 0.0


def test_marketing_reorder_without_marketing_columns(spark):
    d = spark.createDataFrame([(1, 30, 300.0, 10, 10), (2, 30, 300.0, None, None)], "product_id bigint, units_sold bigint, revenue double, current_inventory_level bigint, available_inventory bigint")
    got = {r["product_id"]: r["marketing_optimized_reorder"] for r in reorder.marketing_reorder(d).collect()}
    assert got == {1: pytest.approx(39.0), 2: pytest.approx(39.0)}


def test_stock_equal_to_the_reorder_point_is_urgent(spark):
    d = spark.createDataFrame([(14, 14), (15, 14), (22, 14), (29, 14)], "have bigint, point bigint")
    assert [r[0] for r in d.select(inventory.urgency(F.col("have"), F.col("point"))).collect()] == ["URGENT", "HIGH", "MEDIUM", "LOW"]


def test_empty_and_bad_lists_drop_out_and_shares_add_up(spark):
    rows = [(1, '[{"product_id":1},{"product_id":2}]', 10.0), (2, "[]", 5.0), (3, None, 5.0), (4, "{bad", 5.0)]
    d = spark.createDataFrame(rows, "ad_id int, attributed_products string, spend double")
    got = sorted((r["ad_id"], r["product_id"], r["spend"]) for r in marketing.per_product(d, "attributed_products", "spend").collect())
    assert got == [(1, 1, 5.0), (1, 2, 5.0)]


def test_safe_arithmetic(spark):
    d = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (None, 4.0)], "a double, b double")
    assert [r[0] for r in d.select(fn.ratio("a", "b")).collect()] == [None, 2.5, None]
    assert [r[0] for r in d.select(fn.ratio_pos("a", "b")).collect()] == [0.0, 2.5, None]
    assert [r[0] for r in d.select(fn.floor_div("a", "b")).collect()] == [10.0, 2.5, None]


def test_missing_sales_use_the_same_weekday(spark):
    t = dt.datetime(2024, 1, 1, 9)
    rows = [(i, t + dt.timedelta(days=7 * i), (t + dt.timedelta(days=7 * i)).date(), 1, 2 + i, 10.0 * (i + 1)) for i in range(3)]
    d = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, date date, product_id bigint, quantity_sold bigint, revenue double")
    got = {r["date"]: (r["quantity_sold"], r["revenue"]) for r in features.fill_missing_sales(d, "2024-01-01", "2024-01-29").collect()}
    assert got == {dt.date(2024, 1, 22): (3, 20.0), dt.date(2024, 1, 29): (3, 20.0)}
    short = {r["date"]: r["revenue"] for r in features.fill_missing_sales(d, "2024-01-22", "2024-01-22", rows=2).collect()}
    assert short == {}  # no sale inside the asked range


def test_last_known_stock(spark):
    rows = [(1, dt.datetime(2024, 1, 2, 8), dt.date(2024, 1, 2), 1, 5, 1, 0, "a"), (2, dt.datetime(2024, 1, 2, 9), dt.date(2024, 1, 2), 1, 7, 1, 0, "b")]
    d = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, date date, product_id bigint, stock_level bigint, reserved_stock bigint, in_transit bigint, location string")
    got = [(r["date"].day, r["stock_level"], r["is_fallback"]) for r in features.last_known_stock(d, "2024-01-01", "2024-01-03").orderBy("date").collect()]
    assert got == [(2, 7, False), (3, 7, True)]


def test_anomalies_need_a_week(spark):
    rows = [(dt.date(2024, 1, i), 1, float(i)) for i in range(1, 6)]
    d = spark.createDataFrame(rows, "date date, quantity_sold bigint, revenue double")
    assert quality.sales_anomalies(d, "2024-01-31").count() == 0
    r = quality.sales_anomaly_metric(d, "2024-01-31").collect()[0]
    assert (r["metric_value"], r["status"]) == (0.0, "pass")


def test_timeliness_of_an_empty_feed_fails(spark):
    r = quality.timeliness(spark.createDataFrame([], "ts timestamp_ntz"), "sales", "2024-01-31").collect()[0]
    assert r["status"] == "fail" and math.isinf(r["metric_value"])


def test_financial_impact_limits(spark):
    d = spark.createDataFrame([(0.95, 1000, 50000.0, 8.0), (0.5, 10, 0.0, 3.0)], "service_level double, total_demand bigint, total_cost double, inventory_turnover double")
    a, b = kpi.financial_impact(d).collect()
    assert a["revenue_protected"] == pytest.approx(125.0) and a["cash_freed"] == pytest.approx(3750.0) and a["roi_percentage"] == 500.0 or 100 <= a["roi_percentage"] <= 500
    assert b["revenue_protected"] == 0.0 and b["roi_percentage"] == 200.0


def test_kpi_direction_flag(spark):
    v = spark.createDataFrame([("30_days", 30, "stockout_frequency", 0.10)], "window string, days int, metric string, value double")
    assert kpi.dashboard(v).collect()[0]["status"] == "on_target"
    assert kpi.dashboard(v, ("stockout_frequency",)).collect()[0]["status"] == "below_target"


def test_gate_decisions(spark):
    d = dt.date(2024, 1, 1)
    attr = spark.createDataFrame([(d,)], "date date")
    good = spark.createDataFrame([(d, 10.0, 5.0)], "date date, revenue double, total_attributed_revenue double")
    bad = spark.createDataFrame([(d, 10.0, 50.0)], "date date, revenue double, total_attributed_revenue double")
    decide = lambda a, b: validate.gate(a, b, "2024-01-01").collect()[0]["decision"]
    assert decide(attr, good) == "publish" and decide(attr, bad) == "rollback" and decide(attr.filter("false"), good) == "abort"


def test_order_segments(spark):
    d = spark.createDataFrame([(0,), (1,), (2,), (5,), (6,)], "customer_orders_count bigint")
    got = [r[0] for r in d.select(sales.order_count_segment(rest="unknown")).collect()]
    assert got == ["unknown", "new_customer", "returning_customer", "returning_customer", "loyal_customer"]


def test_inventory_model_reads_lines_once_and_plans_without_jobs(spark):
    t = Tables(spark, SF)
    products, orders, lines = t.products, t.shop_orders, t.line_items
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sparkContext.setJobGroup("planning", "no job is expected")
        df = inventory.current_inventory(products, orders, lines, "2001-08-02")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setJobGroup("", "")
    assert final.count("FileScan parquet") == 3 and "ReusedExchange" in final


def test_sales_without_a_product_are_not_ranked(spark):
    products = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "product_id bigint, inventory_quantity bigint")
    sales = spark.createDataFrame([(1, 10, 50.0), (2, 10, 20.0), (3, 4, None), (None, 9, 30.0)], "product_id bigint, qty_90d bigint, revenue_30d double")
    got = {r["product_id"]: r["monthly_revenue_rank"] for r in inventory.with_recent_sales(products, sales).collect()}
    assert got == {1: 0.0, 2: 100.0, 3: None}


def test_daily_sales_count_orders_once_without_a_hash_map_of_all_lines(spark):
    d, e = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 9)
    orders = [(1, e, d, "a", "X", "web", 100.0, 10.0, 2000.0, "paid", None), (2, e, d, "a", "X", "web", 50.0, 0.0, 10.0, "paid", None), (3, e, d, None, "X", "web", 50.0, 0.0, 10.0, "paid", None)]
    columns = "order_id long, created_at timestamp, order_date date, customer_email string, shipping_country string, source_name string, total_price double, total_discounts double, customer_total_spent double, financial_status string, cancelled_at timestamp"
    lines = [(1, 7, 2, 10.0, 0.0), (1, 7, 1, 10.0, 1.0), (2, 7, 1, 30.0, 0.0), (3, 7, 1, 5.0, 0.0), (2, 8, None, 4.0, 0.0)]
    # A repeated order row doubles its lines, but is no further order.
    orders = spark.createDataFrame([*orders, orders[0]], columns)
    items = spark.createDataFrame(lines, "order_id long, product_id long, quantity long, price double, total_discount double")
    found = sales.daily_sales(orders, items)
    got = {r.product_id: tuple(r)[2:] for r in found.collect()}
    assert got[7] == (8, 93.0, 3, 1, pytest.approx((20 + 18 + 30 + 5) / 6), 58.0, pytest.approx(0.4 / 6)) and got[8] == (None, None, 1, 1, None, 0.0, 0.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "HashAggregate(keys=[order_id" in x]
    Tables(spark, SF)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
