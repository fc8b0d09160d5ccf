"""Feed files: headers, types, faults, defaults, routing, upsert, exports, corrupted samples."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from shelfline.operators import validate
from shelfline.sources import feeds, sinks


def put(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc) as f:
        f.write(text)
    return str(path)


BAD_SALES = """date,product_id,channel,quantity_sold,revenue,customer_segment,promotion_code,fulfillment_method
2025-07-15T10:00:00,P1,online,5,50.0,,,
2025-07-15T11:00:00,P2,pos,-3,30.0,premium,SAVE10,store
not-a-date,P3,online,abc,-20.0,,,
2025-07-15T12:00:00,,carrier_pigeon,2,20.0,,,
"""
BAD_STOCK = """date,product_id,location,stock_level,reserved_stock,in_transit,supplier_id,last_reorder_date
2025-07-15T10:00:00,P1,loc,-5,10,0,S1,2025-06-01
2025-07-15T10:00:00,P2,,abc,0,0,S1,bad
2025-07-15T10:00:00,P3,loc,20,2,,S1,2025-06-01
"""


def test_byte_order_mark_is_dropped(spark, tmp_path):
    p = put(tmp_path / "sales_1.csv", "date,product_id\n2025-01-01,P1\n", "utf-8-sig")
    assert feeds.read_csv(spark, p).columns == ["date", "product_id"]


def test_typed_feed_and_quarantine(spark, tmp_path):
    p = put(tmp_path / "sales_data_20250715.csv", BAD_SALES)
    d = feeds.read_feed(spark, p, "sales")
    assert dict(d.dtypes)["quantity_sold"] == "bigint" and dict(d.dtypes)["date"] == "timestamp_ntz"
    good, bad = validate.split(d, "sales")
    assert [r["product_id"] for r in good.collect()] == ["P1"]
    why = {r["product_id"]: set(r["issues"]) for r in bad.collect()}
    assert why == {"P2": {"negative_quantity"}, "P3": {"missing_date", "missing_quantity_sold"}, None: {"missing_product_id"}}
    filled = feeds.with_defaults(good, "sales").collect()[0]
    assert (filled["customer_segment"], filled["fulfillment_method"]) == ("regular", "warehouse")


def test_rule_counts_on_corrupted_samples(spark, tmp_path):
    sales = feeds.read_feed(spark, put(tmp_path / "sales.csv", BAD_SALES), "sales")
    got = {r["rule"]: r["rows"] for r in validate.rule_counts(sales, validate.business_rules("sales")).collect()}
    assert got == {"negative_quantity": 1, "negative_revenue": 1, "invalid_channel": 1}
    stock = feeds.read_feed(spark, put(tmp_path / "inventory.csv", BAD_STOCK), "inventory")
    got = {r["rule"]: r["rows"] for r in validate.rule_counts(stock, validate.business_rules("inventory")).collect()}
    assert got == {"negative_stock": 1, "reserved_over_stock": 1}


SWAPPED = """product_id,date,revenue,quantity_sold,channel
P8,2025-07-15T10:00:00,42.5,3,online
P9,2025-07-15T10:00:00,7.0,1,"on
line"
P10,2025-07-15T10:00:00,7.0,2,pos,EXTRA,FIELDS
P11,2025-07-15T10:00:00,many,2,pos
"""


def test_columns_are_found_by_name_in_files_of_different_order(spark, tmp_path):
    put(tmp_path / "sales_a.csv", BAD_SALES)
    put(tmp_path / "sales_b.csv", SWAPPED, "utf-8-sig")
    put(tmp_path / "sales_c.csv", "")
    put(tmp_path / "sales_d.csv", "product_id,channel\nP12,online\n")
    d = feeds.read_feed(spark, str(tmp_path), "sales")
    rows = {r["product_id"]: r for r in d.collect()}
    assert len(rows) == 9
    assert (rows["P8"]["revenue"], rows["P8"]["quantity_sold"], rows["P8"]["channel"], rows["P8"]["file_name"]) == (42.5, 3, "online", "sales_b.csv")
    assert rows["P9"]["channel"] == "on\nline"
    assert (rows["P1"]["revenue"], rows["P1"]["quantity_sold"]) == (50.0, 5)
    good, bad = validate.split(d, "sales")
    assert sorted(r["product_id"] for r in good.collect()) == ["P1", "P8", "P9"]
    why = {r["product_id"]: (r["issues"], r["raw"]) for r in bad.collect()}
    assert why["P10"][0] == ["malformed_row"] and "EXTRA,FIELDS" in why["P10"][1]
    assert why["P11"][0] == ["missing_revenue"] and '"revenue":"many"' in why["P11"][1]
    assert "missing_date" in why["P12"][0]
    assert feeds.read_csv(spark, str(tmp_path), ["revenue", "nothing"]).filter("revenue = '42.5' and nothing is null").count() == 1


def test_newest_write_reads_one_folder_only_and_ties_fall_to_the_last(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        os.utime(put(tmp_path / name / "x.csv", f"v\n{name}\n"), (1000, 1000))
    folders = [str(tmp_path / "b"), str(tmp_path / "a")]
    assert [r["v"] for r in feeds.newest_write(spark, folders).collect()] == ["a"]
    os.utime(tmp_path / "b" / "x.csv", (2000, 2000))
    assert [r["v"] for r in feeds.newest_write(spark, folders).collect()] == ["b"]


def test_a_day_without_rows_misses_all_products(spark):
    perf = spark.createDataFrame(
        [(dt.date(2024, 1, d), p, 1.0, 0.0, 0.0, 1) for d in (1, 3) for p in (1, 2)],
        "date date, product_id bigint, revenue double, total_attributed_revenue double, total_marketing_spend double, inventory_level bigint",
    )
    products = spark.createDataFrame([(1,), (2,)], "product_id bigint")
    got = validate.product_alerts(perf, products, "2024-01-05", 4).collect()
    assert sorted((r["date"].day, r["alert"], r["value"]) for r in got) == [(2, "missing_products", 1.0), (4, "missing_products", 1.0)]


def test_type_losses(spark, tmp_path):
    raw = feeds.read_csv(spark, put(tmp_path / "sales.csv", BAD_SALES))
    got = {r["column"]: (r["lost"], r["level"]) for r in validate.type_losses(raw, "sales").collect()}
    assert got["date"] == (1, "error") and got["quantity_sold"] == (1, "warning") and got["revenue"] == (0, "ok")


def test_schema_issues():
    assert validate.schema_issues(["date", "product_id", "extra"], "demand") == [("missing_column", "error", "external_demand"), ("unexpected_column", "warning", "extra")]
    assert validate.schema_issues([], "weather") == [("unknown_type", "error", "weather")]
    assert validate.schema_issues(list(feeds.declared("sales")), "sales") == []


def test_routing(spark):
    d = spark.createDataFrame([("sales_20250101.csv",), ("Inventory_x.csv",), ("demand.csv",), ("readme.txt",)], "f string")
    assert [r[0] for r in d.select(feeds.route("f")).collect()] == ["sales", "inventory", "demand", None]


def test_newest_file(spark, tmp_path):
    put(tmp_path / "a.csv", "x\n1\n")
    put(tmp_path / "b.csv", "x\n2\n3\n")
    now = time.time()
    os.utime(tmp_path / "a.csv", (now, now))
    os.utime(tmp_path / "b.csv", (now - 100, now - 100))
    d = feeds.newest_file(spark, str(tmp_path))
    assert [(r["x"], r["file_name"]) for r in d.collect()] == [("1", "a.csv")]


ORDERS = """order_id,created_at,updated_at,processed_at,cancelled_at,customer_email,total_price,subtotal_price,financial_status,source_name
1,2025-09-03T08:30:00,2025-09-03T08:30:00,2025-09-03T08:35:00,,a@x,89.99,74.99,paid,web
2,2025-09-03T09:30:00,2025-09-03T09:30:00,soon,never,b@x,10.5,9.0,paid,
"""
ADS = """date,campaign_id,ad_id,spend,impressions,attributed_products
2025-09-03,c1,a1,10.5,100,"[{""product_id"":1,""attributed_revenue"":5.0},{""product_id"":2}]"
2025-09-03,c1,a2,1,10,[{oops
2025-09-03,c1,a3,1,10,
2025-09-03,c1,a4,1,10,[]
"""


def test_orders_loader(spark, tmp_path):
    d = feeds.orders_csv(feeds.read_csv(spark, put(tmp_path / "orders.csv", ORDERS))).orderBy("order_id").collect()
    assert d[0]["created_at"] == dt.datetime(2025, 9, 3, 8, 30) and d[1]["cancelled_at"] is None and d[1]["processed_at"] is None
    assert d[1]["source_name"] == "web" and d[0]["customer_orders_count"] == 1 and d[0]["shipping_cost"] == 0.0


def test_orders_loader_refuses_unreadable_created_at(spark, tmp_path):
    raw = feeds.read_csv(spark, put(tmp_path / "orders.csv", ORDERS.replace("2025-09-03T08:30:00,2025", "yesterday,2025")))
    with pytest.raises(Exception, match="bad created_at"):
        feeds.orders_csv(raw).collect()


def test_ads_loader_flags_bad_json(spark, tmp_path):
    d = {r["ad_id"]: r for r in feeds.ads_csv(feeds.read_csv(spark, put(tmp_path / "ads.csv", ADS))).collect()}
    assert [p["product_id"] for p in d["a1"]["products"]] == [1, 2] and d["a1"]["spend"] == 10.5
    assert d["a2"]["products"] is None and d["a2"]["bad_products"]
    assert d["a3"]["products"] is None and not d["a3"]["bad_products"]
    assert d["a4"]["products"] == [] and not d["a4"]["bad_products"]


def test_load_all(spark, tmp_path):
    got = feeds.load_all(spark, {"orders": put(tmp_path / "o.csv", ORDERS), "ads": put(tmp_path / "a.csv", ADS)})
    assert got["orders"].count() == 2 and got["ads"].count() == 4


def test_upsert_keeps_the_last_row_per_key(spark):
    s = "k bigint, updated_at timestamp_ntz, v string"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, t, "old"), (2, t, "stay")], s)
    new = spark.createDataFrame([(1, t + dt.timedelta(days=1), "new"), (3, t, "add"), (3, t, "adx")], s)
    got = {r["k"]: r["v"] for r in feeds.upsert(old, new, ["k"], ["updated_at"]).collect()}
    assert got == {1: "new", 2: "stay", 3: "adx"}
    # loading the same batch again changes nothing
    again = feeds.upsert(feeds.upsert(old, new, ["k"], ["updated_at"]), new, ["k"], ["updated_at"])
    assert {r["k"]: r["v"] for r in again.collect()} == got


def test_export_conventions(spark, tmp_path):
    d = spark.createDataFrame([(dt.date(2024, 3, 15), 1.005, 0.123456, True, None)], "date date, price double, rate double, ok boolean, note string")
    sinks.write_csv(sinks.export_ready(d, ("price",), ("rate",)).coalesce(1), str(tmp_path / "out"))
    text = [open(tmp_path / "out" / f).read() for f in os.listdir(tmp_path / "out") if f.endswith(".csv")]
    assert text == ["date,price,rate,ok,note\n2024-03-15,1.01,0.1235,true,\n"]


def test_export_names(spark):
    day = dt.date(2024, 12, 30)
    names = [sinks.export_name("sales", day, g) for g in ("daily", "weekly", "monthly")]
    assert names == ["sales_2024-12-30.csv", "sales_weekly_2025-01.csv", "sales_monthly_2024-12.csv"]
    d = spark.createDataFrame([(day,)], "d date")
    assert [d.select(sinks.export_stamp("sales", F.col("d"), g)).collect()[0][0] for g in ("daily", "weekly", "monthly")] == names


def test_dynamic_partition_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    s = "date date, v int"
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    sinks.overwrite_dates(spark.createDataFrame([(a, 1), (b, 2)], s), p)
    sinks.overwrite_dates(spark.createDataFrame([(b, 3)], s), p)
    assert sorted((r["date"], r["v"]) for r in spark.read.parquet(p).collect()) == [(a, 1), (b, 3)]


def test_snapshot_issues_with_missing_columns_and_no_rows(spark):
    d = spark.createDataFrame([], "date date, product_id bigint, units_sold bigint, revenue double")
    got = {r["issue"]: r["rows"] for r in validate.snapshot_issues(d).collect()}
    assert got["empty_dataset"] == 1 and got["missing_column_product_name"] == 1 and got["missing_column_total_attributed_revenue"] == 1
