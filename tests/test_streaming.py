"""Streams over several batches against the batch result, restarts, rebuilds, the daily job."""

import datetime as dt

from pyspark.sql import functions as F

from shelfline.operators import sales as sales_op
from shelfline.sources import feeds, sinks
from shelfline.streaming import ingest, jobs

HEAD = "date,product_id,channel,quantity_sold,revenue,customer_segment,promotion_code,fulfillment_method\n"


def drop(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text(HEAD + "".join(f"{d},{p},{c},{q},{r},,,\n" for d, p, c, q, r in rows))


def day(i):
    return f"2024-01-{i:02d}T10:00:00"


def test_validated_feed_over_several_files_and_a_restart(spark, tmp_path):
    box = tmp_path / "drop"
    drop(box, "sales_1.csv", [(day(1), "P1", "online", 2, 20.0), (day(1), "P2", "pos", -1, 5.0)])
    drop(box, "sales_2.csv", [(day(2), "P1", "online", 3, 30.0)])
    drop(box, "other.csv", [(day(2), "PX", "online", 3, 30.0)])
    root, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        ingest.validated(ingest.feed_files(spark, str(box), "sales", per_trigger=1), "sales", root, check)

    run()
    good = spark.read.parquet(f"{root}/valid")
    assert sorted((r["product_id"], r["quantity_sold"]) for r in good.collect()) == [("P1", 2), ("P1", 3)]
    assert good.select("batch").distinct().count() == 2
    assert [r["issues"] for r in spark.read.parquet(f"{root}/quarantine").collect()] == [["negative_quantity"]]
    # nothing new: nothing read again; a new file: only that file
    run()
    assert spark.read.parquet(f"{root}/valid").count() == 2
    drop(box, "sales_3.csv", [(day(3), "P9", "pos", 1, 1.0)])
    run()
    assert spark.read.parquet(f"{root}/valid").count() == 3
    log = {r["file_name"]: (r["records_processed"], r["status"]) for r in spark.read.parquet(f"{root}/log").collect()}
    assert log == {"sales_1.csv": (2, "partial"), "sales_2.csv": (1, "success"), "sales_3.csv": (1, "success")}


SCHEMA = "event_id bigint, ts timestamp, product_id bigint, quantity_sold bigint, revenue double"


def batches(spark, tmp_path, parts):
    base = dt.datetime(2024, 1, 1)
    for i, rows in enumerate(parts):
        data = [(e, base + dt.timedelta(hours=h), p, q, float(q)) for e, h, p, q in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    schema = spark.createDataFrame([], SCHEMA).schema
    return ingest.files(spark, str(tmp_path / "in" / "*"), schema, fmt="parquet", per_trigger=1)


PARTS = [[(1, 1, 7, 2), (2, 30, 7, 3), (3, 2, 8, 1)], [(4, 3, 7, 5), (2, 30, 7, 3)], [(5, 31, 8, 4), (6, 60, 9, 1)]]


def test_running_totals_over_batches_equal_the_batch_result(spark, tmp_path):
    s = batches(spark, tmp_path, PARTS)
    out = str(tmp_path / "totals")
    ingest.daily_totals(s, out, str(tmp_path / "check"))
    got = {(str(r["date"]), r["product_id"]): r["total_quantity"] for r in ingest.current_totals(spark, out).collect()}
    assert got == {("2024-01-01", 7): 7, ("2024-01-02", 7): 6, ("2024-01-01", 8): 1, ("2024-01-02", 8): 4, ("2024-01-03", 9): 1}


def test_dedup_over_batches(spark, tmp_path):
    s = batches(spark, tmp_path, PARTS)
    out = str(tmp_path / "dedup")
    ingest.deduplicated(s, ["event_id"], "ts", "5 days", out, str(tmp_path / "check"))
    assert sorted(r["event_id"] for r in ingest.first_rows(spark, out, s).collect()) == [1, 2, 3, 4, 5, 6]


LATE = [[(1, 1, 7, 2), (2, 240, 7, 3)], [(3, 2, 7, 5), (4, 239, 8, 1), (2, 240, 7, 3)], [(1, 1, 7, 2), (5, 3, 8, 4), (6, 300, 9, 1), (7, None, 9, 1)]]


def test_rows_beyond_the_delay_are_kept_and_counted(spark, tmp_path):
    parts = [[(e, h if h is not None else 0, p, q) for e, h, p, q in rows if h is not None] for rows in LATE]
    s = batches(spark, tmp_path, parts)
    out = str(tmp_path / "dedup")
    ingest.deduplicated(s, ["event_id"], "ts", "1 day", out, str(tmp_path / "check"), buckets=3)
    got = {r["event_id"]: r["late"] for r in ingest.first_rows(spark, out, s).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert sorted((r["batch"], r["rows"], r["kept"], r["late"]) for r in ingest.arrivals(spark, out).collect()) == [(0, 2, 2, 0), (1, 3, 2, 1), (2, 3, 2, 1)]
    totals = str(tmp_path / "totals")
    ingest.daily_totals(s, totals, str(tmp_path / "check2"), "1 day")
    found = {(str(r["date"]), r["product_id"]): (r["total_quantity"], r["late_transactions"]) for r in ingest.current_totals(spark, totals).collect()}
    assert found == {("2024-01-01", 7): (9, 2), ("2024-01-01", 8): (4, 1), ("2024-01-11", 7): (6, 0), ("2024-01-10", 8): (1, 0), ("2024-01-13", 9): (1, 0)}


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path, monkeypatch):
    s = batches(spark, tmp_path, PARTS)
    calls = []
    monkeypatch.setattr(ingest, "run_to_end", lambda df, check, batch, mode="append": calls.append(batch))
    ingest.daily_totals(s, str(tmp_path / "totals"), "unused")
    ingest.deduplicated(s, ["event_id"], "ts", "1 day", str(tmp_path / "dedup"), "unused", buckets=3)
    totals, first = calls
    frames = [spark.read.parquet(str(tmp_path / "in" / f"part{i}")) for i in range(3)]
    for batch_id, df in ((0, frames[0]), (1, frames[1]), (1, frames[1]), (2, frames[2]), (2, frames[2])):
        totals(df, batch_id)
        first(df, batch_id)
    got = {(str(r["date"]), r["product_id"]): r["total_quantity"] for r in ingest.current_totals(spark, str(tmp_path / "totals")).collect()}
    assert got == {("2024-01-01", 7): 7, ("2024-01-02", 7): 6, ("2024-01-01", 8): 1, ("2024-01-02", 8): 4, ("2024-01-03", 9): 1}
    assert sorted(r["event_id"] for r in ingest.first_rows(spark, str(tmp_path / "dedup"), frames[0]).collect()) == [1, 2, 3, 4, 5, 6]


def live_tables(spark):
    products = spark.createDataFrame([(f"P{i}", "other", 1.0, 2.0) for i in range(1, 4)], "product_id string, category string, unit_cost double, selling_price double")
    stock = spark.createDataFrame([(1, dt.datetime(2024, 1, 5), dt.date(2024, 1, 5), "P1", "loc", 5, 1, 0)], "event_id bigint, ts timestamp_ntz, date date, product_id string, location string, stock_level bigint, reserved_stock bigint, in_transit bigint")
    signals = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 5), dt.date(2024, 1, 5), "P1", "high", 0.1, 2.0, "cold", "none", 0.2)],
        "event_id bigint, ts timestamp_ntz, date date, product_id string, external_demand string, market_trend double, competitor_price double, weather_factor string, event_impact string, social_sentiment double",
    )
    return {"products": products, "stock": stock, "signals": signals}


def test_daily_job_uses_what_it_ingested_and_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    import pytest

    box, root = tmp_path / "drop", str(tmp_path / "root")
    drop(box, "sales_1.csv", [(day(5), "P1", "online", 2, 20.0), (day(5), "P2", "pos", 3, 5.0)])

    def run():
        stream = ingest.feed_files(spark, str(box), "sales", per_trigger=1)
        return jobs.daily_job(spark, {"sales": stream}, root, live_tables(spark), "2024-01-06", "2024-01-05").collect()[0]

    def seen():
        rows = spark.read.parquet(f"{root}/metrics").filter("data_source = 'sales' and metric_name = 'completeness'").collect()
        demand = {r["product_id"]: r["velocity_avg_daily_quantity"] for r in spark.read.parquet(f"{root}/features").collect()}
        return round(rows[0]["metric_value"], 6), demand["P1"]

    done, failing = [], [True]
    real, build = jobs.quality.comprehensive, jobs.features.feature_set
    monkeypatch.setattr(jobs.quality, "comprehensive", lambda *a: (done.append("checks"), real(*a))[1])

    def feature_set(*a):
        if failing and failing.pop():
            raise RuntimeError("lost")
        done.append("features")
        return build(*a)

    monkeypatch.setattr(jobs.features, "feature_set", feature_set)
    with pytest.raises(RuntimeError, match="lost"):
        run()
    assert done == ["checks"]
    first = run()  # goes on with the features
    assert done == ["checks", "features"] and (first["files_processed"], first["records_processed"]) == (1, 2)
    assert seen() == (round(2 / 3, 6), 2.0)
    run()  # nothing new: no step is done again
    assert done == ["checks", "features"]
    drop(box, "sales_2.csv", [(day(5), "P3", "online", 1, 20.0), (day(5), "P1", "pos", 4, 5.0)])
    second = run()
    assert done == ["checks", "features"] * 2 and second["records_processed"] == 4
    assert seen() == (1.0, 6.0)


def test_stock_alerts_and_freshness(spark, tmp_path):
    rows = [[(1, 1, 7, 2), (2, 5, 7, 0)], [(3, 8, 8, 100)]]
    s = batches(spark, tmp_path, rows).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "product_id", F.col("quantity_sold").alias("stock_level"), F.lit(0).cast("bigint").alias("reserved_stock"))
    rules = spark.createDataFrame([(7, 5), (8, 5)], "product_id bigint, reorder_point bigint")
    out = str(tmp_path / "alerts")
    ingest.stock_alerts(s, rules, out, str(tmp_path / "c1"))
    assert [(r["product_id"], r["alert"]) for r in ingest.current_alerts(spark, out).collect()] == [(7, "stockout")]
    f = str(tmp_path / "fresh")
    src = s.select(F.lit("stock").alias("source"), "ts")
    ingest.freshness(src, f, str(tmp_path / "c2"))
    got = ingest.latest_batch(spark, f).collect()
    assert [(r["source"], r["rows"], r["latest"]) for r in got] == [("stock", 3, dt.datetime(2024, 1, 1, 8))]


def test_stock_alerts_close_and_late_updates_raise_none(spark, tmp_path):
    parts = [[(1, 1, 7, 0), (2, 9, 8, 100)], [(3, 2, 7, 500), (4, 3, 8, 0)], [(5, 3, 9, 2), (6, 1, 9, 90)]]
    s = batches(spark, tmp_path, parts).select("event_id", "ts", "product_id", F.col("quantity_sold").alias("stock_level"), F.lit(0).cast("bigint").alias("reserved_stock"))
    rules = spark.createDataFrame([(7, 5), (8, 5), (9, 5)], "product_id bigint, reorder_point bigint")
    out = str(tmp_path / "alerts")
    ingest.stock_alerts(s, rules, out, str(tmp_path / "c"))
    assert [(r["product_id"], r["alert"]) for r in ingest.current_alerts(spark, out).collect()] == [(9, "reorder")]


def test_feed_stream_finds_columns_by_name_and_keeps_raw_text(spark, tmp_path):
    box = tmp_path / "drop"
    drop(box, "sales_1.csv", [(day(1), "P1", "online", 2, 20.0), (day(1), "P2", "pos", "lots", 5.0)])
    (box / "sales_2.csv").write_text("date,product_id,revenue,channel,quantity_sold\n" + f"{day(2)},P3,99.5,online,3\n")
    root = str(tmp_path / "out")
    ingest.validated(ingest.feed_files(spark, str(box), "sales"), "sales", root, str(tmp_path / "check"))
    good = {r["product_id"]: (r["revenue"], r["channel"], r["quantity_sold"]) for r in spark.read.parquet(f"{root}/valid").collect()}
    assert good == {"P1": (20.0, "online", 2), "P3": (99.5, "online", 3)}
    assert ['"quantity_sold":"lots"' in r["raw"] for r in spark.read.parquet(f"{root}/quarantine").collect()] == [True]


def _per_day(df):
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def test_rebuild_touches_only_missing_dates(spark, tmp_path):
    d = [dt.date(2024, 1, i) for i in range(1, 11)]
    src = spark.createDataFrame([(x, 1) for x in d for _ in range(2)], "date date, v int")
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(x, 99) for x in d[:8]], "date date, n bigint")
    sinks.overwrite_dates(old, path)
    jobs.rebuild_missing(src, _per_day, path, "2024-01-11", 3)
    got = {r["date"]: r["n"] for r in spark.read.parquet(path).collect()}
    assert got == {**{x: 99 for x in d[:8]}, d[8]: 2, d[9]: 2}
    # first build: no target yet
    fresh = str(tmp_path / "fresh")
    jobs.rebuild_missing(src, _per_day, fresh, "2024-01-11", 3)
    assert spark.read.parquet(fresh).count() == 3


def test_weeks_cover_the_range():
    assert jobs.weeks("2024-01-01", "2024-01-16") == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-16")]


def test_settled_filter_is_shared_by_the_feed(spark):
    o = spark.createDataFrame([(1, "paid", None), (2, "pending", None), (3, "paid", dt.datetime(2024, 1, 1))], "order_id bigint, financial_status string, cancelled_at timestamp_ntz")
    assert [r["order_id"] for r in o.filter(sales_op.is_settled()).collect()] == [1]


def test_undeclared_stream_columns_are_refused(spark, tmp_path):
    import pytest

    (tmp_path / "x").mkdir()
    s = ingest.files(spark, str(tmp_path / "x"), feeds.text_schema(["date"]))
    with pytest.raises(ValueError, match="lacks declared columns"):
        ingest.validated(s, "sales", str(tmp_path / "o"), str(tmp_path / "c"))
