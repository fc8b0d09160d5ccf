"""Data-quality metrics over the live feeds, in one tidy layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at_least, cases, count_if, floor_div, money, ratio, since, up_to
from ..functions.stats import with_position, zscores

# Pass and warning limits of each metric.
PASS_RATIO, WARN_RATIO = 0.95, 0.90
PASS_HOURS, WARN_HOURS = 24.0, 48.0
PASS_SCORE, WARN_SCORE = 2.0, 1.5
HIGH_VOLATILITY, VERY_HIGH_VOLATILITY = 2.0, 3.0
DEMAND_LEVELS = ["high", "medium", "low"]
STATUS_RANK = {"pass": 0, "warning": 1, "fail": 2}


def ratio_status(c: str | Column) -> Column:
    return at_least(c, [(PASS_RATIO, "pass"), (WARN_RATIO, "warning")], "fail")


def _tidy(df: DataFrame, name: str, source: str, value: Column, threshold: float, status: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("metric_name"), F.lit(source).alias("data_source"), value.cast("double").alias("metric_value"), F.lit(threshold).alias("threshold_value"), status.alias("status")
    )


def completeness(feed: DataFrame, source: str, products: DataFrame, day: str) -> DataFrame:
    """Share of products seen in the feed on a day."""
    total = products.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    seen = feed.filter(_on(day)).agg(F.countDistinct("product_id").alias("n")).withColumn("v", F.col("n") / total)
    return _tidy(seen, "completeness", source, F.col("v"), PASS_RATIO, ratio_status("v"))


def _on(day: str) -> Column:
    return F.col("date") == F.lit(day).cast("date")


def _hours_late(now: str) -> Column:
    return F.coalesce((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9, F.lit(float("inf")))


def _late_status(c: str) -> Column:
    return up_to(c, [(PASS_HOURS, "pass"), (WARN_HOURS, "warning")], "fail")


def timeliness(feed: DataFrame, source: str, now: str) -> DataFrame:
    """Hours since the newest row; no rows count as infinitely late."""
    return _tidy(feed.agg(_hours_late(now).alias("v")), "timeliness", source, F.col("v"), PASS_HOURS, _late_status("v"))


def _daily(sales: DataFrame, as_of: str, days: int) -> DataFrame:
    d = sales.filter(since("date", as_of, days)).groupBy("date").agg(F.sum("quantity_sold").cast("double").alias("quantity"), F.sum("revenue").alias("revenue"))
    return zscores(d, {"quantity": "zq", "revenue": "zr"}).withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


def sales_anomalies(sales: DataFrame, as_of: str, days: int = 30, min_days: int = 7) -> DataFrame:
    """Days whose quantity or revenue lies more than 1.5 deviations from the mean (one row per day first)."""
    d = _daily(sales, as_of, days).filter(F.col("n_days") >= min_days)
    rows = F.array(
        F.struct(F.lit("quantity").alias("type"), F.col("quantity").alias("value"), F.abs("zq").alias("z_score")),
        F.struct(F.lit("revenue").alias("type"), F.col("revenue").alias("value"), F.abs("zr").alias("z_score")),
    )
    a = d.select("date", F.inline(rows)).filter(F.col("z_score") > WARN_SCORE)
    return a.withColumn("severity", F.when(F.col("z_score") > PASS_SCORE, "high").otherwise("medium"))


def sales_anomaly_metric(sales: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    g = _daily(sales, as_of, days).agg(F.max(F.greatest(F.abs("zq"), F.abs("zr"))).alias("z"), F.count(F.lit(1)).alias("n"))
    v = F.when(F.col("n") >= 7, F.coalesce("z", F.lit(0.0))).otherwise(0.0)
    return _tidy(g, "anomaly_score", "sales", v, PASS_SCORE, up_to(v, [(WARN_SCORE, "pass"), (PASS_SCORE, "warning")], "fail"))


def _stock_range(stock: DataFrame, as_of: str, days: int) -> DataFrame:
    s = F.col("stock_level")
    return (
        stock.filter(since("date", as_of, days))
        .groupBy("product_id")
        .agg(F.min(s).alias("min_stock"), F.max(s).alias("max_stock"), F.avg(s).alias("avg_stock"), F.count(F.lit(1)).alias("updates"))
        .filter(F.col("updates") >= 3)
        .withColumn("volatility_ratio", floor_div(F.col("max_stock") - F.col("min_stock"), "avg_stock"))
    )


def inventory_anomalies(stock: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Products with a wide stock range, and products that ran out."""
    v = F.col("volatility_ratio")
    rules = F.array(
        F.when(v > HIGH_VOLATILITY, F.struct(F.lit("high_volatility").alias("type"), F.when(v > VERY_HIGH_VOLATILITY, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("min_stock") == 0, F.struct(F.lit("stockout").alias("type"), F.lit("high").alias("severity"))),
    )
    hits = F.filter(rules, lambda x: x.isNotNull())
    return _stock_range(stock, as_of, days).select("product_id", "min_stock", "max_stock", "avg_stock", "volatility_ratio", F.inline(hits))


def inventory_anomaly_metric(stock: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    v = F.col("volatility_ratio")
    g = _stock_range(stock, as_of, days).agg(F.coalesce(F.max(F.when(v > HIGH_VOLATILITY, v)), F.lit(0.0)).alias("v"))
    return _tidy(g, "anomaly_score", "inventory", F.col("v"), PASS_SCORE, up_to("v", [(WARN_SCORE, "pass"), (PASS_SCORE, "warning")], "fail"))


def _bad_rows(source: str) -> Column:
    if source == "sales":
        return count_if(F.col("quantity_sold") < 0) + count_if(F.col("revenue") < 0)
    if source == "inventory":
        return count_if(F.col("reserved_stock") > F.col("stock_level")) + count_if(F.col("stock_level") < 0)
    return count_if(~F.col("external_demand").isin(DEMAND_LEVELS)) + count_if(~F.col("market_trend").between(-1.0, 1.0))


def _consistent(source: str) -> Column:
    return 1 - _bad_rows(source) / F.greatest(F.count(F.lit(1)), F.lit(1))


def consistency(feed: DataFrame, source: str) -> DataFrame:
    """1 - bad rows / rows, with the bad-row tests of the feed."""
    return _tidy(feed.agg(_consistent(source).alias("v")), "consistency", source, F.col("v"), PASS_RATIO, ratio_status("v"))


def feed_checks(feed: DataFrame, source: str, products: DataFrame, as_of: str, day: str) -> DataFrame:
    """Completeness, timeliness and consistency of one feed from a single pass over it."""
    total = products.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    g = feed.agg(F.countDistinct(F.when(_on(day), F.col("product_id"))).alias("n"), _hours_late(as_of).alias("late"), _consistent(source).alias("ok")).withColumn("seen", F.col("n") / total)
    rows = [("completeness", "seen", PASS_RATIO, ratio_status("seen")), ("timeliness", "late", PASS_HOURS, _late_status("late")), ("consistency", "ok", PASS_RATIO, ratio_status("ok"))]
    tidy = [
        F.struct(F.lit(name).alias("metric_name"), F.lit(source).alias("data_source"), F.col(c).cast("double").alias("metric_value"), F.lit(limit).alias("threshold_value"), status.alias("status"))
        for name, c, limit, status in rows
    ]
    return g.select(F.inline(F.array(*tidy)))


def comprehensive(sales: DataFrame, stock: DataFrame, signals: DataFrame, products: DataFrame, as_of: str, day: str) -> DataFrame:
    """Every check of every feed, in one layout."""
    parts = [feed_checks(f, n, products, as_of, day) for n, f in (("sales", sales), ("inventory", stock), ("demand", signals))]
    parts += [sales_anomaly_metric(sales, as_of), inventory_anomaly_metric(stock, as_of)]
    return reduce(DataFrame.unionByName, parts)


def roll_up(checks: DataFrame) -> DataFrame:
    """Counts per status and the worst status overall."""
    worst = F.max(cases([(F.col("status") == k, v) for k, v in STATUS_RANK.items()]))
    g = checks.agg(F.count(F.lit(1)).alias("total_checks"), *[count_if(F.col("status") == s).alias(f"{s}_checks") for s in STATUS_RANK], worst.alias("w"))
    return g.select("total_checks", *[f"{s}_checks" for s in STATUS_RANK], F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("w") + 1).alias("overall_status"))


def metric_rows(checks: DataFrame, as_of: str) -> DataFrame:
    """Check results as rows of the metrics table, details as JSON text."""
    return checks.select(
        F.lit(as_of).cast("date").alias("date"), "data_source", "metric_name", "metric_value", "threshold_value", "status",
        F.to_json(F.struct("data_source", "metric_name", "status")).alias("details"),
    )


def daily_completeness(feed: DataFrame, source: str, products: DataFrame) -> DataFrame:
    total = products.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    g = feed.groupBy("date").agg(F.countDistinct("product_id").alias("n"))
    v = F.col("n") / total
    return g.select("date", F.lit(source).alias("data_source"), F.lit("completeness").alias("metric_name"), v.alias("metric_value"), ratio_status(v).alias("status"))


def quality_trends(history: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Ordered history, slope, mean and latest value per source and metric (one row per day each)."""
    keys = ["data_source", "metric_name"]
    h = with_position(history.filter(since("date", as_of, days)), keys, ["date"])
    n = F.count(F.lit(1))
    values = F.sort_array(F.collect_list(F.struct("date", "metric_value")))
    return h.groupBy(*keys).agg(
        n.alias("points"),
        F.array_join(F.transform(values, lambda x: F.date_format(x["date"], "yyyy-MM-dd")), ",").alias("dates"),
        F.when(n > 2, F.regr_slope("metric_value", F.col("idx").cast("double"))).otherwise(0.0).alias("trend_slope"),
        F.avg("metric_value").alias("avg_value"),
        F.max_by("metric_value", "date").alias("latest_value"),
        F.max_by("status", "date").alias("latest_status"),
    )


def freshness(sources: dict[str, tuple[DataFrame, str]], today: str) -> DataFrame:
    """Rows, newest time and rows of today per table."""
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("total_records"),
            F.max(F.col(ts).cast("date")).alias("last_update"),
            count_if(F.col(ts).cast("date") == F.lit(today).cast("date")).alias("today_records"),
        )
        for name, (df, ts) in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def rule_monitor(orders: DataFrame, ads: DataFrame, mail: DataFrame) -> DataFrame:
    """Failing rows per rule; the failing rows are selected first, so total equals failed, as published."""
    rules = [
        ("order_revenue_validation", orders, F.col("total_price") < 0, "Negative revenue values detected"),
        ("ad_spend_validation", ads, F.col("spend") < 0, "Negative spend values detected"),
        ("email_engagement_validation", mail, F.col("open_rate") > 100, "Invalid open rates detected"),
    ]
    parts = [
        df.filter(bad).agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("total_records"), count_if(bad).alias("failed_records"), F.lit(text).alias("issue_description"))
        for name, df, bad, text in rules
    ]
    return reduce(DataFrame.unionByName, parts)


def export_monitor(log: DataFrame, now: str, days: int = 7) -> DataFrame:
    g = (
        log.filter(since("export_date", now, days))
        .groupBy("export_type")
        .agg(F.count(F.lit(1)).alias("record_count"), F.max("created_at").alias("last_export_time"), count_if(F.col("validation_status") == "PASS").alias("successful_records"))
    )
    rate = money(ratio("successful_records", "record_count") * 100)
    late = F.col("last_export_time") < F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 25 HOURS")
    return g.withColumn("success_rate_percentage", rate).withColumn(
        "export_health_status", cases([(late, "OVERDUE"), (F.col("success_rate_percentage") < 95, "QUALITY_ISSUE")], "HEALTHY")
    )


def export_alert(log: DataFrame, today: str, days: int = 7) -> DataFrame:
    """One alert line for today's exports against half the week's average volume (a one-row subquery)."""
    usual = log.filter(since("export_date", today, days)).agg(F.avg("record_count") * 0.5).scalar()
    g = log.filter(F.col("export_date") == F.lit(today).cast("date")).agg(
        F.count(F.lit(1)).alias("exports_today"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records_today"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors_today"),
        F.avg("record_count").alias("m"),
        F.max("error_count").alias("e"),
    )
    text = cases(
        [
            (F.col("exports_today") == 0, "CRITICAL: No exports generated today"),
            (F.col("m") < usual, "WARNING: Export volume significantly lower than average"),
            (F.col("e") > 0, "ERROR: Export errors detected"),
        ],
        "OK: All exports healthy",
    )
    return g.select(text.alias("alert_message"), "exports_today", "total_records_today", "total_errors_today")


def retained(df: DataFrame, as_of: str, days: int = 90, ts: str = "date") -> DataFrame:
    return df.filter(since(ts, as_of, days))


def retention_report(tables: dict[str, DataFrame], as_of: str, days: int = 90, ts: str = "date") -> DataFrame:
    old = ~since(ts, as_of, days)
    parts = [df.agg(F.lit(n).alias("table_name"), count_if(old).alias("dropped_rows"), count_if(~old).alias("kept_rows")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def workflow_summary(log: DataFrame, checks: DataFrame, as_of: str) -> DataFrame:
    """Success rate of the ingestion log and the share of passed checks."""
    passed = checks.agg(count_if(F.col("status") == "pass") / F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return log.agg(
        F.lit(as_of).cast("date").alias("date"),
        F.count(F.lit(1)).alias("files_processed"),
        F.sum("records_processed").alias("records_processed"),
        floor_div(F.sum("records_successful"), F.sum("records_processed")).alias("success_rate"),
    ).withColumn("quality_score", passed)
