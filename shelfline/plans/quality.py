"""Quality metrics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import marketing
from ..operators import quality as op
from ..session import scratch
from ..sources import sinks
from ..sources.tables import EVENT_AS_OF, Tables
from .registry import query
from .sqltext import EV, define

DAY = "2024-01-30"
LAST = f"DATE '{DAY}'"


def _status(v: str) -> str:
    return f"CASE WHEN {v} >= 0.95 THEN 'pass' WHEN {v} >= 0.9 THEN 'warning' ELSE 'fail' END"


_FEEDS = {"sales": "sales", "inventory": "stock", "demand": "signals"}


def _completeness(name: str) -> str:
    return f"""SELECT 'completeness' AS metric_name, '{name}' AS data_source, v AS metric_value, CAST(0.95 AS DOUBLE) AS threshold_value, {_status('v')} AS status
    FROM (SELECT count(DISTINCT product_id) / (SELECT count(*) FROM products) AS v FROM {_FEEDS[name]} WHERE date = {LAST})"""


def _timeliness(name: str) -> str:
    return f"""SELECT 'timeliness', '{name}', v, CAST(24 AS DOUBLE), CASE WHEN v <= 24 THEN 'pass' WHEN v <= 48 THEN 'warning' ELSE 'fail' END FROM (SELECT (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000 AS v FROM {_FEEDS[name]})"""


_BAD = {
    "sales": "count(*) FILTER (quantity_sold < 0) + count(*) FILTER (revenue < 0)",
    "inventory": "count(*) FILTER (reserved_stock > stock_level) + count(*) FILTER (stock_level < 0)",
    "demand": "count(*) FILTER (external_demand NOT IN ('high', 'medium', 'low')) + count(*) FILTER (market_trend NOT BETWEEN -1 AND 1)",
}


def _consistency(name: str) -> str:
    return f"""SELECT 'consistency', '{name}', v, CAST(0.95 AS DOUBLE), {_status('v')} FROM (SELECT 1 - ({_BAD[name]}) / count(*) AS v FROM {_FEEDS[name]})"""


define("sold_days", f"SELECT date, q, r, abs((q - avg(q) OVER ()) / stddev_pop(q) OVER ()) AS zq, abs((r - avg(r) OVER ()) / stddev_pop(r) OVER ()) AS zr FROM (SELECT date, CAST(sum(quantity_sold) AS DOUBLE) AS q, sum(revenue) AS r FROM sales WHERE date >= {EV} - 30 GROUP BY 1)")
define("stock_ranges", f"SELECT *, (max_stock - min_stock) / greatest(avg_stock, 1) AS volatility_ratio FROM (SELECT product_id, min(stock_level) AS min_stock, max(stock_level) AS max_stock, avg(stock_level) AS avg_stock, count(*) AS n FROM stock WHERE date >= {EV} - 30 GROUP BY 1) WHERE n >= 3")
_SCORE = "CASE WHEN v <= 1.5 THEN 'pass' WHEN v <= 2 THEN 'warning' ELSE 'fail' END"
define(
    "checks",
    " UNION ALL ".join(f(n) for n in _FEEDS for f in (_completeness, _timeliness, _consistency))
    + f""" UNION ALL SELECT 'anomaly_score', 'sales', v, CAST(2 AS DOUBLE), {_SCORE} FROM (SELECT max(greatest(zq, zr)) AS v FROM sold_days)
    UNION ALL SELECT 'anomaly_score', 'inventory', v, CAST(2 AS DOUBLE), {_SCORE} FROM (SELECT coalesce(max(volatility_ratio) FILTER (volatility_ratio > 2), 0) AS v FROM stock_ranges)""",
)
_CHECK = "metric_name, data_source, round(metric_value, 6) AS metric_value, threshold_value, status"


def checks(t: Tables) -> DataFrame:
    return op.comprehensive(t.sales, t.stock, t.signals, t.products, EVENT_AS_OF, DAY)


@query("Q01_completeness", f"SELECT {_CHECK} FROM checks WHERE metric_name = 'completeness'")
def completeness(t: Tables) -> DataFrame:
    parts = [op.completeness(d, n, t.products, DAY) for n, d in (("sales", t.sales), ("inventory", t.stock), ("demand", t.signals))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("Q02_timeliness", f"SELECT {_CHECK} FROM checks WHERE metric_name = 'timeliness'")
def timeliness(t: Tables) -> DataFrame:
    parts = [op.timeliness(d, n, EVENT_AS_OF) for n, d in (("sales", t.sales), ("inventory", t.stock), ("demand", t.signals))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "Q03_sales_anomalies",
    """SELECT *, CASE WHEN z_score > 2 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT date, 'quantity' AS type, q AS value, round(zq, 6) AS z_score FROM sold_days UNION ALL SELECT date, 'revenue', round(r, 6), round(zr, 6) FROM sold_days) WHERE z_score > 1.5""",
)
def sales_anomalies(t: Tables) -> DataFrame:
    return op.sales_anomalies(t.sales, EVENT_AS_OF)


@query(
    "Q04_inventory_anomalies",
    """SELECT product_id, min_stock, max_stock, round(avg_stock, 6) AS avg_stock, round(volatility_ratio, 6) AS volatility_ratio, 'high_volatility' AS type, CASE WHEN volatility_ratio > 3 THEN 'high' ELSE 'medium' END AS severity FROM stock_ranges WHERE volatility_ratio > 2
    UNION ALL SELECT product_id, min_stock, max_stock, round(avg_stock, 6), round(volatility_ratio, 6), 'stockout', 'high' FROM stock_ranges WHERE min_stock = 0""",
)
def inventory_anomalies(t: Tables) -> DataFrame:
    return op.inventory_anomalies(t.stock, EVENT_AS_OF)


@query("Q05_consistency", f"SELECT {_CHECK} FROM checks WHERE metric_name = 'consistency'")
def consistency(t: Tables) -> DataFrame:
    parts = [op.consistency(d, n) for n, d in (("sales", t.sales), ("inventory", t.stock), ("demand", t.signals))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("Q06_all_checks", f"SELECT {_CHECK} FROM checks")
def all_checks(t: Tables) -> DataFrame:
    return checks(t)


@query(
    "Q06_roll_up",
    """SELECT count(*) AS total_checks, count(*) FILTER (status = 'pass') AS pass_checks, count(*) FILTER (status = 'warning') AS warning_checks, count(*) FILTER (status = 'fail') AS fail_checks,
    CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'pass' END AS overall_status FROM checks""",
)
def roll_up(t: Tables) -> DataFrame:
    return op.roll_up(checks(t))


@query(
    "Q07_metric_rows",
    f"""SELECT {EV} AS date, data_source, metric_name, round(metric_value, 6) AS metric_value, threshold_value, status, '{{"data_source":"' || data_source || '","metric_name":"' || metric_name || '","status":"' || status || '"}}' AS details FROM checks""",
)
def metric_rows(t: Tables) -> DataFrame:
    return op.metric_rows(checks(t), EVENT_AS_OF)


define(
    "daily_completeness",
    " UNION ALL ".join(
        f"SELECT date, '{n}' AS data_source, 'completeness' AS metric_name, v AS metric_value, {_status('v')} AS status FROM (SELECT date, count(DISTINCT product_id) / (SELECT count(*) FROM products) AS v FROM {f} GROUP BY 1)" for n, f in _FEEDS.items()
    ),
)


@query(
    "Q08_quality_trends",
    f"""SELECT data_source, metric_name, count(*) AS points, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates, round(CASE WHEN count(*) > 2 THEN regr_slope(metric_value, i) ELSE 0 END, 6) AS trend_slope, round(avg(metric_value), 6) AS avg_value,
    round(arg_max(metric_value, date), 6) AS latest_value, arg_max(status, date) AS latest_status FROM (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY date) AS i FROM daily_completeness WHERE date >= {EV} - 7) GROUP BY 1, 2""",
)
def trends(t: Tables) -> DataFrame:
    parts = [op.daily_completeness(d, n, t.products) for n, d in (("sales", t.sales), ("inventory", t.stock), ("demand", t.signals))]
    return op.quality_trends(parts[0].unionByName(parts[1]).unionByName(parts[2]), EVENT_AS_OF)


@query(
    "Q09_freshness",
    f"""SELECT 'orders' AS table_name, count(*) AS total_records, max(order_date) AS last_update, count(*) FILTER (order_date = {LAST}) AS today_records FROM shop_orders UNION ALL SELECT 'ads', count(*), max(date), count(*) FILTER (date = {LAST}) FROM ads
    UNION ALL SELECT 'email', count(*), max(date), count(*) FILTER (date = {LAST}) FROM email""",
)
def freshness(t: Tables) -> DataFrame:
    return op.freshness({"orders": (t.shop_orders, "created_at"), "ads": (t.ads, "date"), "email": (t.email, "date")}, DAY)


@query(
    "Q10_rule_monitor",
    """SELECT 'order_revenue_validation' AS check_name, count(*) AS total_records, count(*) AS failed_records, 'Negative revenue values detected' AS issue_description FROM shop_orders WHERE order_id % 37 = 0
    UNION ALL SELECT 'ad_spend_validation', count(*), count(*), 'Negative spend values detected' FROM ads WHERE product_id % 20 = 3 UNION ALL SELECT 'email_engagement_validation', count(*), count(*), 'Invalid open rates detected' FROM email WHERE product_id % 20 = 3 AND delivered > 0""",
)
def rule_monitor(t: Tables) -> DataFrame:
    # negative totals, negative spend and twice as many opens as mails are planted
    odd = F.col("product_id") % 20 == 3
    orders = t.shop_orders.withColumn("total_price", F.when(F.col("order_id") % 37 == 0, -1.0).otherwise(F.col("total_price")))
    ads = t.ads.withColumn("spend", F.when(odd, -1.0).otherwise(F.col("spend")))
    mail = t.email.withColumn("unique_opens", F.when(odd, F.col("delivered") * 2).otherwise(F.least("unique_opens", "delivered")))
    return op.rule_monitor(orders, ads, marketing.mail_metrics(mail))


define(
    "export_log",
    """SELECT CASE WHEN event_id % 2 = 0 THEN 'daily_sales_performance' ELSE 'marketing_performance_summary' END AS export_type, date AS export_date, ts AS created_at, event_id % 1000 AS record_count,
    CASE WHEN event_id % 30 = 0 THEN 'FAIL' ELSE 'PASS' END AS validation_status, CASE WHEN event_id % 30 = 0 THEN 1 ELSE 0 END AS error_count FROM signals""",
)


def export_log(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.signals.select(
        F.when(e % 2 == 0, "daily_sales_performance").otherwise("marketing_performance_summary").alias("export_type"), F.col("date").alias("export_date"), F.col("ts").alias("created_at"),
        (e % 1000).alias("record_count"), F.when(e % 30 == 0, "FAIL").otherwise("PASS").alias("validation_status"), F.when(e % 30 == 0, 1).otherwise(0).alias("error_count"),
    )


@query(
    "Q11_export_monitor",
    f"""SELECT *, CASE WHEN last_export_time < TIMESTAMP '2024-01-31' - INTERVAL 25 HOUR THEN 'OVERDUE' WHEN success_rate_percentage < 95 THEN 'QUALITY_ISSUE' ELSE 'HEALTHY' END AS export_health_status FROM (SELECT export_type, count(*) AS record_count, max(created_at) AS last_export_time,
    count(*) FILTER (validation_status = 'PASS') AS successful_records, CAST(round(CAST(count(*) FILTER (validation_status = 'PASS') / count(*) * 100 AS DECIMAL(18,4)), 2) AS DOUBLE) AS success_rate_percentage FROM export_log WHERE export_date >= {EV} - 7 GROUP BY 1)""",
)
def export_monitor(t: Tables) -> DataFrame:
    return op.export_monitor(export_log(t), EVENT_AS_OF)


@query(
    "Q12_export_alert",
    f"""SELECT CASE WHEN count(*) = 0 THEN 'CRITICAL: No exports generated today' WHEN avg(record_count) < (SELECT avg(record_count) * 0.5 FROM export_log WHERE export_date >= {LAST} - 7) THEN 'WARNING: Export volume significantly lower than average'
    WHEN max(error_count) > 0 THEN 'ERROR: Export errors detected' ELSE 'OK: All exports healthy' END AS alert_message, count(*) AS exports_today, CAST(coalesce(sum(record_count), 0) AS BIGINT) AS total_records_today, CAST(coalesce(sum(error_count), 0) AS BIGINT) AS total_errors_today
    FROM export_log WHERE export_date = {LAST}""",
)
def export_alert(t: Tables) -> DataFrame:
    return op.export_alert(export_log(t), DAY)


@query(
    "Q13_retention",
    f"SELECT 'export_log' AS table_name, count(*) FILTER (date < {EV} - 10) AS dropped_rows, count(*) FILTER (date >= {EV} - 10) AS kept_rows FROM signals UNION ALL SELECT 'metrics', count(*) FILTER (date < {EV} - 10), count(*) FILTER (date >= {EV} - 10) FROM metrics",
)
def retention(t: Tables) -> DataFrame:
    # the events span one month, so ten days stand for the retention period
    return op.retention_report({"export_log": t.signals, "metrics": t.metrics}, EVENT_AS_OF, 10)


@query(
    "Q13_retention_drop",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(DISTINCT date) FILTER (date < {EV} - 10) AS dropped_days, count(DISTINCT date) FILTER (date >= {EV} - 10) AS kept_days, count(*) FILTER (date >= {EV} - 10) AS kept_rows FROM {n}"
        for n in ("signals", "metrics")
    ),
)
def retention_drop(t: Tables) -> DataFrame:
    """Two tables stored by date lose their old partitions; what is left is read back."""
    limit = (date.fromisoformat(EVENT_AS_OF) - timedelta(days=10)).isoformat()
    parts = []
    for name, rows in (("signals", t.signals.select("date", "product_id")), ("metrics", t.metrics.select("date", "metric_value"))):
        path = scratch(t.spark, name)
        sinks.overwrite_dates(rows.filter("date is not null"), path)
        dropped = sinks.drop_before(t.spark, path, limit).agg(F.count_if("dropped").alias("dropped_days")).first()[0]
        left = t.spark.read.parquet(path).agg(F.countDistinct("date").alias("kept_days"), F.count(F.lit(1)).alias("kept_rows"))
        parts.append(left.select(F.lit(name).alias("table_name"), F.lit(dropped).cast("bigint").alias("dropped_days"), "kept_days", "kept_rows"))
    return parts[0].unionByName(parts[1])


def ingestion_log(t: Tables) -> DataFrame:
    rows = t.sales.select(F.concat(F.lit("sales_"), F.date_format("date", "yyyyMMdd"), F.lit(".csv")).alias("file_name"), F.lit("sales").alias("file_type"), (F.col("quantity_sold") < 5).alias("is_valid"))
    return sinks.ingestion_log(rows)


define(
    "ingestion_log",
    """SELECT *, records_processed - records_successful AS records_failed, CASE WHEN records_successful = records_processed THEN 'success' WHEN records_successful > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT 'sales_' || strftime(date, '%Y%m%d') || '.csv' AS file_name, 'sales' AS file_type,
    count(*) AS records_processed, count(*) FILTER (quantity_sold < 5) AS records_successful FROM sales GROUP BY 1, 2)""",
)


@query("S12_ingestion_log", "SELECT * FROM ingestion_log")
def log(t: Tables) -> DataFrame:
    return ingestion_log(t)


@query(
    "Q14_workflow_summary",
    f"""SELECT {EV} AS date, count(*) AS files_processed, CAST(sum(records_processed) AS BIGINT) AS records_processed, round(sum(records_successful) / greatest(sum(records_processed), 1), 6) AS success_rate, round((SELECT count(*) FILTER (status = 'pass') / count(*) FROM checks), 6) AS quality_score FROM ingestion_log""",
)
def workflow_summary(t: Tables) -> DataFrame:
    return op.workflow_summary(ingestion_log(t), checks(t), EVENT_AS_OF)


