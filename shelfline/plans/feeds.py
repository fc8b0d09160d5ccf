"""Sources, sinks and streams over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import feeds, sinks
from ..sources.tables import EVENT_AS_OF, Tables
from ..streaming import ingest
from . import quality  # noqa: F401  its tables are used below
from .registry import query
from .sqltext import TABLES, define
from .validation import raw_sales

# -- readers ----------------------------------------------------------------------------

define(
    "raw_feed",
    """SELECT CASE WHEN event_id % 19 = 0 THEN NULL ELSE date_trunc('second', ts) END AS date, CAST(product_id AS VARCHAR) AS product_id, CASE WHEN event_id % 29 = 0 THEN 'phone' ELSE channel END AS channel, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN -quantity_sold ELSE quantity_sold END AS quantity_sold,
    CASE WHEN event_id % 31 = 0 THEN -5 ELSE revenue END AS revenue, CASE WHEN event_id % 2 = 0 THEN 'premium' END AS customer_segment, CAST(NULL AS VARCHAR) AS promotion_code, CAST(NULL AS VARCHAR) AS fulfillment_method FROM sales""",
)


@query("S01_csv_scan", "SELECT CAST(event_id AS VARCHAR) AS event_id, channel, CAST(quantity_sold AS VARCHAR) AS quantity_sold FROM sales")
def csv_scan(t: Tables) -> DataFrame:
    """Sales written as CSV to the shared folder and read back as text."""
    path = scratch(t.spark, "csv")
    sinks.write_csv(t.sales.select("event_id", "channel", "quantity_sold"), path)
    return feeds.read_csv(t.spark, path)


@query("S02_typed_feed", "SELECT * FROM raw_feed")
def typed_feed(t: Tables) -> DataFrame:
    path = scratch(t.spark, "feed")
    sinks.write_csv(raw_sales(t), path)
    return feeds.read_feed(t.spark, path, "sales").drop("file_name", "raw", "malformed")


@query(
    "S03_feed_routing",
    """SELECT file_name, CASE WHEN contains(file_name, 'sales') THEN 'sales' WHEN contains(file_name, 'inventory') THEN 'inventory' WHEN contains(file_name, 'demand') THEN 'demand' END AS feed, count(*) AS rows FROM (SELECT CASE event_type WHEN 'purchase' THEN 'SALES' WHEN 'view' THEN 'inventory' WHEN 'error' THEN 'demand' ELSE event_type END AS x,
    lower(x) || '_data_' || strftime(ts, '%Y%m%d') || '.csv' AS file_name FROM events) GROUP BY 1, 2""",
)
def routing(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "sales").when(F.col("event_type") == "view", "inventory").when(F.col("event_type") == "error", "demand").otherwise(F.col("event_type"))
    name = F.concat(kind, F.lit("_data_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv"))
    return t.raw("events").groupBy(name.alias("file_name")).agg(F.count(F.lit(1)).alias("rows")).withColumn("feed", feeds.route("file_name"))


@query(
    "S05_orders_load",
    """SELECT order_id, created_at, CASE WHEN order_id % 7 = 0 THEN NULL ELSE cancelled_at END AS cancelled_at, CAST(CASE WHEN customer_orders_count = 1 THEN 1 ELSE customer_orders_count END AS BIGINT) AS customer_orders_count, total_price, coalesce(source_name, 'web') AS source_name, CAST(0 AS DOUBLE) AS shipping_cost FROM shop_orders""",
)
def orders_load(t: Tables) -> DataFrame:
    """Orders as text (some cancel dates unreadable, some counts absent) through the orders loader."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    raw = t.shop_orders.select(
        "order_id",
        F.date_format("created_at", stamp).alias("created_at"),
        F.date_format("created_at", stamp).alias("updated_at"),
        F.lit("soon").alias("processed_at"),
        F.when(F.col("order_id") % 7 == 0, "unknown").otherwise(F.date_format("cancelled_at", stamp)).alias("cancelled_at"),
        F.when(F.col("customer_orders_count") > 1, F.col("customer_orders_count").cast("string")).alias("customer_orders_count"),
        F.col("total_price").cast("string").alias("total_price"),
        F.col("total_price").cast("string").alias("subtotal_price"),
        "source_name",
    )
    return feeds.orders_csv(raw).select("order_id", "created_at", "cancelled_at", "customer_orders_count", "total_price", "source_name", "shipping_cost")


@query(
    "S06_line_items_load",
    """SELECT order_id, line_number, quantity, round(price, 6) AS price, CASE WHEN quantity > 25 THEN round(total_discount, 6) ELSE 0 END AS total_discount, true AS requires_shipping, true AS taxable, 'manual' AS fulfillment_service FROM line_items""",
)
def lines_load(t: Tables) -> DataFrame:
    raw = t.line_items.select(
        "order_id", "line_number", F.col("quantity").cast("string").alias("quantity"), F.col("price").cast("string").alias("price"),
        F.when(F.col("quantity") > 25, F.col("total_discount").cast("string")).alias("total_discount"),
    )
    return feeds.line_items_csv(raw)


_BAD = "product_id % 10 = 4"


@query(
    "S07_ads_load",
    f"""SELECT date, ad_id, round(spend, 6) AS spend, CASE WHEN attributed_products IS NULL OR {_BAD} THEN NULL ELSE CAST(json_array_length(attributed_products) AS BIGINT) END AS listed, attributed_products IS NOT NULL AND {_BAD} AS bad_products FROM ads""",
)
def ads_load(t: Tables) -> DataFrame:
    """Ad rows as text, some with broken JSON."""
    broken = F.when(F.col("attributed_products").isNotNull() & (F.col("product_id") % 10 == 4), "[{oops").otherwise(F.col("attributed_products"))
    raw = t.ads.select(F.col("date").cast("string").alias("date"), "ad_id", F.col("spend").cast("string").alias("spend"), broken.alias("attributed_products"))
    return feeds.ads_csv(raw).select("date", "ad_id", "spend", F.when(F.col("products").isNotNull(), F.size("products").cast("bigint")).alias("listed"), "bad_products")


@query(
    "S08_mail_load",
    f"""SELECT date, segment_name, recipients * CAST(1 AS DOUBLE) AS recipients, CASE WHEN featured_products IS NULL OR {_BAD} THEN NULL ELSE CAST(json_array_length(featured_products) AS BIGINT) END AS listed, featured_products IS NOT NULL AND {_BAD} AS bad_products FROM email""",
)
def mail_load(t: Tables) -> DataFrame:
    broken = F.when(F.col("featured_products").isNotNull() & (F.col("product_id") % 10 == 4), "not json").otherwise(F.col("featured_products"))
    raw = t.email.select(F.col("date").cast("string").alias("date"), "segment_name", F.col("recipients").cast("string").alias("recipients"), broken.alias("featured_products"))
    return feeds.mail_csv(raw).select("date", "segment_name", "recipients", F.when(F.col("products").isNotNull(), F.size("products").cast("bigint")).alias("listed"), "bad_products")


@query(
    "S11_append_with_defaults",
    """SELECT CAST(date AS DATE) AS date, product_id, channel, quantity_sold, revenue, coalesce(customer_segment, 'regular') AS customer_segment, 'warehouse' AS fulfillment_method FROM raw_feed WHERE date IS NOT NULL AND quantity_sold >= 0""",
)
def append_defaults(t: Tables) -> DataFrame:
    """Valid rows with defaults appended to a date-partitioned table, read back."""
    from ..operators import validate

    path = scratch(t.spark, "append")
    good, _ = validate.split(feeds.typed(raw_sales(t), feeds.declared("sales")), "sales")
    rows = feeds.with_defaults(good, "sales").withColumn("date", F.col("date").cast("date"))
    sinks.append_by_date(rows, path)
    return t.spark.read.parquet(path).select("date", "product_id", "channel", "quantity_sold", "revenue", "customer_segment", "fulfillment_method")


@query(
    "S13_export_format",
    """SELECT strftime(date, '%Y-%m-%d') AS date, product_id, CAST(round(CAST(revenue AS DECIMAL(18,4)), 2) AS DOUBLE) AS revenue, round(ads_attributed_revenue / nullif(ads_spend, 0), 4) AS roas, CASE WHEN units_sold > 0 THEN 'true' ELSE 'false' END AS sold FROM performance""",
    digits=4,
)
def export_format(t: Tables) -> DataFrame:
    from ..functions.scalar import ratio

    d = t.performance.select("date", "product_id", "revenue", ratio("ads_attributed_revenue", "ads_spend").alias("roas"), (F.col("units_sold") > 0).alias("sold"))
    return sinks.export_ready(d, ("revenue",))


@query(
    "S14_export_names",
    """SELECT order_date, 'daily_sales_' || strftime(order_date, '%Y-%m-%d') || '.csv' AS daily, 'daily_sales_weekly_' || strftime(order_date, '%G-%V') || '.csv' AS weekly, 'daily_sales_monthly_' || strftime(order_date, '%Y-%m') || '.csv' AS monthly, count(*) AS rows FROM shop_orders GROUP BY 1""",
)
def export_names(t: Tables) -> DataFrame:
    d = t.shop_orders.groupBy("order_date").agg(F.count(F.lit(1)).alias("rows"))
    day = F.col("order_date")
    return d.select("order_date", *[sinks.export_stamp("daily_sales", day, g).alias(g) for g in ("daily", "weekly", "monthly")], "rows")


@query(
    "S16_json_report",
    "SELECT count(*) AS files, CAST(sum(records_processed) AS BIGINT) AS records, round(sum(records_successful) / sum(records_processed), 6) AS success_rate FROM ingestion_log",
)
def json_report(t: Tables) -> DataFrame:
    from .quality import ingestion_log

    path = scratch(t.spark, "report")
    g = ingestion_log(t).agg(
        F.count(F.lit(1)).alias("files"), F.sum("records_processed").alias("records"), (F.sum("records_successful") / F.sum("records_processed")).alias("success_rate")
    )
    sinks.write_report(g, path)
    return t.spark.read.schema("files bigint, records bigint, success_rate double").json(path)


# -- streams ------------------------------------------------------------------------------


def event_stream(t: Tables) -> DataFrame:
    """The event file as a stream, with the columns of the batch table."""
    schema = t.raw("events").schema
    # as a pattern the path may be one file or a folder of files
    d = ingest.files(t.spark, f"{t.sf_dir}/events.parque[t]", schema, fmt="parquet")
    return d.withColumns({"product_id": F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"), "date": F.col("ts").cast("date")})


def sales_stream(t: Tables) -> DataFrame:
    return event_stream(t).filter(F.col("event_type") == "purchase").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "date", "product_id", (1 + F.col("event_id") % 5).alias("quantity_sold"), F.col("value").alias("revenue")
    )


def _paths(t: Tables, label: str) -> tuple[str, str]:
    root = scratch(t.spark, label)
    return f"{root}/out", f"{root}/checkpoint"


@query("T01_stream_ingest", "SELECT event_id, date, product_id, quantity_sold, revenue FROM sales")
def stream_ingest(t: Tables) -> DataFrame:
    out, check = _paths(t, "ingest")
    ingest.ingest(sales_stream(t).drop("ts"), out, check)
    return t.spark.read.parquet(out)


@query(
    "T02_stream_validate",
    """SELECT side, count(*) AS rows, round(sum(revenue), 4) AS revenue FROM (SELECT CASE WHEN date IS NULL OR quantity_sold IS NULL OR quantity_sold < 0 THEN 'quarantine' ELSE 'valid' END AS side, revenue FROM raw_feed) GROUP BY 1""",
    digits=4,
)
def stream_validate(t: Tables) -> DataFrame:
    """Feed files dropped in a folder, validated batch by batch into valid and quarantine tables."""
    drop = scratch(t.spark, "drop")
    sinks.write_csv(raw_sales(t).select(*[c if c in ("date", "product_id", "channel", "quantity_sold", "revenue", "customer_segment") else F.lit(None).cast("string").alias(c) for c in feeds.declared("sales")]), drop)
    out, check = _paths(t, "validate")
    ingest.validated(ingest.feed_files(t.spark, drop, "sales", glob="*.csv"), "sales", out, check)
    sides = [t.spark.read.parquet(f"{out}/{s}").select(F.lit(s).alias("side"), "revenue") for s in ("valid", "quarantine")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.sum("revenue").alias("revenue"))


#: Rows of the last days arrive first; of the older ones, those with even numbers next, the others last.
ARRIVAL = {"recent": "date >= DATE '2024-01-20'", "even": "date < DATE '2024-01-20' AND event_id % 2 = 0", "odd": "date < DATE '2024-01-20' AND event_id % 2 = 1"}
_LATE = "date < DATE '2024-01-20' AND ts < (SELECT max(ts) FROM sales) - INTERVAL 2 DAY"


def out_of_order(t: Tables, twice: bool = False) -> DataFrame:
    """The sales in three files, one a batch, most rows long after newer ones. twice: a fourth file repeats all."""
    drop = scratch(t.spark, "arrivals")
    sales = t.sales.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "date", "product_id", "quantity_sold", "revenue")
    for i, where in enumerate([*ARRIVAL.values(), *["true"] * twice]):
        sales.filter(where).drop("date").coalesce(1).write.parquet(f"{drop}/part{i}")
    return ingest.files(t.spark, f"{drop}/*", sales.drop("date").schema, fmt="parquet", per_trigger=1)


@query("T03_stream_dedup", f"SELECT event_id, product_id, quantity_sold, {_LATE} AS late FROM sales")
def stream_dedup(t: Tables) -> DataFrame:
    """The feed out of order and sent twice: each row is kept once, those beyond the delay of two days are marked."""
    out, check = _paths(t, "dedup")
    stream = out_of_order(t, twice=True).select("event_id", "ts", "product_id", "quantity_sold")
    ingest.deduplicated(stream, ["event_id"], "ts", "2 days", out, check)
    return ingest.first_rows(t.spark, out, stream).drop("ts")


@query(
    "T04_stream_daily_totals",
    f"SELECT date, product_id, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity, round(sum(revenue), 6) AS total_revenue, count(*) AS transactions, count(*) FILTER ({_LATE}) AS late_transactions FROM sales GROUP BY 1, 2",
)
def stream_totals(t: Tables) -> DataFrame:
    """Totals of sales that arrive out of order, with a delay shorter than the data."""
    out, check = _paths(t, "totals")
    ingest.daily_totals(out_of_order(t), out, check, "2 days")
    return ingest.current_totals(t.spark, out)


@query(
    "T05_stream_stock_alerts",
    """SELECT product_id, stock_level, reserved_stock, reorder_point, CASE WHEN stock_level <= reserved_stock THEN 'stockout' ELSE 'reorder' END AS alert FROM (SELECT s.product_id, arg_max(stock_level, ts) AS stock_level, arg_max(reserved_stock, ts) AS reserved_stock, any_value(reorder_point) AS reorder_point
    FROM stock s JOIN parameters r ON r.product_id = s.product_id AND is_active GROUP BY 1) WHERE stock_level <= reserved_stock OR stock_level <= reorder_point""",
)
def stream_alerts(t: Tables) -> DataFrame:
    """The stock updates arrive in three files whose times overlap, one file a batch."""
    out, check = _paths(t, "alerts")
    drop = scratch(t.spark, "updates")
    for part in range(3):
        t.events.filter((F.col("event_type") == "view") & (F.col("event_id") % 3 == part)).coalesce(1).write.parquet(f"{drop}/part{part}")
    updates = ingest.files(t.spark, f"{drop}/*", t.events.schema, fmt="parquet", per_trigger=1)
    s = updates.select("event_id", "ts", "product_id", F.floor("value").cast("bigint").alias("stock_level"), (F.col("event_id") % 7).alias("reserved_stock"))
    ingest.stock_alerts(s, t.parameters.filter("is_active"), out, check)
    return ingest.current_alerts(t.spark, out).select("product_id", "stock_level", "reserved_stock", "reorder_point", "alert")


@query(
    "T06_stream_freshness",
    "SELECT event_type AS source, max(ts) AS latest, count(*) AS rows, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000, 6) AS hours FROM events GROUP BY 1",
)
def stream_freshness(t: Tables) -> DataFrame:
    out, check = _paths(t, "freshness")
    ingest.freshness(event_stream(t).select(F.col("event_type").alias("source"), "ts"), out, check)
    late = (F.unix_micros(F.lit(EVENT_AS_OF).cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 3.6e9
    return ingest.latest_batch(t.spark, out).withColumn("hours", late)


@query(
    "S10_load_all_sources",
    """SELECT order_date AS date, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units, round(sum(revenue), 4) AS revenue FROM sales_lines GROUP BY 1""",
    digits=4,
)
def load_all(t: Tables) -> DataFrame:
    """Orders and lines written as CSV, loaded by the multi-source loader, turned into the sales feed."""
    from ..operators import sales

    root = scratch(t.spark, "sources")
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    o = t.shop_orders
    text = o.select(
        "order_id", F.date_format("created_at", stamp).alias("created_at"), F.date_format("created_at", stamp).alias("updated_at"), F.lit(None).cast("string").alias("processed_at"),
        F.date_format("cancelled_at", stamp).alias("cancelled_at"), "customer_email", "customer_total_spent", "total_price", F.col("total_price").alias("subtotal_price"), "total_discounts",
        "financial_status", "shipping_country", "source_name",
    )
    sinks.write_csv(text, f"{root}/orders")
    sinks.write_csv(t.line_items.select("order_id", "line_number", "product_id", "quantity", "price", "total_discount"), f"{root}/line_items")
    loaded = feeds.load_all(t.spark, {"orders": f"{root}/orders", "line_items": f"{root}/line_items"})
    orders = loaded["orders"].withColumn("order_date", F.col("created_at").cast("date"))
    feed = sales.sales_feed(orders, loaded["line_items"])
    return feed.groupBy("date").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity_sold").alias("units"), F.sum("revenue").alias("revenue"))


def _daily_revenue(df: DataFrame) -> DataFrame:
    return df.groupBy("date", "product_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"))


_DAILY = "SELECT date, product_id, count(*) AS orders, round(sum(revenue), 6) AS revenue FROM conversions GROUP BY 1, 2"


@query("T07_incremental_rebuild", _DAILY)
def incremental(t: Tables) -> DataFrame:
    """A table built up to two days ago, then completed by the rebuild of missing dates."""
    from ..streaming import jobs

    path = scratch(t.spark, "rebuild")
    old = t.conversions.filter(F.col("date") < F.date_sub(F.lit(EVENT_AS_OF).cast("date"), 2))
    sinks.overwrite_dates(_daily_revenue(old), path)
    jobs.rebuild_missing(t.conversions, _daily_revenue, path, EVENT_AS_OF)
    return t.spark.read.parquet(path).select("date", "product_id", "orders", "revenue")


@query("T08_weekly_backfill", _DAILY)
def weekly_backfill(t: Tables) -> DataFrame:
    from ..streaming import jobs

    path = scratch(t.spark, "backfill")
    jobs.backfill(t.conversions, _daily_revenue, path, "2024-01-01", "2024-01-31")
    return t.spark.read.parquet(path).select("date", "product_id", "orders", "revenue")


# The checks, over the valid rows of the feed in place of the live sales.
define("fed_sales", "SELECT CAST(date AS DATE) AS date, date AS ts, CAST(product_id AS BIGINT) AS product_id, quantity_sold, revenue FROM raw_feed WHERE date IS NOT NULL AND quantity_sold >= 0")
for _name in ("sold_days", "checks"):
    define(f"fed_{_name}", re.sub(r"\bFROM (sales|sold_days)\b", r"FROM fed_\1", TABLES[_name]))


@query(
    "T09_daily_job",
    """SELECT DATE '2024-01-31' AS date, CAST(1 AS BIGINT) AS files_ok, CAST(count(*) AS BIGINT) AS records_processed, round(count(*) FILTER (date IS NOT NULL AND quantity_sold >= 0) / count(*), 6) AS success_rate, round((SELECT count(*) FILTER (status = 'pass') / count(*) FROM fed_checks), 6) AS quality_score FROM raw_feed""",
)
def daily_job(t: Tables) -> DataFrame:
    """The whole daily job over a dropped sales feed: checks and features come from the rows it ingested."""
    from ..streaming import jobs

    drop, root = scratch(t.spark, "drop"), scratch(t.spark, "daily")
    declared = feeds.declared("sales")
    raw = raw_sales(t)
    sinks.write_csv(raw.select(*[c if c in raw.columns else F.lit(None).cast("string").alias(c) for c in declared]), drop)
    stream = ingest.feed_files(t.spark, drop, "sales", glob="*.csv")
    tables = {"sales": t.sales, "stock": t.stock, "signals": t.signals, "products": t.products}
    report = jobs.daily_job(t.spark, {"sales": stream}, root, tables, EVENT_AS_OF, "2024-01-30")
    ok = F.when(F.col("files_processed") > 0, 1).otherwise(0).cast("bigint")
    return report.select("date", ok.alias("files_ok"), "records_processed", "success_rate", "quality_score")


@query("S04_newest_file", "SELECT 'new' AS version, date, count(*) AS rows FROM conversions GROUP BY 2")
def newest_file(t: Tables) -> DataFrame:
    """Daily files written in two goes, every row twice in the first; the later write is the newest."""
    path = scratch(t.spark, "snapshots")
    rows = t.conversions.select("date")
    for part, d in (("old", rows.union(rows)), ("new", rows)):
        d.withColumn("version", F.lit(part)).write.option("header", True).csv(f"{path}/{part}")
    d = feeds.newest_write(t.spark, [f"{path}/old", f"{path}/new"])
    return d.groupBy("version", F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("rows"))
