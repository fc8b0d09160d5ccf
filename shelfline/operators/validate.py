"""Validation rules, quarantine splits, repairs, gates and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cases, count_if, days_before, money, ratio, since
from ..sources.feeds import FEEDS, declared

# Allowed channel and demand names, alert limits.
SALES_CHANNELS = ["online", "pos", "marketplace", "wholesale"]
DEMAND_LEVELS = ["high", "medium", "low"]
SNAPSHOT_REQUIRED = ["date", "product_id", "product_name", "units_sold", "revenue"]
SNAPSHOT_NUMBERS = ["units_sold", "revenue", "total_attributed_revenue"]
SNAPSHOT_CRITICAL = ["product_id", "product_name", "units_sold"]

Rule = tuple[str, str, Column]


def schema_issues(columns: list[str], feed: str) -> list[tuple[str, str, str]]:
    """Missing required columns as errors, unexpected ones as warnings; metadata only, no job."""
    if feed not in FEEDS:
        return [("unknown_type", "error", feed)]
    required, known = FEEDS[feed]["required"], declared(feed)
    missing = [("missing_column", "error", c) for c in required if c not in columns]
    return missing + [("unexpected_column", "warning", c) for c in columns if c not in known]


def schema_report(df: DataFrame, feed: str) -> DataFrame:
    """Schema issues with the number of rows they touch."""
    issues = schema_issues(df.columns, feed)
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("issue", "level", "column"), i)]) for i in issues])
    if not issues:
        rows = F.array().cast("array<struct<issue:string,level:string,column:string>>")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(rows), "rows")


def type_losses(raw: DataFrame, feed: str) -> DataFrame:
    """Values per declared column that are present as text but lost by the cast; one pass."""
    cols = [(c, t) for c, t in declared(feed).items() if c in raw.columns]
    lost = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("expected"), count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias("lost")) for c, t in cols
    ]
    d = raw.agg(F.array(*lost).alias("x")).select(F.inline("x"))
    return d.withColumn("level", F.when((F.col("lost") > 0) & F.col("expected").startswith("timestamp"), "error").when(F.col("lost") > 0, "warning").otherwise("ok"))


def business_rules(feed: str) -> list[Rule]:
    if feed == "sales":
        return [
            ("negative_quantity", "error", F.col("quantity_sold") < 0),
            ("negative_revenue", "warning", F.col("revenue") < 0),
            ("invalid_channel", "warning", ~F.coalesce(F.col("channel").isin(SALES_CHANNELS), F.lit(False))),
        ]
    if feed == "inventory":
        return [
            ("negative_stock", "error", F.col("stock_level") < 0),
            ("reserved_over_stock", "error", F.col("reserved_stock") > F.col("stock_level")),
        ]
    return [
        ("invalid_demand_level", "warning", ~F.coalesce(F.col("external_demand").isin(DEMAND_LEVELS), F.lit(False))),
        ("trend_out_of_range", "warning", ~F.col("market_trend").between(-1.0, 1.0)),
    ]


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows failing each rule, from one scan."""
    counted = [F.struct(F.lit(n).alias("rule"), F.lit(level).alias("level"), count_if(c).alias("rows")) for n, level, c in rules]
    return df.agg(F.array(*counted).alias("x")).select(F.inline("x"))


def split(df: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every error rule, and the others with the names of the rules they break."""
    rules = business_rules(feed)
    keys = [(f"missing_{c}", F.col(c).isNull()) for c in FEEDS[feed]["required"] if c in df.columns]
    broken = [F.when(c, F.lit(n)) for n, c in keys] + [F.when(c, F.lit(n)) for n, level, c in rules if level == "error"]
    if "malformed" in df.columns:
        broken.append(F.when(F.col("malformed"), F.lit("malformed_row")))
    d = df.withColumn("issues", F.filter(F.array(*broken), lambda x: x.isNotNull()))
    return d.filter(F.size("issues") == 0).drop("issues"), d.filter(F.size("issues") > 0)


def snapshot_issues(snap: DataFrame) -> DataFrame:
    """Issues of a product snapshot: absent columns, negatives, nulls in key fields, empty set, sold without revenue."""
    missing = [c for c in [*SNAPSHOT_REQUIRED, "total_attributed_revenue"] if c not in snap.columns]
    have = snap.columns
    checks = [(f"negative_{c}", count_if(F.col(c) < 0)) for c in SNAPSHOT_NUMBERS if c in have]
    checks += [(f"null_{c}", count_if(F.col(c).isNull())) for c in SNAPSHOT_CRITICAL if c in have]
    checks += [("bad_date", count_if(F.col("date").isNull()))] if "date" in have else []
    if {"units_sold", "revenue"} <= set(have):
        checks.append(("sold_without_revenue", count_if((F.col("revenue") == 0) & (F.col("units_sold") > 0))))
    checks.append(("empty_dataset", (F.count(F.lit(1)) == 0).cast("bigint")))
    rows = F.array(*[F.struct(F.lit(n).alias("issue"), c.cast("bigint").alias("rows")) for n, c in checks])
    d = snap.agg(rows.alias("x")).select(F.inline("x"))
    if missing:
        spark = snap.sparkSession
        gone = spark.range(1).select(F.explode(F.array(*[F.lit(f"missing_column_{c}") for c in missing])).alias("issue"), F.lit(1).cast("bigint").alias("rows"))
        d = d.unionByName(gone)
    return d


def _issue_rows(df: DataFrame, category: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("issue_type"), F.lit(i).alias("issue"))) for t, i, c in rules]), lambda x: x.isNotNull())
    return df.select(F.lit(category).alias("category"), "product_id", F.inline(found))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def product_issues(products: DataFrame) -> DataFrame:
    return _issue_rows(
        products,
        "product",
        [
            ("missing_data", "Missing name or category", _blank("name") | _blank("category")),
            ("invalid_values", "Invalid unit cost", F.col("unit_cost") <= 0),
            ("invalid_values", "Selling price not greater than cost", F.col("selling_price") <= F.col("unit_cost")),
            ("invalid_values", "Negative lead time", F.col("lead_time_days") < 0),
            ("inconsistencies", "Min order > Max order", F.col("min_order_quantity") > F.col("max_order_quantity")),
        ],
    )


def orphans(child: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """Child rows whose product is unknown (anti join)."""
    return child.join(products.select(key), key, "left_anti")


def inventory_issues(stock: DataFrame, products: DataFrame) -> DataFrame:
    """Issues of each product's latest stock row."""
    cols = ["stock_level", "reserved_stock", "available_stock"]
    latest = stock.groupBy("product_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("x")).select("product_id", "x.*")
    gap = F.abs(F.col("available_stock") - (F.col("stock_level") - F.col("reserved_stock"))) > 0.1
    rows = _issue_rows(
        latest, "inventory", [("negative_stock", "Negative stock level", F.col("stock_level") < 0), ("inconsistent_calculations", "Available stock calculation mismatch", gap)]
    )
    lost = orphans(latest, products)
    return rows.unionByName(_issue_rows(lost, "inventory", [("missing_products", "Product not found", F.lit(True))]))


def demand_issues(demand: DataFrame, products: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    d = demand.filter(since("date", as_of, days))
    rows = _issue_rows(
        d,
        "demand",
        [
            ("negative_demand", "Negative demand", F.col("quantity_demanded") < 0),
            ("fulfillment_issues", "Fulfilled > Demanded", F.col("quantity_fulfilled") > F.col("quantity_demanded")),
            ("date_issues", "Future date for historical demand", (F.col("date") > F.lit(as_of).cast("date")) & ~F.col("is_forecast")),
        ],
    )
    return rows.unionByName(_issue_rows(orphans(d, products), "demand", [("missing_products", "Product not found", F.lit(True))]))


def issue_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "issue_type").agg(F.count(F.lit(1)).alias("issues"))


def full_validation(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("total_issues"), (F.count(F.lit(1)) == 0).alias("validation_passed"))


def repair_available(stock: DataFrame) -> DataFrame:
    """Available stock recomputed from stock and reserved, with a mark on changed rows."""
    right = F.col("stock_level") - F.col("reserved_stock")
    return stock.withColumns({"changed": ~F.col("available_stock").eqNullSafe(right), "available_stock": right})


def sellable_lines(items: DataFrame) -> DataFrame:
    return items.filter((F.col("quantity") > 0) & (F.col("price") >= 0) & F.col("order_id").isNotNull() & F.col("product_id").isNotNull() & (F.length("title") > 0))


def negative_columns(df: DataFrame) -> DataFrame:
    """Rows with a negative value per numeric column, from one scan."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), count_if(F.col(c) < 0).alias("negative_rows")) for c in numeric])
    return df.agg(rows.alias("x")).select(F.inline("x")).filter(F.col("negative_rows") > 0)


def pre_export(tables: dict[str, tuple[DataFrame, str, Column, Column]], as_of: str, days: int = 7) -> DataFrame:
    """Missing keys, invalid values and latest date per table: PASS, FAIL above 5%, STALE after two days."""
    parts = []
    for name, (df, date, no_key, invalid) in tables.items():
        g = df.filter(since(date, as_of, days)).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("total_records"),
            count_if(no_key).alias("missing_primary_key"),
            count_if(invalid).alias("invalid_values"),
            F.max(date).alias("latest_record_date"),
        )
        parts.append(g)
    d = reduce(DataFrame.unionByName, parts)
    bad = (F.col("missing_primary_key") > 0) | (F.col("invalid_values") > F.col("total_records") * 0.05)
    return d.withColumn("validation_status", cases([(bad, "FAIL"), (F.col("latest_record_date") < days_before(as_of, 2), "STALE")], "PASS"))


def post_export(exports: dict[str, tuple[DataFrame, str, str, str]], as_of: str) -> DataFrame:
    """Rows, revenue, distinct entities and date range of each export, with a status."""
    parts = [
        df.agg(
            F.lit(name).alias("export_name"), F.count(F.lit(1)).alias("record_count"), F.sum(rev).alias("total_revenue"), F.countDistinct(ident).alias("unique_entities"),
            F.min(date).alias("earliest_date"), F.max(date).alias("latest_date"),
        )
        for name, (df, rev, ident, date) in exports.items()
    ]
    d = reduce(DataFrame.unionByName, parts)
    return d.withColumn(
        "export_status",
        cases([(F.col("record_count") == 0, "NO_DATA"), (F.col("total_revenue") <= 0, "ZERO_REVENUE"), (F.col("latest_date") < days_before(as_of, 1), "STALE_DATA")], "VALID"),
    )


def profile_checks(customers: DataFrame, as_of: str) -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_if(_blank("email")).alias("missing_email"),
        count_if(F.col("total_spent") < 0).alias("negative_spent"),
        count_if(F.col("total_orders") < 0).alias("negative_orders"),
        count_if(F.col("last_order_date") > F.lit(as_of).cast("date")).alias("future_order_dates"),
        count_if(F.col("first_order_date") > F.col("last_order_date")).alias("invalid_date_sequence"),
        F.avg("email_engagement_score").alias("avg_engagement_score"),
        count_if(F.col("email_engagement_score") > 1.0).alias("invalid_engagement_scores"),
    )


def attribution_daily_checks(attr: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    n = F.count(F.lit(1))

    def pct(c: Column) -> Column:
        return money(ratio(count_if(c), n) * 100)

    return (
        attr.filter(since("date", as_of, days))
        .groupBy("date")
        .agg(
            n.alias("total_attributions"),
            pct(F.col("customer_email").isNull()).alias("missing_email_percentage"),
            pct(F.col("total_attributed_revenue") <= 0).alias("zero_revenue_percentage"),
            count_if(F.col("attribution_weight") > 1.0).alias("invalid_attribution_weights"),
            count_if(F.col("first_touch_ts") > F.col("last_touch_ts")).alias("invalid_timestamp_sequence"),
            count_if(F.col("touchpoint_count") == 0).alias("zero_touchpoint_journeys"),
            F.avg("journey_duration_hours").alias("avg_journey_hours"),
            count_if(F.col("journey_duration_hours") > 24 * 30).alias("long_journey_outliers"),
        )
    )


def performance_daily_checks(perf: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """`perf` carries the performance rates."""
    return (
        perf.filter(since("date", as_of, days))
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            count_if(F.col("total_product_revenue") < 0).alias("negative_revenue_products"),
            count_if(F.col("total_units_sold") < 0).alias("negative_units_products"),
            count_if(F.col("marketing_roas") > 50).alias("unrealistic_roas_products"),
            count_if(F.col("inventory_level") < 0).alias("negative_inventory_products"),
            count_if(F.col("total_marketing_spend") > F.col("total_attributed_revenue") * 10).alias("high_spend_low_return"),
            money(F.avg("total_product_revenue")).alias("avg_product_revenue"),
            money(F.avg("marketing_roas")).alias("avg_marketing_roas"),
            money(F.stddev_samp("total_product_revenue")).alias("revenue_volatility"),
        )
    )


def attribution_health(perf: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    g = (
        perf.filter(since("date", as_of, days))
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            count_if(F.col("revenue") < 0).alias("negative_revenue_products"),
            count_if(F.col("total_attributed_revenue") > F.col("revenue") * 1.5).alias("over_attributed_products"),
            count_if((F.col("ads_spend") > 0) & (F.col("ads_attributed_revenue") == 0)).alias("spend_no_attribution"),
            F.avg(ratio("total_attributed_revenue", "revenue")).alias("rate"),
            ratio(F.sum("organic_revenue"), F.sum("revenue")).alias("organic"),
        )
    )
    n = F.col("total_products")
    status = cases(
        [
            (F.col("negative_revenue_products") > 0, "CRITICAL: Negative revenue detected"),
            (F.col("over_attributed_products") > n * 0.1, "WARNING: High over-attribution"),
            (F.col("spend_no_attribution") > n * 0.2, "WARNING: High spend without attribution"),
            (F.col("rate") > 1.2, "WARNING: Attribution rate > 120%"),
        ],
        "HEALTHY",
    )
    return g.select(
        "date", "total_products", "negative_revenue_products", "over_attributed_products", "spend_no_attribution", money(F.col("rate") * 100).alias("avg_attribution_percentage"),
        money(F.col("organic") * 100).alias("organic_revenue_percentage"), status.alias("quality_status"),
    )


def health_dashboard(perf: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    g = (
        perf.filter(since("date", as_of, days))
        .groupBy("date")
        .agg(
            F.countDistinct("product_id").alias("active_products"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("total_attributed_revenue").alias("total_attributed_revenue"),
            F.sum("total_marketing_spend").alias("total_marketing_spend"),
            F.sum("organic_revenue").alias("total_organic_revenue"),
            F.avg(ratio("ads_attributed_revenue", "ads_spend")).alias("roas"),
            count_if(F.col("units_sold") > 0).alias("products_with_sales"),
        )
    )
    share = ratio("total_attributed_revenue", "total_revenue")
    status = cases([(F.col("total_revenue") == 0, "NO_SALES"), (share > 1.3, "OVER_ATTRIBUTION"), (F.col("roas") < 1.0, "LOW_ROAS")], "HEALTHY")
    return g.select(
        *[c for c in g.columns if c != "roas"], money("roas").alias("avg_ads_roas"), money(share * 100).alias("attribution_coverage_percentage"),
        money(ratio("total_organic_revenue", "total_revenue") * 100).alias("organic_percentage"), status.alias("daily_health_status"),
    )


def journey_quality(attr: DataFrame) -> DataFrame:
    g = attr.agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_if(F.col("customer_email").isNull()).alias("missing_email_count"),
        count_if(F.col("total_attributed_revenue") <= 0).alias("zero_revenue_count"),
        count_if(F.col("touchpoint_count") == 0).alias("no_touchpoint_count"),
        F.avg("journey_duration_hours").alias("avg_journey_duration"),
        count_if(F.col("journey_duration_hours") > 24 * 30).alias("long_journey_outliers"),
    )
    n = F.col("total_orders")
    return g.withColumn(
        "data_quality_status",
        cases(
            [(F.col("missing_email_count") > n * 0.1, "HIGH_MISSING_EMAIL"), (F.col("zero_revenue_count") > 0, "ZERO_REVENUE_DETECTED"), (F.col("no_touchpoint_count") > n * 0.05, "HIGH_NO_TOUCHPOINT")],
            "QUALITY_PASS",
        ),
    )


def run_health(attr: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    g = attr.filter(since("date", as_of, days)).agg(
        F.lit(as_of).cast("date").alias("check_date"),
        F.count(F.lit(1)).alias("total_orders_processed"),
        count_if(F.col("touchpoint_count") == 0).alias("missing_touchpoints"),
        F.avg("touchpoint_count").alias("avg_touchpoints_per_order"),
        F.countDistinct("customer_email").alias("unique_customers"),
        F.sum("total_attributed_revenue").alias("total_revenue_attributed"),
    )
    n = F.col("total_orders_processed")
    return g.withColumn(
        "pipeline_status",
        cases(
            [
                (n == 0, "CRITICAL: No orders processed"),
                (F.col("missing_touchpoints") > n * 0.1, "WARNING: High missing touchpoints"),
                (F.col("avg_touchpoints_per_order") < 1.5, "WARNING: Low attribution coverage"),
            ],
            "HEALTHY",
        ),
    )


def attribution_flags(attr: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Daily attribution quality; low volume is below half the average day (a one-row subquery)."""
    n = F.count(F.lit(1))
    g = (
        attr.filter(since("date", as_of, days))
        .groupBy("date")
        .agg(
            n.alias("daily_orders"),
            F.avg("total_attributed_revenue").alias("avg_order_value"),
            F.avg("touchpoint_count").alias("avg_touchpoints"),
            money(ratio(count_if(F.col("ads_attributed_revenue") > 0), n) * 100).alias("ads_attribution_rate"),
            money(ratio(count_if(F.col("email_attributed_revenue") > 0), n) * 100).alias("email_attribution_rate"),
            F.stddev_samp("total_attributed_revenue").alias("revenue_volatility"),
        )
    )
    low = g.agg(F.avg("daily_orders") * 0.5).scalar()
    return g.withColumn("quality_flag", cases([(F.col("daily_orders") < low, "LOW_VOLUME"), (F.col("revenue_volatility") > F.col("avg_order_value"), "HIGH_VOLATILITY")], "NORMAL"))


def gate(attr: DataFrame, built: DataFrame, day: str) -> DataFrame:
    """Publish decision for one day: abort without attribution, roll back on bad rows, else publish."""
    on = F.col("date") == F.lit(day).cast("date")
    sources = attr.filter(on).agg(F.count(F.lit(1))).scalar()
    bad = (F.col("revenue") < 0) | (F.col("total_attributed_revenue") > F.col("revenue") * 2)
    g = built.filter(on).agg(count_if(bad).alias("bad_rows"), F.count(F.lit(1)).alias("rows")).withColumn("source_rows", sources)
    return g.withColumn("decision", cases([(F.col("source_rows") == 0, "abort"), (F.col("bad_rows") > 0, "rollback")], "publish"))


def gate_days(attr: DataFrame, built: DataFrame) -> DataFrame:
    """The same decision for every day of a build: abort without attribution, hold with bad rows, else publish."""
    bad = (F.col("revenue") < 0) | (F.col("total_attributed_revenue") > F.col("revenue") * 2)
    sources = attr.groupBy("date").agg(F.count(F.lit(1)).alias("source_rows"))
    g = built.groupBy("date").agg(count_if(bad).alias("bad_rows"), F.count(F.lit(1)).alias("rows")).join(sources, "date", "left").fillna(0, ["source_rows"])
    return g.withColumn("decision", cases([(F.col("source_rows") == 0, "abort"), (F.col("bad_rows") > 0, "hold")], "publish"))


def spend_alerts(ads: DataFrame) -> DataFrame:
    """Days whose spend is above 150% of the 7-day mean or whose ROAS is below half the 30-day mean."""
    daily = ads.groupBy("date").agg(
        F.sum("spend").alias("spend"), ratio(F.sum("purchase_value"), F.sum("spend")).alias("roas"), F.avg(F.col("campaign_id").isNull().cast("double")).alias("missing_share")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = daily.withColumns({"avg_spend_7d": F.avg("spend").over(w.rowsBetween(-7, -1)), "avg_roas_30d": F.avg("roas").over(w.rowsBetween(-30, -1))})
    hits = F.array(
        F.when(F.col("spend") > F.col("avg_spend_7d") * 1.5, F.lit("spend_anomaly")),
        F.when(F.col("roas") < F.col("avg_roas_30d") * 0.5, F.lit("performance_drop")),
        F.when(F.col("missing_share") > 0.05, F.lit("data_completeness")),
    )
    return d.select("date", "spend", "roas", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("alert"))


def attribution_alerts(attr: DataFrame) -> DataFrame:
    """Weekly gaps, revenue variance, journey changes, and channel drops against the week before."""
    week = F.trunc("date", "week").alias("week")
    w = Window.partitionBy(F.lit(0)).orderBy("week")
    g = attr.groupBy(week).agg(
        F.avg((F.col("touchpoint_count") == 0).cast("double")).alias("gap"),
        ratio(F.sum("ads_attributed_revenue") + F.sum("email_attributed_revenue"), F.sum("total_attributed_revenue")).alias("credited"),
        F.avg("journey_duration_hours").alias("hours"),
    )
    g = g.withColumn("hours_before", F.lag("hours").over(w))
    change = F.abs(ratio(F.col("hours") - F.col("hours_before"), "hours_before"))
    rows = F.array(
        F.when(F.col("gap") > 0.10, F.struct(F.lit("attribution_gap").alias("alert"), F.lit("all").alias("subject"), F.col("gap").alias("value"))),
        F.when(1 - F.col("credited") > 0.15, F.struct(F.lit("revenue_variance").alias("alert"), F.lit("all").alias("subject"), (1 - F.col("credited")).alias("value"))),
        F.when(change > 0.5, F.struct(F.lit("journey_change").alias("alert"), F.lit("all").alias("subject"), change.alias("value"))),
    )
    overall = g.select("week", F.inline(F.filter(rows, lambda x: x.isNotNull())))
    by = attr.filter(F.col("last_touch_channel").isNotNull()).groupBy(week, F.col("last_touch_channel").alias("subject")).agg(F.sum("total_attributed_revenue").alias("r"))
    prev = F.lag("r").over(Window.partitionBy("subject").orderBy("week"))
    drops = by.withColumn("value", ratio(prev - F.col("r"), prev)).filter(F.col("value") > 0.3)
    return overall.unionByName(drops.select("week", F.lit("channel_drop").alias("alert"), "subject", "value"))


def product_alerts(perf: DataFrame, products: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Day-on-day revenue changes above 200%, ROAS outliers, negative stock; days missing over 5% of active products.

    `products` are the products expected daily; missing ones are counted from distinct products on each day of the
    window's calendar, which ends the day before `as_of`, so a day without rows misses all of them.
    """
    p = perf.filter(since("date", as_of, days))
    prev = F.lag("revenue").over(Window.partitionBy("product_id").orderBy("date"))
    d = p.withColumn("change", F.abs(ratio(F.col("revenue") - prev, prev)))
    roas = ratio("total_attributed_revenue", "total_marketing_spend")
    hits = F.array(
        F.when(F.col("change") > 2.0, F.lit("revenue_anomaly")),
        F.when((roas > 20) | (roas < 0), F.lit("roas_outlier")),
        F.when(F.col("inventory_level") < 0, F.lit("negative_inventory")),
    )
    rows = d.select("date", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("alert")).groupBy("date", "alert").agg(F.count(F.lit(1)).cast("double").alias("value"))
    total = products.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    seen = p.join(products.select("product_id"), "product_id", "left_semi").groupBy("date").agg(F.countDistinct("product_id").alias("n"))
    until = F.lit(as_of).cast("date")
    calendar = products.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(until, days), F.date_sub(until, 1))).alias("date"))
    expected = calendar.union(seen.select("date")).distinct().join(seen, "date", "left")
    share = 1 - F.coalesce("n", F.lit(0)) / total
    gap = expected.select("date", F.lit("missing_products").alias("alert"), share.alias("value")).filter(F.col("value") > 0.05)
    return rows.unionByName(gap)


def customer_alerts(customers: DataFrame, attr: DataFrame, shop_revenue: DataFrame, as_of: str, updated: str) -> DataFrame:
    """Missing e-mail, engagement drop, over-attribution and stale profiles, one row per rule with its value."""
    credited = attr.agg(F.sum(F.col("ads_attributed_revenue") + F.col("email_attributed_revenue"))).scalar()
    sold = shop_revenue.agg(F.sum("revenue")).scalar()
    recent = since("last_email_open", as_of, 30)
    g = customers.agg(
        F.avg(_blank("email").cast("double")).alias("no_email"),
        ratio(F.avg(F.when(~recent, F.col("email_engagement_score"))) - F.avg(F.when(recent, F.col("email_engagement_score"))), F.avg(F.when(~recent, F.col("email_engagement_score")))).alias("drop"),
        (F.datediff(F.lit(as_of).cast("date"), F.max(updated)) * 24.0).alias("hours"),
    ).withColumn("over", ratio(credited, sold))
    rows = [("missing_email", "no_email", 0.01), ("engagement_drop", "drop", 0.20), ("over_attribution", "over", 1.5), ("stale_profiles", "hours", 24.0)]
    return g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("alert"), F.col(c).alias("value"), F.coalesce(F.col(c) > limit, F.lit(False)).alias("raised")) for n, c, limit in rows])))
