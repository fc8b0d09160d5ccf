"""Service, cost, efficiency and quality KPIs, comparisons, alerts and business translations.

Every KPI is computed for a list of named date windows at once: each fact row is counted in the
windows it falls in, then everything folds per window.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import above, cases, count_if, ratio, since
from .features import latest
from .forecast import actual

# Cost rates, KPI targets, status and alert limits, business constants.
HOLDING_RATE = 0.25
TARGETS = {
    "overall_service_level": ("service", 0.95), "stockout_frequency": ("service", 0.05), "avg_category_service": ("service", 0.95), "total_cost": ("cost", None),
    "avg_order_cost": ("cost", 500.0), "cost_per_unit": ("cost", 2.0), "daily_holding_cost": ("cost", None), "inventory_turnover": ("efficiency", 12.0),
    "order_frequency": ("efficiency", 0.5), "optimization_efficiency": ("efficiency", 25.0), "forecast_accuracy": ("efficiency", 0.85),
    "data_completeness": ("quality", 0.95), "optimization_success_rate": ("quality", 0.98), "system_uptime": ("quality", 0.99),
}
SERVICE = ("overall_service_level", "stockout_frequency", "avg_category_service")
COST = ("total_cost", "avg_order_cost", "cost_per_unit", "daily_holding_cost")
EFFICIENCY = ("inventory_turnover", "order_frequency", "optimization_efficiency", "forecast_accuracy")
QUALITY = ("data_completeness", "optimization_success_rate", "system_uptime")
STATUS = [(1.0, "on_target"), (0.9, "near_target")]
CRITICAL, WARNING = 0.7, 0.9
AVG_PRICE, BASE_SERVICE, SAVINGS_RATE, INDUSTRY_TURNOVER = 12.50, 0.85, 0.20, 6.0
METRICS_PER_DAY = 24

Span = tuple[str, date, date, int]


def trailing(as_of: str, *days: int) -> list[Span]:
    """Windows of the last n days, open to the reference date and beyond."""
    end = date.fromisoformat(as_of)
    return [(f"{n}_days", end - timedelta(days=n), end + timedelta(days=1), n) for n in days]


def adjacent(as_of: str, baseline: int, comparison: int) -> list[Span]:
    """A comparison window up to the reference date and the baseline right before it."""
    end = date.fromisoformat(as_of)
    mid = end - timedelta(days=comparison)
    return [("baseline", mid - timedelta(days=baseline), mid, baseline), ("comparison", mid, end + timedelta(days=1), comparison)]


def _spans(spans: list[Span]) -> Column:
    return F.array(
        *[F.struct(F.lit(n).alias("window"), F.lit(str(a)).cast("date").alias("a"), F.lit(str(b)).cast("date").alias("b"), F.lit(d).alias("days")) for n, a, b, d in spans]
    )


def in_spans(df: DataFrame, spans: list[Span], cols: list[str]) -> DataFrame:
    hit = F.filter(_spans(spans), lambda s: (F.col("date") >= s["a"]) & (F.col("date") < s["b"]))
    return df.select(*cols, "date", F.explode(hit).alias("w")).select("w.window", "w.days", "date", *cols)


def day_partials(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Demand folded to a row per day, category and range of product numbers, with the exact set of products seen as a
    bitmap. Windows that overlap are then merged from these few rows, and all KPIs of demand come from one pass."""
    named = facts.join(products.select("product_id", "category"), "product_id", "left")
    return named.groupBy("date", "category", F.bitmap_bucket_number("product_id").alias("bucket")).agg(
        F.sum("quantity_demanded").alias("demanded"), F.sum("quantity_fulfilled").alias("fulfilled"),
        F.max(F.col("quantity_fulfilled") < F.col("quantity_demanded")).alias("short"), F.bitmap_construct_agg(F.bitmap_bit_position("product_id")).alias("seen"),
    )


def kpi_values(
    demand: DataFrame, actions: DataFrame, stock: DataFrame, products: DataFrame, runs: DataFrame, metrics: DataFrame, as_of: str, spans: list[Span], names: tuple[str, ...]
) -> DataFrame:
    """Tidy (window, metric, value) rows for the requested KPIs."""
    spark = demand.sparkSession
    base = spark.range(1).select(F.inline(_spans(spans))).select("window", "days")
    facts = actual(demand)
    folded = in_spans(day_partials(facts, products), spans, ["category", "bucket", "demanded", "fulfilled", "short", "seen"])
    total = folded.groupBy("window").agg(F.sum("demanded").alias("demanded"), F.sum("fulfilled").alias("fulfilled"), F.countDistinct(F.when(F.col("short"), F.col("date"))).alias("short_days"))
    seen = folded.groupBy("window", "bucket").agg(F.bitmap_or_agg("seen").alias("seen")).groupBy("window").agg(F.sum(F.bitmap_count("seen")).alias("products_seen"))
    out = base.join(total, "window", "left").join(seen, "window", "left")
    if "avg_category_service" in names:
        categories = products.agg(F.greatest(F.countDistinct("category"), F.lit(1))).scalar()
        per = folded.filter("category is not null").groupBy("window", "category").agg(ratio(F.sum("fulfilled"), F.sum("demanded"), 0.0).alias("s"))
        out = out.join(per.groupBy("window").agg((F.sum("s") / categories).alias("category_service")), "window", "left")
    if set(names) & {*COST, "order_frequency"}:
        a = in_spans(actions, spans, ["action_type", "cost"]).groupBy("window").agg(F.sum("cost").alias("cost"), count_if(F.col("action_type") == "order").alias("placed"))
        out = out.join(a, "window", "left")
    if "daily_holding_cost" in names:
        value = (
            stock.filter(since("date", as_of, 1))
            .join(products.select("product_id", "unit_cost"), "product_id")
            .agg(F.coalesce(F.sum(F.col("stock_level") * F.col("unit_cost")), F.lit(0.0)))
            .scalar()
        )
        out = out.withColumn("stock_value", value)
    if "inventory_turnover" in names:
        out = out.join(in_spans(stock, spans, ["stock_level"]).groupBy("window").agg(F.avg("stock_level").alias("avg_stock")), "window", "left")
    if set(names) & {"optimization_efficiency", "optimization_success_rate"}:
        r = in_spans(runs, spans, ["convergence_iterations", "constraints_satisfied"]).groupBy("window").agg(
            F.avg("convergence_iterations").alias("iterations"), F.count(F.lit(1)).alias("runs"), count_if(F.col("constraints_satisfied")).alias("good_runs")
        )
        out = out.join(r, "window", "left")
    if "forecast_accuracy" in names:
        f = demand.filter(F.col("is_forecast") & (F.col("date") <= F.lit(as_of).cast("date"))).select("product_id", "date", F.col("quantity_demanded").alias("f"))
        pair = f.join(facts.select("product_id", "date", F.col("quantity_demanded").alias("q")), ["product_id", "date"]).filter(F.col("q") > 0)
        acc = pair.select("date", F.greatest(F.lit(0.0), 1 - ratio(F.abs(F.col("f") - F.col("q")), "q")).alias("acc"))
        out = out.join(in_spans(acc, spans, ["acc"]).groupBy("window").agg(F.avg("acc").alias("accuracy")), "window", "left")
    if "data_completeness" in names:
        out = out.withColumn("all_products", products.agg(F.count(F.lit(1))).scalar())
    if "system_uptime" in names:
        out = out.join(in_spans(metrics, spans, ["metric_value"]).groupBy("window").agg(F.count(F.lit(1)).alias("activity")), "window", "left")

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    days = F.col("days")
    formulas = {
        "overall_service_level": lambda: ratio("fulfilled", "demanded", 0.0),
        "stockout_frequency": lambda: zero("short_days") / F.greatest(days, F.lit(1)),
        "avg_category_service": lambda: F.coalesce("category_service", F.lit(0.0)),
        "total_cost": lambda: F.coalesce("cost", F.lit(0.0)),
        "avg_order_cost": lambda: F.coalesce("cost", F.lit(0.0)) / F.greatest(zero("placed"), F.lit(1)),
        "cost_per_unit": lambda: F.coalesce("cost", F.lit(0.0)) / F.greatest(zero("fulfilled"), F.lit(1)),
        "daily_holding_cost": lambda: F.col("stock_value") * HOLDING_RATE / 365,
        "inventory_turnover": lambda: zero("fulfilled") / F.greatest(F.coalesce("avg_stock", F.lit(1.0)), F.lit(1.0)) * (365 / days),
        "order_frequency": lambda: zero("placed") / F.greatest(days, F.lit(1)),
        "optimization_efficiency": lambda: F.coalesce("iterations", F.lit(0.0)),
        "forecast_accuracy": lambda: F.coalesce("accuracy", F.lit(0.0)),
        "data_completeness": lambda: zero("products_seen") / F.greatest(F.col("all_products"), F.lit(1)),
        "optimization_success_rate": lambda: zero("good_runs") / F.greatest(zero("runs"), F.lit(1)),
        "system_uptime": lambda: F.least(F.lit(1.0), zero("activity") / (days * METRICS_PER_DAY)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), formulas[n]().cast("double").alias("value")) for n in names])
    return out.select("window", "days", F.inline(rows))


def _target(i: int, kind: str) -> Column:
    return cases([(F.col("metric") == m, F.lit(v[i]).cast(kind)) for m, v in TARGETS.items()])


def dashboard(values: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """KPI rows with category, target, ratio and status.

    As published, a higher value is better for every KPI; name the ones where lower is better to
    turn their ratio around.
    """
    d = values.withColumns({"category": _target(0, "string"), "target": _target(1, "double")})
    plain = ratio("value", "target")
    turned = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    d = d.withColumn("performance_ratio", F.when(turned, ratio("target", "value")).otherwise(plain))
    status = cases([(F.col("performance_ratio") >= b, label) for b, label in STATUS], "below_target")
    return d.withColumn("status", F.when(F.col("target").isNull(), "no_target").otherwise(status))


def dashboard_summary(board: DataFrame) -> DataFrame:
    return board.groupBy("window").agg(
        F.count(F.lit(1)).alias("total_metrics"),
        count_if(F.col("status") == "on_target").alias("on_target"),
        count_if(F.col("status") == "below_target").alias("needs_improvement"),
        F.avg(F.least(F.lit(1.0), F.col("performance_ratio"))).alias("performance_score"),
    )


def trends(values: DataFrame) -> DataFrame:
    g = values.groupBy("metric").agg(F.regr_slope("value", F.col("days").cast("double")).alias("slope"))
    s = F.col("slope")
    return g.withColumn("direction", cases([(s > 0, "improving"), (s < 0, "declining")], "stable"))


def comparison(values: DataFrame) -> DataFrame:
    g = values.groupBy("metric").agg(*[F.max(F.when(F.col("window") == w, F.col("value"))).alias(f"{w}_value") for w in ("baseline", "comparison")])
    change = F.col("comparison_value") - F.col("baseline_value")
    pct = F.when(F.col("baseline_value") != 0, ratio(change, "baseline_value") * 100).otherwise(0.0)
    return g.withColumns({"absolute_change": change, "percent_change": pct}).withColumns(
        {"improvement": F.col("percent_change") > 0, "significant": F.abs("percent_change") > 5}
    )


def alerts(board: DataFrame, runs: DataFrame, demand: DataFrame, as_of: str) -> DataFrame:
    """KPI rows below their limits, failed runs of the last day, demand older than two days."""
    r = F.col("performance_ratio")
    level = cases([(r < CRITICAL, "CRITICAL"), (r < WARNING, "WARNING")])
    low = board.filter(F.col("target").isNotNull()).select(level.alias("level"), "metric", "value").filter(F.col("level").isNotNull())
    failed = runs.filter(since("date", as_of, 1) & ~F.col("constraints_satisfied")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    age = actual(demand).agg(F.datediff(F.lit(as_of).cast("date"), F.max("date")).cast("double").alias("value"))
    parts = [
        low,
        failed.filter("value > 0").select(F.lit("WARNING").alias("level"), F.lit("optimization_failures").alias("metric"), "value"),
        age.filter("value > 2").select(F.lit("WARNING").alias("level"), F.lit("data_staleness").alias("metric"), "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def daily_metrics(demand: DataFrame, actions: DataFrame) -> DataFrame:
    d = actual(demand).groupBy("date").agg(F.sum("quantity_demanded").alias("total_demand"), F.sum("quantity_fulfilled").alias("total_fulfilled"), F.count(F.lit(1)).alias("demand_records"))
    a = actions.groupBy("date").agg(F.count(F.lit(1)).alias("total_actions"), F.sum("quantity").alias("total_quantity_ordered"), F.sum("cost").alias("total_cost"))
    j = d.join(a, "date", "full")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_demand", "total_fulfilled", "demand_records", "total_actions", "total_quantity_ordered", "total_cost")}
    return j.withColumns(zero).withColumn("service_level", ratio("total_fulfilled", "total_demand", 0.0))


def weekly_metrics(daily: DataFrame) -> DataFrame:
    """Seven-day roll-up; days without rows count with service level 0."""
    g = daily.groupBy(F.trunc("date", "week").alias("week_start")).agg(
        *[F.sum(c).alias(c) for c in ("total_demand", "total_fulfilled", "total_actions", "total_cost")], (F.sum("service_level") / 7).alias("avg_service_level")
    )
    return g.withColumn("week_end", F.date_add("week_start", 7))


def product_performance(products: DataFrame, demand: DataFrame, actions: DataFrame, stock: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    d = (
        actual(demand)
        .filter(since("date", as_of, days))
        .groupBy("product_id")
        .agg(F.sum("quantity_demanded").alias("total_demand"), F.sum("quantity_fulfilled").alias("total_fulfilled"), F.avg("quantity_demanded").alias("avg_demand"))
    )
    a = actions.filter(since("date", as_of, days)).groupBy("product_id").agg(F.count(F.lit(1)).alias("total_actions"), F.sum("quantity").alias("total_ordered"), F.sum("cost").alias("total_cost"))
    now = latest(stock, ["stock_level", "available_stock"], ["ts", "event_id"]).withColumnRenamed("stock_level", "current_stock")
    j = products.select("product_id", "category").join(d, "product_id", "left").join(a, "product_id", "left").join(now, "product_id", "left")
    numbers = ("total_demand", "total_fulfilled", "avg_demand", "total_actions", "total_ordered", "total_cost", "current_stock", "available_stock")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers}).withColumn("service_level", ratio("total_fulfilled", "total_demand", 0.0))


def report_summary(daily: DataFrame, perf: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One-row report: sums over the last n days, mean daily service level (empty days as 0)."""
    n = perf.agg(F.count(F.lit(1))).scalar()
    return daily.filter((F.col("date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("date") <= F.lit(as_of).cast("date"))).agg(
        F.sum("total_demand").alias("total_demand"),
        F.sum("total_fulfilled").alias("total_fulfilled"),
        (F.sum("service_level") / days).alias("overall_service_level"),
        F.sum("total_cost").alias("total_cost"),
    ).withColumn("products_analyzed", n)


def report_extremes(perf: DataFrame, k: int = 10) -> DataFrame:
    """The k best and k worst products by service level."""
    top = perf.orderBy(F.desc("service_level"), F.desc("total_demand"), "product_id").limit(k).select(F.lit("top_performer").alias("list"), "product_id", "service_level")
    low = perf.orderBy("service_level", F.desc("total_demand"), "product_id").limit(k).select(F.lit("improvement").alias("list"), "product_id", "service_level")
    return top.unionByName(low)


def system_performance(metrics: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Mean and deviation per metric category as columns, with the composite score."""
    m = metrics.filter(since("date", as_of, days))
    v = F.col("metric_value")
    names = ("service", "cost", "efficiency")
    g = m.agg(*[f(F.when(F.col("metric_category") == c, v)).alias(f"{p}_{c}") for c in names for p, f in (("avg", F.avg), ("std", F.stddev_pop))])
    return g.withColumn("composite_score", F.col("avg_service") - F.col("avg_cost") / 10000)


def parameter_suggestions(perf: DataFrame, max_iterations: int = 50, horizon: int = 7) -> DataFrame:
    """Changed settings where efficiency or service leave their range."""

    def row(cond: Column, name: str, old: int, new: int, why: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("parameter"), F.lit(old).alias("old_value"), F.lit(new).alias("new_value"), F.lit(why).alias("reason")))

    s = F.col("avg_service")
    rows = F.array(
        row(F.col("avg_efficiency") < 0.7, "max_iterations", max_iterations, int(min(100, max_iterations * 1.2)), "low_efficiency"),
        row(s < 0.9, "prediction_horizon", horizon, min(14, horizon + 1), "low_service_level"),
        row(s > 0.98, "prediction_horizon", horizon, max(3, horizon - 1), "high_service_level_potential_overstock"),
    )
    return perf.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def parameter_consistency(parameters: DataFrame, actions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Products whose mean action of the week is more than half off the planned order quantity."""
    recent = actions.filter(since("date", as_of, days)).groupBy("product_id").agg(F.avg("quantity").alias("avg_tactical_quantity"))
    d = parameters.select("product_id", F.col("order_quantity").alias("strategic_quantity")).join(recent, "product_id")
    off = ratio(F.abs(F.col("avg_tactical_quantity") - F.col("strategic_quantity")), "strategic_quantity")
    return d.withColumns({"issue_type": F.lit("quantity_deviation"), "deviation_percent": off * 100}).filter(off > 0.5)


def financial_impact(one_row: DataFrame) -> DataFrame:
    """Service level, demand, cost and turnover turned into money."""
    cost = F.col("total_cost")
    d = one_row.withColumns(
        {
            "weekly_savings": cost * SAVINGS_RATE / 52,
            "revenue_protected": F.greatest(F.lit(0.0), (F.col("service_level") - BASE_SERVICE) * F.col("total_demand") * 0.1 * AVG_PRICE),
            "cash_freed": F.greatest(F.lit(0.0), cost * (1 - INDUSTRY_TURNOVER / F.col("inventory_turnover")) * 0.3),
        }
    )
    roi = ratio((F.col("revenue_protected") + F.col("weekly_savings")) * 52, cost * 0.05) * 100
    return d.withColumn("roi_percentage", F.when(cost > 0, F.least(F.lit(500.0), F.greatest(F.lit(100.0), roi))).otherwise(200.0))


def stock_alerts(products: DataFrame, k: int = 5) -> DataFrame:
    """Products at or below their reorder point: days left, revenue at risk, the most pressing first.

    `products` carries stock, reorder point, daily demand and price.
    """
    left = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("current_stock") / F.greatest(F.col("daily_demand"), F.lit(1.0))).cast("bigint"))
    d = products.filter(F.col("current_stock") <= F.col("reorder_point")).withColumn("days_left", left)
    d = d.withColumns({"revenue_risk": F.col("daily_demand") * F.col("days_left") * F.col("selling_price"), "order_units": F.col("reorder_point") * 2})
    d = d.withColumn("alert_type", F.when(F.col("days_left") <= 2, "urgent").otherwise("opportunity"))
    return d.orderBy("days_left", F.desc("revenue_risk"), "product_id").limit(k).select("product_id", "alert_type", "days_left", "order_units", "revenue_risk")


def urgent_actions(products: DataFrame, k: int = 3) -> DataFrame:
    left = F.col("current_stock") / F.greatest(F.col("daily_demand"), F.lit(1.0))
    d = products.withColumn("days_left", left).filter(F.col("days_left") <= 5)
    urgent = F.col("days_left") <= 2
    weeks = F.when(urgent, 7).otherwise(3)
    d = d.select(
        "product_id", "days_left", F.when(urgent, "Reorder today").otherwise("Schedule reorder").alias("action"), F.when(urgent, "URGENT").otherwise("TODAY").alias("priority"),
        (F.col("daily_demand") * weeks * F.col("selling_price")).alias("impact"),
    )
    return d.orderBy("days_left", F.desc("impact"), "product_id").limit(k)


def category_advice(perf: DataFrame, as_of: str, days: int = 15) -> DataFrame:
    """Advice per category from its margin and its growth against the period before."""
    recent = since("date", as_of, days)
    g = (
        perf.filter(since("date", as_of, 2 * days))
        .groupBy("product_category")
        .agg(F.avg("profit_margin").alias("margin"), F.sum(F.when(recent, F.col("revenue"))).alias("now"), F.sum(F.when(~recent, F.col("revenue"))).alias("before"))
    )
    m, gr = F.col("margin"), F.col("growth")
    g = g.withColumn("growth", ratio(F.col("now") - F.col("before"), "before"))
    advice = cases(
        [
            ((m > 0.35) & (gr > 0.15), "Expand premium lines"),
            ((m > 0.30) & (gr > 0.05), "Optimize shelf space"),
            ((m < 0.20) & (gr < 0), "Review pricing strategy"),
            (gr > 0.20, "Capture growth opportunity"),
        ],
        "Monitor performance",
    )
    return g.select("product_category", "margin", "growth", advice.alias("recommendation"))


def trending_products(demand: DataFrame, as_of: str, days: int = 15, k: int = 5) -> DataFrame:
    """Products whose demand rose above +30% or fell below -20% against the period before, strongest first."""
    recent = since("date", as_of, days)
    q = F.col("quantity_demanded")
    g = (
        actual(demand)
        .filter(since("date", as_of, 2 * days))
        .groupBy("product_id")
        .agg(F.sum(F.when(recent, q)).alias("now"), F.sum(F.when(~recent, q)).alias("before"))
    )
    c = F.col("change")
    d = g.withColumn("change", ratio(F.col("now") - F.col("before"), "before")).filter((c > 0.3) | (c < -0.2))
    up = above(c, [(0.5, "Increase stock")], "Monitor closely")
    down = F.when(c < -0.4, "Clear inventory").otherwise("Reduce orders")
    impact = F.when(c > 0, F.col("now") * c * 10).otherwise(F.abs(F.col("now") * c * 15))
    return d.select("product_id", "change", F.when(c > 0, up).otherwise(down).alias("action"), impact.alias("impact")).orderBy(F.abs("change").desc(), "product_id").limit(k)
