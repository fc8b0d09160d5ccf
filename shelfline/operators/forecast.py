"""Demand forecasts, reorder rules, planned campaigns and layered business rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, since, whole
from .features import newest, slope_newest_first

# Service quantile, cost rates, weekday factors, forecast confidence.
Z_95 = 1.6448536269514722
HOLDING_RATE, ORDER_COST, STOCKOUT_PENALTY = 0.25, 50.0, 10.0
WEEKEND_FACTOR, WEEKDAY_FACTOR = 1.2, 0.9
FORECAST_CONFIDENCE = 0.8
HORIZON, PLAN_STEPS = 7, 3


def actual(demand: DataFrame) -> DataFrame:
    return demand.filter(~F.col("is_forecast"))


def recent_mean(demand: DataFrame, n: int) -> DataFrame:
    """Mean of the n newest daily demands per product."""
    return newest(actual(demand), n, ["date"]).groupBy("product_id").agg(F.avg("quantity_demanded").alias("avg_demand"))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.col("min_order_quantity")), F.col("max_order_quantity"))


def reorder_point_rule(products: DataFrame, stock: DataFrame, demand: DataFrame) -> DataFrame:
    """Order 30 days of supply when stock is at or below 1.5 lead times of demand."""
    d = products.join(stock, "product_id").join(recent_mean(demand, 30), "product_id", "left")
    avg = F.coalesce("avg_demand", F.lit(10.0))
    point, qty = whole(avg * F.col("lead_time_days") * 1.5), whole(avg * 30)
    return d.select(
        "product_id", "stock_level", point.alias("reorder_point"), F.when(F.col("stock_level") <= point, clamp(qty)).otherwise(0).alias("order_quantity")
    )


def economic_order_rule(products: DataFrame, stock: DataFrame, demand: DataFrame) -> DataFrame:
    """Economic order quantity, ordered at 1.2 lead times of demand."""
    d = products.join(stock, "product_id").join(recent_mean(demand, 90), "product_id", "left")
    avg = F.coalesce("avg_demand", F.lit(10.0))
    holding = F.col("unit_cost") * HOLDING_RATE
    eoq = F.when(holding > 0, whole(clamp(F.sqrt(2 * avg * 365 * ORDER_COST / holding)))).otherwise(F.col("min_order_quantity"))
    point = whole(avg * F.col("lead_time_days") * 1.2)
    return d.select(
        "product_id", "stock_level", point.alias("reorder_point"), eoq.alias("economic_quantity"), F.when(F.col("stock_level") <= point, eoq).otherwise(0).alias("order_quantity")
    )


def _base_forecast(n: Column, mean: Column) -> Column:
    """Short histories fall back to their mean, at least 1; no history counts as 10 a day."""
    return F.when(n == 0, 10.0).when(n < 3, F.greatest(F.lit(1.0), mean)).otherwise(mean)


def moving_average_forecast(demand: DataFrame, as_of: str, horizon: int = HORIZON) -> DataFrame:
    """7-day mean plus the change against the week before, damped on weekdays and lifted on weekends."""
    d = newest(actual(demand).filter(since("date", as_of, 14)), 14, ["date"])
    week, prior = F.col("rank") <= 7, F.col("rank") > 7
    q = F.col("quantity_demanded")
    g = d.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(week, q)).alias("last_week"),
        F.avg(F.when(prior, q)).alias("week_before"),
        F.avg(q).alias("m"),
    )
    slope = F.when(F.col("n") > 7, F.col("last_week") - F.col("week_before")).otherwise(0.0)
    f = g.select("product_id", "n", "m", "last_week", slope.alias("slope"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("i"))
    day = F.date_add(F.lit(as_of).cast("date"), F.col("i"))
    factor = F.when(F.weekday(day) >= 5, WEEKEND_FACTOR).otherwise(WEEKDAY_FACTOR)
    value = F.when(F.col("n") < 3, _base_forecast(F.col("n"), F.col("m"))).otherwise(
        F.greatest(F.lit(0.0), F.col("last_week") + F.col("slope") * F.col("i") * factor)
    )
    return f.select("product_id", day.alias("date"), value.alias("forecast"))


def statistical_reorder(state: DataFrame, products: DataFrame, demand: DataFrame) -> DataFrame:
    """Safety stock at the service quantile, reorder point, a 3-step order plan and its 7-day outlook.

    The plan and the outlook are folds over a short index array, all inside one projection.
    """
    last7 = (
        newest(actual(demand), 7, ["date"])
        .groupBy("product_id")
        .agg(F.avg("quantity_demanded").alias("m"), F.stddev_pop("quantity_demanded").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    p = products.select("product_id", "lead_time_days", "unit_cost", "min_order_quantity", "max_order_quantity")
    d = state.select("product_id", "available_stock").join(last7, "product_id", "left").join(p, "product_id")
    avg = F.coalesce("m", F.lit(1.0))
    n = F.coalesce("n", F.lit(0))
    spread = F.when(n > 1, F.col("s")).otherwise(avg * 0.3)
    d = d.withColumns({"avg": avg, "f": _base_forecast(n, F.coalesce("m", F.lit(10.0))), "safety_stock": Z_95 * spread * F.sqrt(F.col("lead_time_days").cast("double"))})
    d = d.withColumn("reorder_point", F.col("avg") * F.col("lead_time_days") + F.col("safety_stock"))

    def step(acc: Column, _: Column) -> Column:
        projected = acc["stock"] - F.col("f")
        want = F.greatest(F.lit(0.0), F.col("reorder_point") + F.col("avg") * 7 - projected)
        order = F.when(
            projected <= F.col("reorder_point"),
            F.when(want > 0, F.least(F.greatest(F.col("min_order_quantity").cast("double"), want), F.col("max_order_quantity").cast("double"))).otherwise(0.0),
        ).otherwise(0.0)
        return F.struct(F.greatest(F.lit(0.0), acc["stock"] + order - F.col("f")).alias("stock"), F.concat(acc["orders"], F.array(order)).alias("orders"))

    start = F.struct(F.col("available_stock").cast("double").alias("stock"), F.array().cast("array<double>").alias("orders"))
    d = d.withColumn("orders", F.aggregate(F.sequence(F.lit(1), F.lit(PLAN_STEPS)), start, step, lambda acc: acc["orders"]))

    def outlook(acc: Column, t: Column) -> Column:
        arrives = F.when((t < PLAN_STEPS) & (t >= F.col("lead_time_days")), F.coalesce(F.get(F.col("orders"), t), F.lit(0.0))).otherwise(0.0)
        level = acc["stock"] + arrives - F.col("f")
        kept = F.greatest(level, F.lit(0.0))
        return F.struct(
            kept.alias("stock"),
            (acc["held"] + kept).alias("held"),
            (acc["short"] + F.greatest(-level, F.lit(0.0))).alias("short"),
        )

    zero = F.struct(F.col("available_stock").cast("double").alias("stock"), F.lit(0.0).alias("held"), F.lit(0.0).alias("short"))
    d = d.withColumn("o", F.aggregate(F.sequence(F.lit(0), F.lit(HORIZON - 1)), zero, outlook))
    placed = F.size(F.filter("orders", lambda x: x > 0))
    cost = F.col("o.held") * F.col("unit_cost") * HOLDING_RATE / 365 + F.col("o.short") * STOCKOUT_PENALTY + placed * ORDER_COST
    return d.select(
        "product_id", "safety_stock", "reorder_point", *[F.get("orders", i).alias(f"order_{i + 1}") for i in range(PLAN_STEPS)],
        F.col("o.short").alias("predicted_stockouts"), cost.alias("total_cost"),
        (1 - F.col("o.short") / F.greatest(F.col("f") * HORIZON, F.lit(1.0))).alias("service_level"),
    )


def trend_forecast(demand: DataFrame, days: int = 30, history: int = 30) -> DataFrame:
    """Linear-trend forecast rows after the last known day, whole units, never negative."""
    d = newest(actual(demand), history, ["date"])
    g = d.groupBy("product_id").agg(
        F.avg("quantity_demanded").alias("m"), slope_newest_first("quantity_demanded", 2).alias("slope"), F.max("date").alias("last_date")
    )
    f = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("i"))
    # rounding first: a fitted value of 19.9999999 is 20 units, not 19
    units = F.round(F.greatest(F.lit(0.0), F.col("m") + F.col("slope") * F.col("i")), 6)
    return f.select(
        "product_id", F.date_add("last_date", F.col("i")).alias("date"), whole(units).alias("quantity_demanded"), F.lit(0).cast("bigint").alias("quantity_fulfilled"),
        F.lit(True).alias("is_forecast"), F.lit(FORECAST_CONFIDENCE).alias("confidence_interval"),
    )


def campaign_forecast(forecast: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Forecast lifted on campaign days. A campaign becomes one row per day it runs, folded per
    product and day, so the join is a plain equi-join."""
    span = F.sequence("start_date", F.date_add("start_date", (F.col("duration_days") - 1).cast("int")))
    daily = campaigns.select("product_id", F.explode(span).alias("date"), "lift").groupBy("product_id", "date").agg(F.sum("lift").alias("lift"))
    d = forecast.join(daily, ["product_id", "date"], "left")
    lift = F.coalesce("lift", F.lit(0.0))
    return d.select("product_id", "date", "quantity_demanded", lift.alias("campaign_lift"), (F.col("quantity_demanded") * (1 + lift)).alias("marketing_demand"))


def campaign_reorder_point(points: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Reorder point plus the units expected from upcoming campaigns."""
    extra = campaigns.groupBy("product_id").agg(F.sum("expected_units").alias("expected_units"))
    d = points.join(extra, "product_id", "left").withColumn("expected_units", F.coalesce("expected_units", F.lit(0.0)))
    return d.withColumn("adjusted_reorder_point", F.col("reorder_point") + F.col("expected_units"))


RULES = ("lead_time_days", "service_target", "season_factor", "max_stock_days", "min_order_quantity", "order_multiple")


def resolve_rules(products: DataFrame, by_product: DataFrame, by_category: DataFrame, defaults: dict[str, float], as_of: str) -> DataFrame:
    """Each rule from the product's own override, else its category, else the global value.

    Overrides count only inside their active period. Joins are plain: the optimizer broadcasts a
    rule table when it is small.
    """
    today = F.lit(as_of).cast("date")
    own = by_product.filter((F.coalesce("active_from", today) <= today) & (F.coalesce("active_to", today) >= today))
    own = own.select("product_id", *[F.col(r).alias(f"p_{r}") for r in RULES])
    cat = by_category.select("category", *[F.col(r).alias(f"c_{r}") for r in RULES])
    d = products.join(own, "product_id", "left").join(cat, "category", "left")
    return d.select(
        "product_id", "category", "suggested_quantity",
        *[F.coalesce(F.col(f"p_{r}").cast("double"), F.col(f"c_{r}").cast("double"), F.lit(float(defaults[r]))).alias(r) for r in RULES],
    ).withColumn("order_quantity", F.ceil(F.greatest("suggested_quantity", "min_order_quantity") / F.col("order_multiple")) * F.col("order_multiple"))


def forecast_accuracy(demand: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Forecast rows next to the actual of the same product and day, with max(0, 1 - relative error)."""
    f = demand.filter(F.col("is_forecast") & since("date", as_of, days) & (F.col("date") <= F.lit(as_of).cast("date")))
    a = actual(demand).select("product_id", "date", F.col("quantity_demanded").alias("actual"))
    d = f.select("product_id", "date", F.col("quantity_demanded").alias("forecast")).join(a, ["product_id", "date"])
    error = ratio(F.abs(F.col("forecast") - F.col("actual")), "actual")
    return d.withColumn("accuracy", F.when(F.col("actual") > 0, F.greatest(F.lit(0.0), 1 - error)))
