"""Feature sets, demand and inventory statistics, gap filling: all products in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import split_row_number
from ..functions.scalar import count_if, flag, floor_div, ratio, since
from ..functions.stats import acceleration, trend, with_position

# Channels, encoded categories, and the defaults for products without rows.
CHANNELS = ["online", "pos", "marketplace", "wholesale"]
ENCODED_CATEGORIES = ["personal_care", "food_beverage", "household", "electronics"]
VELOCITY_DEFAULTS = {"peak_to_trough_ratio": 1.0}
INVENTORY_DEFAULTS = {"stockout_risk": 1.0}
SENTIMENT_DEFAULTS = {"medium_demand_ratio": 1.0}


def _for_all(products: DataFrame, feats: DataFrame, defaults: dict[str, float]) -> DataFrame:
    d = products.select("product_id").join(feats, "product_id", "left")
    return d.select("product_id", *_filled(feats, defaults))


def _filled(feats: DataFrame, defaults: dict[str, float], prefix: str = "") -> list[Column]:
    """The group's measures as doubles, the default where a product has no rows."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(defaults.get(c, 0.0))).alias(f"{prefix}{c}") for c in feats.columns if c != "product_id"]


def velocity_features(sales: DataFrame, products: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _for_all(products, velocity_measures(sales, as_of, days), VELOCITY_DEFAULTS)


def velocity_measures(sales: DataFrame, as_of: str, days: int) -> DataFrame:
    daily = (
        sales.filter(since("date", as_of, days))
        .groupBy("product_id", "date")
        .agg(F.sum("quantity_sold").cast("double").alias("q"), F.sum("revenue").alias("r"))
    )
    mean, std, top, low = F.avg("q"), F.stddev_pop("q"), F.max("q"), F.min("q")
    return with_position(daily, ["product_id"], ["date"]).groupBy("product_id").agg(
        mean.alias("avg_daily_quantity"),
        std.alias("std_daily_quantity"),
        top.alias("max_daily_quantity"),
        low.alias("min_daily_quantity"),
        F.avg("r").alias("avg_daily_revenue"),
        trend("q").alias("quantity_trend"),
        trend("r").alias("revenue_trend"),
        (std / F.greatest(mean, F.lit(1.0))).alias("demand_volatility"),
        (F.avg("r") / F.greatest(mean, F.lit(1.0))).alias("revenue_per_unit"),
        count_if(F.col("q") > 0).alias("days_with_sales"),
        F.avg((F.col("q") > 0).cast("double")).alias("sales_frequency"),
        acceleration("q").alias("quantity_acceleration"),
        (top / F.greatest(low, F.lit(1.0))).alias("peak_to_trough_ratio"),
    )


def channel_features(sales: DataFrame, products: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _for_all(products, channel_measures(sales, as_of, days), {})


def channel_measures(sales: DataFrame, as_of: str, days: int) -> DataFrame:
    per = (
        sales.filter(since("date", as_of, days))
        .groupBy("product_id", "channel")
        .agg(F.sum("quantity_sold").alias("q"), F.sum("revenue").alias("r"), F.count(F.lit(1)).alias("n"))
    )
    total = F.greatest(F.sum("q").cast("double"), F.lit(1.0))
    return per.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("channel_count"),
        (F.count(F.lit(1)) / F.lit(4.0)).alias("channel_diversity"),
        (F.max("q") / total).alias("dominant_channel_share"),
        *[(F.sum(F.when(F.col("channel") == c, F.col("q")).otherwise(0)) / total).alias(f"{c}_share") for c in CHANNELS],
        ratio(F.sum("r"), F.sum("n")).alias("channel_revenue_efficiency"),
    )


def newest(df: DataFrame, n: int, order: list[str], key: str = "product_id") -> DataFrame:
    """The n newest rows per key, `rank` 1 = newest. The rank filter lets each task keep only its own
    n candidates per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest(df: DataFrame, cols: list[str], order: list[str], key: str = "product_id") -> DataFrame:
    """Newest row per key by one foldable aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select(key, "x.*")


def slope_newest_first(y: str, min_points: int = 3) -> Column:
    """Trend oldest to newest over rows ranked newest first."""
    n = F.count(y)
    return F.when(n >= min_points, F.regr_slope(F.col(y).cast("double"), -F.col("rank").cast("double"))).otherwise(0.0)


def inventory_features(stock: DataFrame, products: DataFrame, rows: int = 10) -> DataFrame:
    return _for_all(products, inventory_measures(stock, rows), INVENTORY_DEFAULTS)


def inventory_measures(stock: DataFrame, rows: int = 10) -> DataFrame:
    d = newest(stock, rows, ["ts", "event_id"]).withColumn("free", F.col("stock_level") - F.col("reserved_stock"))
    now = F.max_by(F.struct("stock_level", "reserved_stock", "in_transit"), -F.col("rank"))
    s = F.col("stock_level")
    mean = F.greatest(F.avg(s), F.lit(1.0))
    g = d.groupBy("product_id").agg(
        now.alias("now"),
        slope_newest_first("stock_level").alias("stock_trend"),
        (F.stddev_pop(s) / mean).alias("stock_volatility"),
        F.avg(s).alias("avg_stock_level"),
        F.min(s).alias("min_stock_level"),
        F.max(s).alias("max_stock_level"),
        ((F.max(s) - F.min(s)) / mean).alias("stock_range_ratio"),
        (F.avg("free") / mean).alias("availability_ratio"),
    )
    return g.select(
        "product_id",
        F.col("now.stock_level").alias("current_stock_level"),
        (F.col("now.stock_level") - F.col("now.reserved_stock")).alias("current_available_stock"),
        floor_div("now.reserved_stock", "now.stock_level").alias("current_reserved_ratio"),
        F.col("now.in_transit").alias("current_in_transit"),
        *[c for c in g.columns if c not in ("product_id", "now")],
        flag(F.col("now.stock_level") <= F.col("now.reserved_stock")).alias("stockout_risk"),
    )


def sentiment_features(signals: DataFrame, products: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _for_all(products, sentiment_measures(signals, as_of, days), SENTIMENT_DEFAULTS)


def sentiment_measures(signals: DataFrame, as_of: str, days: int) -> DataFrame:
    s = signals.filter(since("date", as_of, days))
    n = F.count(F.lit(1))

    def share(c: Column) -> Column:
        return count_if(c) / n

    g = s.groupBy("product_id").agg(
        F.avg("market_trend").alias("avg_market_trend"),
        F.stddev_pop("market_trend").alias("market_trend_volatility"),
        F.avg("social_sentiment").alias("avg_social_sentiment"),
        F.stddev_pop("social_sentiment").alias("sentiment_volatility"),
        *[share(F.col("external_demand") == x).alias(f"{x}_demand_ratio") for x in ("high", "medium", "low")],
        F.avg("competitor_price").alias("avg_competitor_price"),
        (F.countDistinct("weather_factor") / n).alias("weather_diversity"),
        share(F.coalesce(F.col("event_impact") != "none", F.lit(True))).alias("event_impact_frequency"),
    )
    # slopes run over all signal rows of a product, so positions are numbered in time slices
    measures = {"market_trend": "market_trend_direction", "competitor_price": "competitor_price_trend"}
    long = s.select("product_id", "ts", "event_id", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures])))
    pos = split_row_number(long.filter(F.col("v").isNotNull()), ["product_id", "measure"], "ts", "event_id", "position").withColumn("idx", F.col("position") - 1)
    slopes = pos.groupBy("product_id", "measure").agg(trend("v").alias("slope"))
    wide = slopes.groupBy("product_id").agg(*[F.max(F.when(F.col("measure") == m, F.col("slope"))).alias(out) for m, out in measures.items()])
    return g.join(wide, "product_id", "left")


def calendar_features(d: Column) -> dict[str, Column]:
    """Calendar parts, start and end flags, and sine and cosine encodings of a date."""
    wd, doy, dom, mon = F.weekday(d), F.dayofyear(d), F.dayofmonth(d), F.month(d)

    def f(c: Column) -> Column:
        return c.cast("double")

    def wave(x: Column, span: int) -> Column:
        return F.lit(2 * 3.141592653589793) * x / span

    return {
        "day_of_week": f(wd), "day_of_month": f(dom), "day_of_year": f(doy), "week_of_year": f(F.weekofyear(d)), "month": f(mon), "quarter": f(F.quarter(d)),
        "is_weekend": f(wd >= 5), "is_month_start": f(dom <= 7), "is_month_end": f(dom >= 24),
        "is_quarter_start": f(mon.isin(1, 4, 7, 10) & (dom <= 7)), "is_quarter_end": f(mon.isin(3, 6, 9, 12) & (dom >= 24)),
        "day_of_week_sin": F.sin(wave(wd, 7)), "day_of_week_cos": F.cos(wave(wd, 7)), "day_of_year_sin": F.sin(wave(doy, 365)), "day_of_year_cos": F.cos(wave(doy, 365)),
        "month_sin": F.sin(wave(mon, 12)), "month_cos": F.cos(wave(mon, 12)),
    }


def one_hot(c: str, values: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]


def feature_set(products: DataFrame, sales: DataFrame, stock: DataFrame, signals: DataFrame, as_of: str, days: int = 30, categories: list[str] | None = None) -> DataFrame:
    """All feature groups side by side with the derived ratios, one row per product."""

    d = products.select(
        "product_id", F.col("unit_cost").alias("product_unit_cost"), F.col("selling_price").alias("product_selling_price"),
        ratio(F.col("selling_price") - F.col("unit_cost"), "selling_price").alias("product_profit_margin"), *one_hot("category", categories or ENCODED_CATEGORIES, "category"),
    )
    for feats, prefix, defaults in (
        (velocity_measures(sales, as_of, days), "velocity_", VELOCITY_DEFAULTS),
        (channel_measures(sales, as_of, days), "channel_", {}),
        (inventory_measures(stock), "inventory_", INVENTORY_DEFAULTS),
        (sentiment_measures(signals, as_of, days), "sentiment_", SENTIMENT_DEFAULTS),
    ):
        have = d.columns
        d = d.join(feats, "product_id", "left").select(*have, *_filled(feats, defaults, prefix))
    price, demand = F.col("product_selling_price"), "velocity_avg_daily_quantity"
    return d.withColumns(
        {
            **{f"temporal_{k}": v for k, v in calendar_features(F.lit(as_of).cast("date")).items()},
            "inventory_turnover_rate": floor_div(demand, "inventory_current_stock_level"),
            "days_of_supply": floor_div("inventory_current_stock_level", demand),
            "supply_demand_ratio": floor_div("inventory_current_available_stock", demand),
            "price_competitiveness": F.when(F.col("sentiment_avg_competitor_price") > 0, ratio("sentiment_avg_competitor_price", price)),
            "channel_efficiency_ratio": floor_div("channel_channel_revenue_efficiency", price),
        }
    )


def demand_statistics(demand: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Mean, spread, fill rate, trend and weekday seasonality of actual daily demand per product."""
    d = demand.filter(~F.col("is_forecast") & since("date", as_of, days))
    q, got = F.col("quantity_demanded"), F.col("quantity_fulfilled")
    mean = F.greatest(F.avg(q), F.lit(1.0))
    s = with_position(d, ["product_id"], ["date"]).groupBy("product_id").agg(
        F.avg(q).alias("mean_demand"),
        F.stddev_pop(q).alias("std_demand"),
        F.max(q).alias("max_demand"),
        F.min(q).alias("min_demand"),
        F.median(q).alias("median_demand"),
        (F.stddev_pop(q) / mean).alias("cv_demand"),
        F.avg(got).alias("mean_fulfilled"),
        (F.avg(got) / mean).alias("fill_rate"),
        F.sum(q).alias("total_demand"),
        F.sum(got).alias("total_fulfilled"),
        trend("quantity_demanded").alias("demand_trend"),
        F.count(F.lit(1)).alias("rows"),
    )
    by_day = d.groupBy("product_id", F.weekday("date").alias("wd")).agg(F.avg(q).alias("m"))
    season = by_day.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("weekdays"), (F.stddev_pop("m") / F.greatest(F.avg("m"), F.lit(1.0))).alias("spread")
    )
    usable = (F.col("rows") >= 14) & (F.col("weekdays") > 1)
    return s.join(season, "product_id").withColumn("seasonality_factor", F.when(usable, F.col("spread")).otherwise(1.0)).drop("rows", "weekdays", "spread")


def inventory_metrics(stock: DataFrame, demand: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    s, free = F.col("stock_level"), F.col("available_stock")
    g = (
        stock.filter(since("date", as_of, days))
        .groupBy("product_id")
        .agg(
            F.avg(s).alias("avg_stock_level"),
            F.max(s).alias("max_stock_level"),
            F.min(s).alias("min_stock_level"),
            F.stddev_pop(s).alias("stock_volatility"),
            F.avg(free).alias("avg_available_stock"),
            F.avg((free <= 0).cast("double")).alias("stockout_frequency"),
        )
    )
    d = demand_statistics(demand, as_of, days).select("product_id", F.col("mean_demand").alias("m"), F.col("total_demand").alias("total"))
    return (
        g.join(d, "product_id", "left")
        .withColumns(
            {
                "inventory_turnover": floor_div(F.coalesce("total", F.lit(0)), "avg_stock_level"),
                "days_of_supply": floor_div("avg_stock_level", F.coalesce("m", F.lit(1.0))),
            }
        )
        .drop("m", "total")
    )


def feature_matrix(products: DataFrame, demand: DataFrame, stock: DataFrame, as_of: str) -> DataFrame:
    """Optimisation features of every product, numeric gaps as 0."""
    p = products.select(
        "product_id", "category", "unit_cost", "selling_price", "lead_time_days", "shelf_life_days", "min_order_quantity", "max_order_quantity"
    )
    d = p.join(demand_statistics(demand, as_of), "product_id", "left").join(inventory_metrics(stock, demand, as_of), "product_id", "left")
    both = F.col("mean_demand").isNotNull() & F.col("avg_stock_level").isNotNull()
    d = d.withColumns(
        {
            "profit_margin": F.when(both, ratio(F.col("selling_price") - F.col("unit_cost"), "selling_price")),
            "demand_variability": F.when(both, F.col("cv_demand")),
            "service_level": F.when(both, F.col("fill_rate")),
            "inventory_efficiency": F.when(both, F.col("inventory_turnover")),
        }
    )
    return d.na.fill(0)


def state_vector(products: DataFrame, stock: DataFrame, demand: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Stock, demand, coverage and risk per product with stock, also as a 10-number vector."""
    now = latest(stock, ["stock_level", "reserved_stock", "in_transit"], ["ts", "event_id"])
    recent = (
        demand.filter(~F.col("is_forecast") & since("date", as_of, days))
        .groupBy("product_id")
        .agg(F.avg("quantity_demanded").alias("m"), F.stddev_pop("quantity_demanded").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    d = now.join(recent, "product_id", "left").join(products.select("product_id", "lead_time_days"), "product_id", "left")
    demand_mean = F.coalesce("m", F.lit(0.0))
    free = F.col("stock_level") - F.col("reserved_stock")
    lead = F.coalesce("lead_time_days", F.lit(7))
    base = F.greatest(demand_mean, F.lit(1.0))
    d = d.select(
        "product_id",
        F.col("stock_level").alias("current_stock"),
        "reserved_stock",
        "in_transit",
        free.alias("available_stock"),
        demand_mean.alias("avg_demand"),
        F.coalesce("s", F.lit(0.0)).alias("demand_volatility"),
        (free / base).alias("stock_coverage"),
        F.greatest(F.lit(0.0), (demand_mean * lead - free) / base).alias("stockout_risk"),
        lead.alias("lead_time"),
        F.least(F.coalesce("n", F.lit(0)), F.lit(7)).cast("bigint").alias("recent_days"),
    )
    return d.withColumn("state", F.array(*[F.col(c).cast("double") for c in d.columns if c != "product_id"]))


def calendar(products: DataFrame, start: str, end: str) -> DataFrame:
    """Every product on every day of a range."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return products.select("product_id", F.explode(days).alias("date"))


def fill_missing_sales(sales: DataFrame, start: str, end: str, rows: int = 10) -> DataFrame:
    """Days without sales, estimated from the newest `rows` earlier sales on the same weekday.

    Each day keeps at most `rows` of its own sales; windows then run over those small arrays at
    product-by-day grain.
    """
    w = Window.partitionBy("product_id", "date").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    kept = sales.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rows)
    item = F.struct(F.col("ts").alias("t"), F.col("event_id").alias("e"), F.col("quantity_sold").alias("q"), F.col("revenue").alias("r"))
    days = kept.groupBy("product_id", "date").agg(F.collect_list(item).alias("day"))
    key = Window.partitionBy("product_id", F.weekday("date")).orderBy("date")
    merged = F.flatten(F.collect_list("day").over(key.rowsBetween(-(rows - 1), 0)))
    days = days.select("product_id", "date", F.slice(F.sort_array(merged, asc=False), 1, rows).alias("hist"))
    cal = calendar(sales.select("product_id").distinct(), start, end).join(days, ["product_id", "date"], "left")
    before = F.last("hist", ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1))
    gaps = cal.select("product_id", "date", "hist", before.alias("past")).filter(F.col("hist").isNull() & F.col("past").isNotNull())
    n = F.size("past")

    def mean(f: str) -> Column:
        return F.aggregate("past", F.lit(0.0), lambda a, x: a + x[f]) / n

    return gaps.select(
        "product_id", "date", F.floor(mean("q")).cast("bigint").alias("quantity_sold"), mean("r").alias("revenue"), F.lit("estimated").alias("channel"), F.lit(True).alias("is_fallback")
    )


def last_known_stock(stock: DataFrame, start: str, end: str) -> DataFrame:
    """Stock per product and day as of that day: the day's last update, else the last known one."""
    cols = ["stock_level", "reserved_stock", "in_transit", "location"]
    daily = stock.groupBy("product_id", "date").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("x"))
    cal = calendar(stock.select("product_id").distinct(), start, end).join(daily, ["product_id", "date"], "left")
    known = F.last("x", ignorenulls=True).over(Window.partitionBy("product_id").orderBy("date"))
    d = cal.select("product_id", "date", F.col("x").isNull().alias("is_fallback"), known.alias("k"))
    return d.filter(F.col("k").isNotNull()).select("product_id", "date", "k.*", "is_fallback")


def period_comparison(demand: DataFrame, as_of: str, periods: tuple[int, ...] = (7, 14, 30, 90)) -> DataFrame:
    """Trailing windows side by side: each row is counted in every period it falls in."""
    d = demand.filter(~F.col("is_forecast"))
    p = F.explode(F.array(*[F.lit(x) for x in periods])).alias("period")
    d = d.select("date", "quantity_demanded", "quantity_fulfilled", p).filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), F.col("period")))
    return d.groupBy(F.col("period").cast("bigint").alias("period")).agg(
        F.sum("quantity_demanded").alias("total_demand"),
        F.sum("quantity_fulfilled").alias("total_fulfilled"),
        ratio(F.sum("quantity_fulfilled"), F.sum("quantity_demanded")).alias("service_level"),
    )
