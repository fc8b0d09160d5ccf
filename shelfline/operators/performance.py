"""Product-by-day performance: builds, rates, classes, windows and portfolio summaries.

Every window here runs over one row per product and day, so a partition is bounded by days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import sliced_row_number
from ..functions.scalar import at_least, cases, count_if, days_before, dow, money, ratio, ratio_pos, since
from .marketing import AD_MEASURES, MAIL_MEASURES, ad_metrics, mail_metrics, per_product, performance_class

# Class steps, score weights, trend factors, recommendation limits.
VELOCITY_CLASSES = [(10, "high_velocity"), (5, "medium_velocity"), (1, "low_velocity")]
SCORE_WEIGHTS = {"revenue": 0.3, "units": 0.3, "roas": 0.2, "profit": 0.2}
TREND_UP, TREND_DOWN = 1.2, 0.8
EMAIL_COST = 0.01
DEMAND_LEVELS = ((100, "high"), (50, "medium"))


def with_rates(perf: DataFrame) -> DataFrame:
    """Marketing, sales, mix, inventory and profit measures of a product-day."""
    total = F.col("total_product_revenue")
    units = F.col("total_units_sold")
    return (
        perf.withColumns(
            {
                "marketing_roas": ratio_pos("total_attributed_revenue", "total_marketing_spend", None),
                "cost_per_acquisition": ratio_pos("total_marketing_spend", "total_attributed_units", None),
                "ads_roas": ratio_pos("ads_attributed_revenue", "ads_spend", None),
                "revenue_per_email": ratio_pos("email_attributed_revenue", "emails_sent"),
                "total_product_revenue": F.col("revenue") + F.col("total_attributed_revenue"),
                "total_units_sold": F.col("units_sold") + F.col("total_attributed_units"),
                "units_per_order": ratio_pos("units_sold", "orders"),
            }
        )
        .withColumns(
            {
                "organic_revenue_percentage": ratio_pos("revenue", total) * 100,
                "ads_revenue_percentage": ratio_pos("ads_attributed_revenue", total) * 100,
                "email_revenue_percentage": ratio_pos("email_attributed_revenue", total) * 100,
                "inventory_turnover_rate": ratio_pos(units, "inventory_level", None),
                "cost_per_unit_sold": F.when(units > 0, ratio("inventory_cost", units)).otherwise(F.col("inventory_cost")),
                "net_profit": total * F.col("profit_margin") - F.col("total_marketing_spend"),
            }
        )
        .withColumns(
            {
                "net_profit_margin": ratio_pos("net_profit", total),
                "daily_demand_velocity": units,
                "daily_order_frequency": F.col("orders"),
                "marketing_performance_category": performance_class("marketing_roas"),
                "sales_velocity_category": at_least(units, VELOCITY_CLASSES, "no_sales"),
            }
        )
    )


def channel_enrichment(perf: DataFrame) -> DataFrame:
    ads, mail = F.col("ads_attributed_revenue"), F.col("email_attributed_revenue")
    return perf.select(
        "date",
        "product_id",
        ratio(ads, "ads_spend").alias("ads_roas"),
        ratio(mail, F.col("emails_sent") * EMAIL_COST).alias("email_roi_per_send"),
        ratio("total_attributed_revenue", "total_marketing_spend").alias("overall_marketing_roas"),
        (ratio("organic_revenue", "revenue") * 100).alias("organic_revenue_percentage"),
        (F.col("units_sold") + F.col("total_attributed_units")).alias("total_demand_velocity"),
        cases([(ads > mail, "facebook_driven"), (mail > ads, "email_driven"), ((ads == mail) & (ads > 0), "balanced")], "organic_driven").alias("primary_channel"),
    )


def daily_sales_side(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date", "product_id").agg(
        F.sum("quantity_sold").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
        F.avg(ratio("revenue", "quantity_sold")).alias("avg_selling_price"),
    )


def daily_ads_side(ads: DataFrame) -> DataFrame:
    d = per_product(ad_metrics(ads), "attributed_products", *AD_MEASURES)
    return d.groupBy("date", "product_id").agg(
        F.sum("spend").alias("ads_spend"),
        F.sum("impressions").alias("ads_impressions"),
        F.sum("clicks").alias("ads_clicks"),
        F.sum("purchase_value").alias("ads_revenue"),
        F.avg("roas").alias("ads_avg_roas"),
    )


def daily_mail_side(mail: DataFrame) -> DataFrame:
    d = per_product(mail_metrics(mail), "featured_products", *MAIL_MEASURES)
    return d.groupBy("date", "product_id").agg(
        F.sum("recipients").alias("email_recipients"),
        F.sum("opens").alias("email_opens"),
        F.sum("clicks").alias("email_clicks"),
        F.sum("attributed_revenue").alias("email_revenue"),
    )


def _zero(*cols: str) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit(0)) for c in cols}


def unified_day(products: DataFrame, sales: DataFrame, ads: DataFrame, mail: DataFrame, day: str) -> DataFrame:
    """All products with one day of sales, ads and e-mail; each side is folded to product grain first."""
    on = F.col("date") == F.lit(day).cast("date")
    d = products.select("product_id", F.col("name").alias("product_name"), "category")
    for side in (daily_sales_side(sales.filter(on)), daily_ads_side(ads.filter(on)), daily_mail_side(mail.filter(on))):
        d = d.join(side.drop("date"), "product_id", "left")
    measures = [
        "units_sold", "revenue", "orders", "customers", "ads_spend", "ads_impressions", "ads_clicks", "ads_revenue", "ads_avg_roas",
        "email_recipients", "email_opens", "email_clicks", "email_revenue",
    ]
    d = d.drop("avg_selling_price").withColumns(_zero(*measures))
    total = F.col("revenue") + F.col("ads_revenue") + F.col("email_revenue")
    return d.withColumns(
        {
            "analysis_date": F.lit(day).cast("date"),
            "total_attributed_revenue": total,
            "total_marketing_spend": F.col("ads_spend"),
            "overall_roas": ratio(total, "ads_spend"),
            "demand_level": cases([(F.col("units_sold") > b, label) for b, label in DEMAND_LEVELS], "low"),
        }
    )


def summary_table(unified: DataFrame) -> DataFrame:
    return unified.select(
        F.col("analysis_date").alias("summary_date"), "product_id", "units_sold", "revenue", "ads_spend", "ads_revenue", "email_revenue",
        "total_attributed_revenue", "overall_roas", "demand_level",
    )


def full_outer_daily(sales: DataFrame, ads: DataFrame, mail: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The three daily feeds joined on both sides by date and product; missing measures are 0."""
    keep = since("date", as_of, days)
    keys = ["date", "product_id"]
    d = daily_sales_side(sales.filter(keep)).drop("customers")
    d = d.join(daily_ads_side(ads.filter(keep)).drop("ads_avg_roas"), keys, "full").join(daily_mail_side(mail.filter(keep)), keys, "full")
    d = d.withColumns(
        _zero("units_sold", "revenue", "orders", "ads_spend", "ads_impressions", "ads_clicks", "ads_revenue", "email_recipients", "email_opens", "email_clicks", "email_revenue")
    )
    return d.withColumns(
        {
            "total_revenue": F.col("revenue") + F.col("ads_revenue") + F.col("email_revenue"),
            "ads_roas": ratio_pos("ads_revenue", "ads_spend", None),
            "revenue_per_email_recipient": ratio_pos("email_revenue", "email_recipients", None),
        }
    )


def marketing_roi(perf: DataFrame) -> DataFrame:
    both = F.col("ads_attributed_revenue") + F.col("email_attributed_revenue")
    return perf.filter(F.col("ads_spend") > 0).select(
        "date", "product_id", "ads_spend", "ads_attributed_revenue", "email_attributed_revenue", ratio(both, "ads_spend").alias("marketing_roas")
    )


def rankings(perf: DataFrame, as_of: str, days: int = 30, top: int = 50) -> DataFrame:
    """Daily ranks by revenue, units, ROAS and profit, averaged per product; best by composite score.

    A day's products are ranked in value-range slices, so the day with the most products is not one task.
    """
    d = with_rates(perf.filter(since("date", as_of, days)))
    w = SCORE_WEIGHTS
    score = (
        F.col("total_product_revenue") * w["revenue"]
        + F.col("total_units_sold") * F.coalesce("avg_selling_price", F.lit(0.0)) * w["units"]
        + F.coalesce("marketing_roas", F.lit(0.0)) * F.col("total_marketing_spend") * w["roas"]
        + F.col("net_profit") * w["profit"]
    )
    totals = d.groupBy("product_id", "product_name").agg(
        F.avg(score).alias("avg_performance_score"),
        F.sum("total_product_revenue").alias("total_30day_revenue"),
        F.sum("total_units_sold").alias("total_30day_units"),
        F.avg("marketing_roas").alias("avg_marketing_roas"),
    )
    measures = {"revenue": "total_product_revenue", "units": "total_units_sold", "roas": "marketing_roas", "profit": "net_profit"}
    long = d.select(
        "date",
        "product_id",
        F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).cast("double").alias("v")) for k, c in measures.items()])),
    )
    ranked = sliced_row_number(long, ["date"], "v", "product_id", "rank", "measure")
    means = ranked.groupBy("product_id").agg(*[F.avg(F.when(F.col("measure") == k, F.col("rank"))).alias(f"avg_{k}_rank") for k in measures])
    best = totals.orderBy(F.desc("avg_performance_score"), "product_id").limit(top)
    return best.join(means, "product_id")


def channel_effectiveness(perf: DataFrame, as_of: str, days: int = 90, min_revenue: float = 100.0) -> DataFrame:
    g = (
        with_rates(perf.filter(since("date", as_of, days)))
        .groupBy("product_id", "product_name", "product_category")
        .agg(
            F.sum("ads_attributed_revenue").alias("ads"),
            F.avg("ads_roas").alias("roas"),
            F.sum("email_attributed_revenue").alias("mail"),
            F.avg("revenue_per_email").alias("per_mail"),
            F.sum("organic_revenue").alias("organic"),
            F.sum("total_product_revenue").alias("total_revenue"),
            F.sum("total_units_sold").alias("total_units"),
        )
        .filter(F.col("total_revenue") > min_revenue)
    )
    ads, mail = F.col("ads"), F.col("mail")
    best = cases(
        [
            ((F.col("roas") >= 3.0) & (ads > mail), "facebook"),
            ((F.col("per_mail") >= 0.5) & (mail > ads), "email"),
            (F.col("organic") > F.greatest(ads, mail), "organic"),
        ],
        "mixed",
    )
    return g.select(
        "product_id", "product_name", "product_category", "total_revenue", "total_units",
        *[money(ratio(c, "total_revenue") * 100).alias(f"{n}_revenue_share") for c, n in (("ads", "ads"), ("mail", "email"), ("organic", "organic"))],
        money("roas").alias("ads_roas"), money("per_mail").alias("email_efficiency"), best.alias("best_channel"),
    )


def trend_class(recent: str, before: str) -> Column:
    r, b = F.col(recent), F.col(before)
    return cases([(r > b * TREND_UP, "increasing"), (r < b * TREND_DOWN, "decreasing")], "stable")


def stock_advice(cover: Column, roas: str, volatility: str, demand: str, high_cover: float) -> Column:
    return cases(
        [
            ((cover < 7) & (F.col(roas) > 2.0), "increase_stock"),
            ((cover > high_cover) & (F.col(roas) < 1.5), "reduce_stock"),
            (F.col(volatility) > F.col(demand) * 0.5, "monitor_closely"),
        ],
        "maintain_current",
    )


def marketing_advice(roas: Column, demand: Column) -> Column:
    return cases(
        [((roas > 3.0) & (demand > 0), "increase_marketing"), (roas < 1.5, "reduce_marketing"), (roas.between(1.5, 3.0), "optimize_marketing")],
        "no_marketing_data",
    )


def _periods(as_of: str, recent_days: int) -> tuple[Column, Column]:
    recent = since("date", as_of, recent_days)
    return recent, F.col("date").between(days_before(as_of, 90), days_before(as_of, recent_days))


def inventory_insight(perf: DataFrame, as_of: str, recent_days: int = 30, min_days: int = 5) -> DataFrame:
    """Recent against earlier demand, volatility and advice per product, in one conditional aggregate."""
    recent, before = _periods(as_of, recent_days)
    last = F.col("date") == days_before(as_of, 1)
    g = (
        with_rates(perf.filter(since("date", as_of, 90)))
        .groupBy("product_id", "product_name")
        .agg(
            F.avg(F.when(recent, F.col("daily_demand_velocity"))).alias("recent_avg_daily_demand"),
            F.avg(F.when(recent, F.col("marketing_roas"))).alias("recent_avg_roas"),
            F.avg(F.when(recent, F.col("net_profit_margin"))).alias("recent_avg_profit_margin"),
            F.avg(F.when(before, F.col("daily_demand_velocity"))).alias("historical_avg_daily_demand"),
            F.max(F.when(last, F.col("inventory_level"))).alias("current_inventory"),
            F.stddev_samp("daily_demand_velocity").alias("demand_volatility"),
            count_if(F.col("daily_demand_velocity") > 0).alias("days_with_sales"),
        )
        .filter(F.col("days_with_sales") >= min_days)
    )
    cover = ratio("current_inventory", "recent_avg_daily_demand")
    return g.withColumns(
        {
            "demand_trend": trend_class("recent_avg_daily_demand", "historical_avg_daily_demand"),
            "inventory_recommendation": stock_advice(cover, "recent_avg_roas", "demand_volatility", "recent_avg_daily_demand", 30),
            "days_of_inventory": cover,
            "marketing_recommendation": marketing_advice(F.col("recent_avg_roas"), F.col("recent_avg_daily_demand")),
        }
    )


def inventory_export(perf: DataFrame, as_of: str, recent_days: int = 30, min_days: int = 5) -> DataFrame:
    """Product inventory optimisation export with growth, volatility, stock-out and ROI flags."""
    recent, before = _periods(as_of, recent_days)
    last = F.col("date") == days_before(as_of, 1)
    units = F.col("total_units_sold")
    g = (
        with_rates(perf.filter(since("date", as_of, 90)))
        .groupBy("product_id")
        .agg(
            F.max("product_name").alias("product_name"),
            F.max("product_category").alias("category"),
            F.max("product_sku").alias("sku"),
            F.avg(F.when(recent, units)).alias("avg_daily_demand_recent"),
            F.avg(F.when(before, units)).alias("avg_daily_demand_historical"),
            F.sum(F.when(recent, F.col("total_product_revenue"))).alias("recent_revenue"),
            F.avg(F.when(recent, F.col("marketing_roas"))).alias("avg_roas_recent"),
            F.max(F.when(last, F.col("inventory_level"))).alias("current_inventory_level"),
            F.max(F.when(last, F.col("inventory_cost"))).alias("current_inventory_cost"),
            F.avg("total_marketing_spend").alias("avg_daily_marketing_spend"),
            F.avg("ads_roas").alias("avg_ads_roas"),
            F.avg("revenue_per_email").alias("avg_email_revenue_per_send"),
            F.stddev_samp("total_units_sold").alias("demand_volatility"),
            F.max("total_units_sold").alias("peak_daily_demand"),
            count_if(units > 0).alias("days_with_sales"),
            F.avg("net_profit").alias("avg_daily_profit"),
            F.avg("net_profit_margin").alias("avg_profit_margin"),
        )
        .filter(F.col("days_with_sales") >= min_days)
    )
    cover = ratio_pos("current_inventory_level", "avg_daily_demand_recent", None)
    return g.withColumns(
        {
            "days_of_inventory_remaining": cover,
            "demand_trend": trend_class("avg_daily_demand_recent", "avg_daily_demand_historical"),
            "inventory_recommendation": stock_advice(cover, "avg_roas_recent", "demand_volatility", "avg_daily_demand_recent", 60),
            "marketing_recommendation": marketing_advice(F.col("avg_roas_recent"), F.col("avg_daily_demand_recent")),
        }
    )


def export_flags(export: DataFrame) -> DataFrame:
    from ..functions.scalar import flag

    roas = F.coalesce("avg_roas_recent", F.lit(0.0))
    return export.select(
        "product_id",
        flag((F.col("demand_trend") == "increasing") & (roas > 2.0)).alias("high_growth_flag"),
        flag(F.col("days_of_inventory_remaining") < 7).alias("stockout_risk_flag"),
        flag(F.coalesce("demand_volatility", F.lit(0.0)) > F.coalesce("avg_daily_demand_recent", F.lit(0.0)) * 0.5).alias("high_volatility_flag"),
        flag(roas > 3.0).alias("high_roi_flag"),
    )


def correlation(x: Column, y: Column, over: Window | None = None) -> Column:
    """Pearson correlation; null where either side does not vary (the built-in divides by zero there)."""
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = parts if over is None else [p.over(over) for p in parts]
    return ratio(cov, sx * sy)


def demand_profile(perf: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """7- and 30-day means, spend correlation, weekend and weekday means, 95th percentile per product."""
    v = F.col("daily_demand_velocity")
    weekend = dow("date").isin(0, 6)
    return (
        with_rates(perf.filter(since("date", as_of, days)))
        .filter(F.col("total_units_sold") > 0)
        .groupBy("product_id")
        .agg(
            F.avg(F.when(since("date", as_of, 7), v)).alias("recent_7day_demand"),
            F.avg(F.when(since("date", as_of, 30), v)).alias("recent_30day_demand"),
            correlation(F.col("total_marketing_spend"), v.cast("double")).alias("marketing_demand_correlation"),
            F.avg("marketing_roas").alias("avg_marketing_efficiency"),
            F.avg(F.when(weekend, v)).alias("weekend_demand"),
            F.avg(F.when(~weekend, v)).alias("weekday_demand"),
            F.stddev_samp(v).alias("demand_volatility"),
            F.max(v).alias("peak_demand"),
            F.percentile(v, 0.95).alias("demand_95th_percentile"),
            F.avg("net_profit_margin").alias("avg_profit_margin"),
            F.min("net_profit_margin").alias("min_profit_margin"),
        )
    )


def portfolio(perf: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    g = (
        with_rates(perf.filter(since("date", as_of, days)))
        .groupBy("product_category")
        .agg(
            F.countDistinct("product_id").alias("product_count"),
            F.sum("total_product_revenue").alias("category_revenue"),
            F.avg("marketing_roas").alias("roas"),
            F.avg("net_profit_margin").alias("margin"),
            F.sum("total_marketing_spend").alias("category_marketing_spend"),
            F.stddev_samp("total_product_revenue").alias("spread"),
        )
    )
    total = g.agg(F.sum("category_revenue")).scalar()
    advice = cases(
        [
            ((F.col("roas") > 3.0) & (F.col("margin") > 0.3), "expand"),
            ((F.col("roas") < 1.5) | (F.col("margin") < 0.1), "reduce"),
            (F.col("spread") > F.col("category_revenue") * 0.3, "stabilize"),
        ],
        "maintain",
    )
    return g.select(
        "product_category", "product_count", "category_revenue", money("roas").alias("avg_roas"), money(F.col("margin") * 100).alias("avg_margin_percentage"),
        "category_marketing_spend", money("spread").alias("revenue_volatility"), money(ratio("category_revenue", total) * 100).alias("revenue_share_percentage"),
        advice.alias("portfolio_recommendation"),
    )


def seasonal_pattern(perf: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    return (
        with_rates(perf.filter(since("date", as_of, days)))
        .filter(F.col("total_units_sold") > 0)
        .groupBy("product_id", "product_name", F.month("date").cast("bigint").alias("month"), dow("date").alias("day_of_week"))
        .agg(F.avg("daily_demand_velocity").alias("avg_demand"), F.avg("marketing_roas").alias("avg_roas"), F.count(F.lit(1)).alias("data_points"))
    )


def product_share(items: DataFrame) -> DataFrame:
    """Each line's share of its order: by net revenue, else by units, else 0.

    Order totals are folded first and joined back, so an order with very many lines is split at
    run time instead of filling one window task.
    """
    net = F.col("price") * F.col("quantity") - F.col("total_discount")
    lines = items.select("order_id", "line_number", "product_id", "quantity", net.alias("net"))
    totals = lines.groupBy("order_id").agg(F.sum("net").alias("order_net"), F.sum("quantity").alias("order_units"))
    share = F.when(F.col("order_net") > 0, ratio("net", "order_net")).when(F.col("order_units") > 0, ratio("quantity", "order_units")).otherwise(0.0)
    return lines.join(totals, "order_id").select("order_id", "line_number", "product_id", share.alias("product_share"))


def campaign_allocation(credits: DataFrame, ad_totals: DataFrame, mail_totals: DataFrame) -> DataFrame:
    """Campaign spend, impressions, clicks and sends shared out to products by attributed revenue.

    `credits` has one row per date, product and campaign with ads and e-mail revenue; totals per
    campaign and date are folded from it.
    """
    keys = ["campaign_id", "date"]
    totals = credits.groupBy(*keys).agg(F.sum("ads_credit").alias("ads_total"), F.sum("email_credit").alias("email_total"))
    d = credits.join(totals, keys, "left").join(ad_totals, keys, "left").join(mail_totals, keys, "left")
    ads_share, mail_share = ratio_pos("ads_credit", "ads_total"), ratio_pos("email_credit", "email_total")
    return d.select(
        "date",
        "product_id",
        "campaign_id",
        *[(F.coalesce(F.col(f"campaign_{m}").cast("double"), F.lit(0.0)) * ads_share).alias(f"{m}_allocated") for m in ("spend", "impressions", "clicks")],
        *[(F.coalesce(F.col(f"campaign_{m}").cast("double"), F.lit(0.0)) * mail_share).alias(f"{m}_allocated") for m in ("emails_sent", "emails_opened")],
    )


def allocated_by_product(allocation: DataFrame) -> DataFrame:
    cols = [c for c in allocation.columns if c.endswith("_allocated")]
    return allocation.groupBy("date", "product_id").agg(*[F.sum(c).alias(c) for c in cols])


def organic_residual(orders: DataFrame) -> DataFrame:
    """Revenue and units left after attribution, never negative; units rounded to whole numbers."""
    share = ratio(F.col("ads_credit") + F.col("email_credit"), "revenue", 0.0)

    def whole(c: Column) -> Column:
        return F.round(c.cast("decimal(18,4)"), 0).cast("bigint")

    g = orders.groupBy("date", "product_id").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.sum("ads_credit").alias("ads"),
        F.sum("email_credit").alias("mail"),
        F.sum(F.col("units") * share).alias("credited_units"),
    )
    return g.select(
        "date",
        "product_id",
        "revenue",
        F.greatest(F.lit(0.0), F.col("revenue") - F.col("ads") - F.col("mail")).alias("organic_revenue"),
        whole(F.col("credited_units")).alias("total_attributed_units"),
        whole(F.greatest(F.lit(0.0), F.col("units") - F.col("credited_units"))).alias("organic_units"),
    )


def revenue_share(perf: DataFrame) -> DataFrame:
    """Share of total revenue per product; the total is a one-row subquery, not a window over everything."""
    g = perf.groupBy("product_id").agg(F.sum("revenue").alias("revenue"))
    total = g.agg(F.sum("revenue")).scalar()
    return g.select("product_id", "revenue", (ratio("revenue", total) * 100).alias("revenue_share"))


def _by_date(product: str = "product_id") -> Window:
    return Window.partitionBy(product).orderBy("date")


def units_week_ago(perf: DataFrame) -> DataFrame:
    return perf.select("product_id", "date", "units_sold", F.lag("units_sold", 7).over(_by_date()).alias("units_sold_7_days_ago"))


def trailing_demand(perf: DataFrame, rows: int = 30) -> DataFrame:
    w = _by_date().rowsBetween(-(rows - 1), 0)
    return perf.select(
        "product_id", "date", F.avg("units_sold").over(w).alias("avg_daily_demand_30d"), F.stddev_samp("units_sold").over(w).alias("demand_volatility_30d")
    )


def trailing_correlation(perf: DataFrame, rows: int = 30) -> DataFrame:
    w = _by_date().rowsBetween(-(rows - 1), 0)
    c = correlation(F.col("total_marketing_spend"), F.col("units_sold").cast("double"), w)
    return perf.select("product_id", "date", c.alias("marketing_demand_correlation"))


def percent_change(perf: DataFrame) -> DataFrame:
    def change(c: str) -> Column:
        before = F.lag(c).over(_by_date())
        return ratio(F.col(c) - before, before)

    return perf.select("product_id", "date", change("units_sold").alias("demand_trend"), change("revenue").alias("revenue_trend"))


def optimisation_features(perf: DataFrame, attr: DataFrame) -> DataFrame:
    """Product-by-day sums and means with the day's attribution summary."""
    d = perf.withColumns(
        {"marketing_efficiency": F.col("total_attributed_revenue") / F.when(F.col("total_marketing_spend") == 0, 1.0).otherwise(F.col("total_marketing_spend")), "organic_ratio": ratio("organic_revenue", "revenue")}
    )
    by_product = d.groupBy("product_id", "date").agg(
        F.sum("units_sold").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        F.sum("total_marketing_spend").alias("marketing_spend"),
        F.avg("marketing_efficiency").alias("marketing_efficiency"),
        F.avg("organic_ratio").alias("organic_ratio"),
    )
    by_day = attr.groupBy("date").agg(
        F.sum("ads_attributed_revenue").alias("ads_attributed"),
        F.sum("email_attributed_revenue").alias("email_attributed"),
        F.avg("journey_duration_hours").alias("journey_duration_hours"),
        F.avg("touchpoint_count").alias("touchpoint_count"),
    )
    return by_product.join(by_day, "date", "left")


def performance_kpis(perf: DataFrame) -> DataFrame:
    d = with_rates(perf)
    cover = ratio("inventory_level", "daily_demand_velocity")
    g = d.groupBy("product_category").agg(
        F.avg("marketing_roas").alias("marketing_roas"),
        ratio(F.sum("total_product_revenue"), F.countDistinct("product_id")).alias("revenue_per_product"),
        F.avg("total_units_sold").alias("units_velocity"),
        F.avg("net_profit_margin").alias("profit_margin"),
        F.avg("ads_roas").alias("ads_product_roas"),
        F.avg("revenue_per_email").alias("email_revenue_per_send"),
        ratio(F.sum("organic_units"), F.sum("total_units_sold")).alias("organic_conversion_rate"),
        F.avg("inventory_turnover_rate").alias("inventory_turnover"),
        F.avg(cover).alias("days_of_inventory"),
        count_if(cover < 7).alias("stockout_risk_rows"),
        count_if(cover > 60).alias("overstock_risk_rows"),
    )
    return g


def missing_dates(have: DataFrame, built: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Recent dates present in the source but not yet built (null-safe anti join)."""
    recent = have.filter(since("date", as_of, days)).select("date").distinct()
    return recent.join(built.filter(since("date", as_of, days)).select("date").distinct(), "date", "left_anti")


def product_date_pivot(perf: DataFrame, value: str, dates: list[str]) -> DataFrame:
    """Products as rows, the given dates as columns."""
    return perf.groupBy("product_id").pivot("day", dates).agg(F.sum(value))


def day_summary(perf: DataFrame) -> DataFrame:
    """One row per day: products sold, units, revenue, marketing spend, attributed revenue, return on spend."""
    return perf.groupBy("date").agg(
        F.count(F.lit(1)).alias("products"), F.sum("units_sold").alias("units_sold"), F.sum("revenue").alias("revenue"), F.sum("total_marketing_spend").alias("spend"),
        F.sum("total_attributed_revenue").alias("attributed"), ratio(F.sum("total_attributed_revenue"), F.sum("total_marketing_spend")).alias("roas"),
    )
