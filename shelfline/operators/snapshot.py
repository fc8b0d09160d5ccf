"""Product snapshot features, recommendation classes and portfolio summaries: projections, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cases, first_present, flag, lookup, ratio_pos, up_to

# Bin edges, flag limits, class names and confidence levels.
DEMAND_BINS = [(1, "low"), (3, "medium"), (10, "high")]
REVENUE_BINS = [(100, "low_value"), (200, "medium_value"), (float("inf"), "high_value")]
ASSUMED_MARGIN, SERVICE_TARGET = 0.3, 0.95
STOCK_DAYS, REORDER_DAYS = 7, 3
MIX_CLASSES = ("multi_channel_star", "facebook_focused", "email_focused", "organic_focused", "marketing_dependent", "low_marketing_impact")

# Alternative names a feed may use for the same measure, in order of preference.
ADS_SPEND = ("ads_spend", "ad_spend", "fb_spend")
ADS_REVENUE = ("ads_7d_attributed_revenue", "ads_attributed_revenue", "fb_attributed_revenue")
MAIL_REVENUE = ("email_3d_attributed_revenue", "email_attributed_revenue")


def features(snap: DataFrame) -> DataFrame:
    """Velocity, price, efficiency and organic ratio, then the channel windows with their fallbacks."""
    zero = F.lit(0.0)

    def have(*names: str) -> Column:
        return F.coalesce(first_present(snap, names).cast("double"), zero)

    simple_price = F.col("revenue") / F.when(F.col("units_sold") == 0, 1).otherwise(F.col("units_sold"))
    d = snap.withColumns(
        {
            "demand_velocity": F.col("units_sold"),
            "unit_price": F.coalesce(first_present(snap, ("avg_selling_price",), None), simple_price),
            "marketing_spend": have("total_marketing_spend"),
            "attributed_revenue": have("total_attributed_revenue"),
            "organic": have("organic_revenue"),
            "ads_cost": have(*ADS_SPEND),
            "ads_income": have(*ADS_REVENUE),
            "mails": have("emails_sent"),
            "mail_income": have(*MAIL_REVENUE),
            "mail_default_income": have("email_attributed_revenue"),
        }
    )
    return d.withColumns(
        {
            "marketing_efficiency": ratio_pos("attributed_revenue", "marketing_spend"),
            "organic_ratio": ratio_pos("organic", "revenue"),
            "ads_roas_7d": ratio_pos("ads_income", "ads_cost"),
            "email_efficiency_3d": ratio_pos("mail_income", "mails"),
            "category_clean": F.coalesce(first_present_text(snap, "product_category"), F.lit("other")),
        }
    )


def first_present_text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def bins(c: str, edges: list[tuple[float, str]]) -> Column:
    """Right-closed bins from 0 (included); values outside every bin stay null."""
    return F.when(F.col(c) >= 0, up_to(c, edges))


def flags(d: DataFrame) -> DataFrame:
    velocity, roas, mail = F.col("demand_velocity"), F.col("ads_roas_7d"), F.col("email_efficiency_3d")
    d = d.withColumns(
        {
            "demand_category": bins("demand_velocity", DEMAND_BINS),
            "revenue_category": bins("revenue", REVENUE_BINS),
            "high_ads_roas": flag(roas > 2.0),
            "high_email_efficiency": flag(mail > 0.5),
            "strong_organic": flag(F.col("organic_ratio") > 0.7),
            "high_performer": flag((velocity >= 2) & (F.col("revenue") >= 150)),
            "marketing_driven": flag(F.col("attributed_revenue") > F.col("organic")),
            "email_responsive": flag(F.col("mail_default_income") > 0),
            "ads_star": flag((roas > 3.0) & (velocity > 1)),
            "organic_winner": flag((F.col("organic_ratio") > 0.8) & (velocity > 2)),
        }
    )
    d = d.withColumn("email_champion", flag((mail > 1.0) & (F.col("email_responsive") == 1)))
    return d.withColumn("marketing_mix_type", marketing_mix())


def marketing_mix() -> Column:
    """First matching class, as one native expression."""

    def on(name: str) -> Column:
        return F.col(name) == 1

    tests = [on("ads_star") & on("email_champion"), on("ads_star"), on("email_champion"), on("organic_winner"), on("marketing_driven")]
    return cases(list(zip(tests, MIX_CLASSES)), MIX_CLASSES[-1])


def processed(snap: DataFrame) -> DataFrame:
    return flags(features(snap))


def strategic_input(p: DataFrame) -> DataFrame:
    return p.select(
        "date", "product_id", "product_name", "category_clean", "demand_velocity", "revenue", "unit_price", "marketing_efficiency", "organic_ratio",
        "high_performer", "marketing_driven", F.lit(1.0).alias("supply_constraint"), F.lit(ASSUMED_MARGIN).alias("profit_margin"),
        (F.col("demand_velocity") * F.col("unit_price") * ASSUMED_MARGIN).alias("current_performance"),
    )


def tactical_input(p: DataFrame) -> DataFrame:
    v = F.col("demand_velocity")
    return p.select(
        "date", "product_id", "demand_velocity", "revenue", "marketing_spend", "attributed_revenue", "organic_ratio", v.alias("demand_forecast"),
        (v * STOCK_DAYS).alias("inventory_level"), (v * REORDER_DAYS).alias("reorder_point"), (F.col("revenue") * ASSUMED_MARGIN).alias("profit_objective"),
        F.lit(SERVICE_TARGET).alias("service_level_objective"), F.col("marketing_spend").alias("cost_objective"),
    )


def strategic(p: DataFrame) -> DataFrame:
    """Recommendation class, priority, confidence and expected improvement."""
    d = strategic_input(p)
    v, eff, strong = F.col("demand_velocity"), F.col("marketing_efficiency"), F.col("high_performer") == 1
    rules = [
        (strong & (F.col("marketing_driven") == 1), ("increase_marketing_investment", "high")),
        ((v > 2) & (F.col("organic_ratio") > 0.7), ("maintain_organic_focus", "medium")),
        (eff > 2.0, ("scale_marketing", "high")),
    ]
    potential = v * (1 + eff)
    return d.select(
        "date", "product_id", "product_name", F.col("category_clean").alias("category"), "current_performance", potential.alias("demand_potential"),
        cases([(c, x[0]) for c, x in rules], "optimize_or_discontinue").alias("recommendation"),
        cases([(c, x[1]) for c, x in rules], "low").alias("priority"),
        (potential - F.col("current_performance")).alias("expected_improvement"),
        cases([(v == 0, 0.3), (strong, 0.9)], 0.7).alias("confidence"),
        "demand_velocity", "revenue", "marketing_efficiency",
    )


def tactical(p: DataFrame) -> DataFrame:
    """Scores, action, urgency and recommended stock; the global maximum is a one-row subquery."""
    d = tactical_input(p)
    top = d.agg(F.greatest(F.max("profit_objective"), F.lit(1.0))).scalar()
    demand, stock = F.col("demand_forecast"), F.col("inventory_level")
    d = d.withColumns(
        {
            "profit_score": F.least(F.col("profit_objective") / top, F.lit(1.0)),
            "service_score": F.least(stock / F.greatest(demand, F.lit(1)), F.lit(1.0)),
            "cost_efficiency": F.greatest(F.lit(0.0), 1 - F.col("cost_objective") / F.greatest(F.col("revenue"), F.lit(1.0))),
        }
    )
    rules = [
        (stock < F.col("reorder_point"), ("immediate_reorder", "high")),
        (demand > stock * 0.5, ("increase_stock", "medium")),
        ((F.col("service_score") > 0.95) & (F.col("cost_efficiency") > 0.7), ("maintain_current", "low")),
    ]
    factor = F.when(demand > 0, 1.5).otherwise(1.0)
    return d.select(
        "date", "product_id", "profit_score", "service_score", "cost_efficiency",
        cases([(c, x[0]) for c, x in rules], "optimize_inventory").alias("action"),
        cases([(c, x[1]) for c, x in rules], "medium").alias("urgency"),
        F.greatest(demand * STOCK_DAYS * factor, F.col("reorder_point").cast("double")).alias("recommended_stock_level"),
        stock.cast("double").alias("current_inventory"), demand.cast("double").alias("demand_forecast"),
        ((F.col("profit_score") + F.col("service_score") + F.col("cost_efficiency")) / 3).alias("optimization_confidence"),
    )


def merged(strategic: DataFrame, tactical: DataFrame) -> DataFrame:
    """Both recommendation sets on the union of their keys, defaults where one side is missing."""
    d = strategic.join(tactical, ["date", "product_id"], "full")
    zero = F.lit(0.0)
    return d.select(
        "date", "product_id", F.coalesce("product_name", F.lit("Unknown")).alias("product_name"), F.coalesce("category", F.lit("other")).alias("category"),
        F.coalesce("recommendation", F.lit("unknown")).alias("strategic_recommendation"), F.coalesce("action", F.lit("unknown")).alias("tactical_action"),
        F.coalesce("priority", F.lit("low")).alias("priority"), F.coalesce("urgency", F.lit("low")).alias("urgency"),
        F.coalesce("expected_improvement", zero).alias("expected_improvement"), F.coalesce("recommended_stock_level", zero).alias("recommended_stock_level"),
        F.coalesce("current_performance", zero).alias("current_performance"), F.coalesce("demand_velocity", F.lit(0)).alias("demand_velocity"), F.coalesce("revenue", zero).alias("revenue"),
        ((F.coalesce("confidence", zero) + F.coalesce("optimization_confidence", zero)) / 2).alias("overall_confidence"),
    )


def top_recommendations(unified: DataFrame, k: int = 5) -> DataFrame:
    score = F.col("expected_improvement") * F.col("overall_confidence")
    return unified.orderBy(score.desc(), "product_id", "date").limit(k)


def recommendation_export(unified: DataFrame, as_of: str) -> DataFrame:
    return unified.withColumn("optimization_timestamp", F.lit(as_of).cast("date"))


def summary(p: DataFrame) -> DataFrame:
    """Totals, means, flag counts and shares of a processed snapshot, in one row."""

    def n(c: str) -> Column:
        return F.sum(c).cast("bigint")

    def share(num: str, den: str) -> Column:
        return F.sum(num) / F.greatest(F.sum(den), F.lit(1.0))

    return p.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("demand_velocity").alias("total_units_sold"),
        F.avg("unit_price").alias("avg_unit_price"),
        F.sum("marketing_spend").alias("total_marketing_spend"),
        F.sum("attributed_revenue").alias("total_attributed_revenue"),
        share("attributed_revenue", "marketing_spend").alias("overall_marketing_roas"),
        share("organic", "revenue").alias("organic_revenue_share"),
        n("high_performer").alias("high_performers"),
        n("marketing_driven").alias("marketing_driven_products"),
        n("email_responsive").alias("email_responsive_products"),
        n("ads_star").alias("ads_stars"),
        n("email_champion").alias("email_champions"),
        n("organic_winner").alias("organic_winners"),
        F.count_if(F.col("marketing_mix_type") == MIX_CLASSES[0]).alias("multi_channel_stars"),
        F.avg("ads_roas_7d").alias("avg_ads_roas_7d"),
        F.avg("email_efficiency_3d").alias("avg_email_efficiency_3d"),
        n("high_ads_roas").alias("high_ads_roas_products"),
        n("high_email_efficiency").alias("high_email_efficiency_products"),
    )


def distributions(p: DataFrame) -> DataFrame:
    """Counts per value of the mix, category and demand class, from one scan."""
    dims = ("marketing_mix_type", "category_clean", "demand_category")
    long = p.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])))
    return long.filter(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("products"))


def totals_by(p: DataFrame, key: str) -> DataFrame:
    return p.groupBy(key).agg(
        F.sum("revenue").alias("revenue"), F.sum("demand_velocity").alias("units"), F.sum("marketing_spend").alias("marketing_spend"), F.count(F.lit(1)).alias("products")
    )


def portfolio_insights(p: DataFrame) -> DataFrame:
    gain = strategic(p).agg(F.sum("expected_improvement")).scalar()
    s = summary(p)
    n = F.greatest(F.col("total_products"), F.lit(1))
    return s.select(
        "total_products", "high_performers", (F.col("high_performers") / n).alias("performance_rate"), "total_revenue", "organic_revenue_share", "overall_marketing_roas",
        "avg_unit_price", (F.col("email_responsive_products") / n).alias("email_responsive_rate"), (F.col("marketing_driven_products") / n).alias("marketing_driven_rate"),
        "total_marketing_spend", gain.alias("total_expected_improvement"),
    )


SORT_COLUMNS = {"Revenue": "revenue", "Units Sold": "demand_velocity", "Marketing Efficiency": "marketing_efficiency", "Organic Ratio": "organic_ratio"}
FILTER_COLUMNS = {"High Performers": "high_performer", "Marketing Driven": "marketing_driven", "Email Responsive": "email_responsive"}


def browse(p: DataFrame, category: str = "All", performance: str = "All", sort_by: str = "Revenue") -> DataFrame:
    """Interactive view: optional category and flag filters, sorted by the chosen measure."""
    if category != "All":
        p = p.filter(F.col("category_clean") == category)
    if performance != "All":
        p = p.filter(F.col(FILTER_COLUMNS[performance]) == 1)
    return p.orderBy(F.desc(SORT_COLUMNS[sort_by]), "product_id", "date")


def top_k(df: DataFrame, metric: str, k: int, largest: bool = True, ties: tuple[str, ...] = ("product_id",)) -> DataFrame:
    order = F.desc(metric) if largest else F.asc(metric)
    return df.orderBy(order, *ties).limit(k)


def bootstrap_products(snap: DataFrame) -> DataFrame:
    """Product master rows estimated from one snapshot."""
    return snap.select(
        "product_id", F.col("product_name").alias("name"), F.coalesce("product_category", F.lit("apparel")).alias("category"), (F.col("revenue") * 0.4).alias("unit_cost"),
        (F.col("revenue") / F.greatest(F.col("units_sold"), F.lit(1))).alias("selling_price"), F.lit(7).cast("bigint").alias("lead_time_days"),
        F.lit(365).cast("bigint").alias("shelf_life_days"), F.lit(1).cast("bigint").alias("min_order_quantity"), F.lit(1000).cast("bigint").alias("max_order_quantity"),
    )


def bootstrap_inventory(snap: DataFrame) -> DataFrame:
    stock = F.col("units_sold") * 2
    zero = F.lit(0).cast("bigint")
    return snap.select("product_id", stock.alias("stock_level"), zero.alias("reserved_stock"), zero.alias("in_transit"), stock.alias("available_stock"))


def bootstrap_demand(snap: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Back-filled daily demand: the snapshot's units spread evenly, at least one a day."""
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    daily = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("units_sold") / float(days)).cast("bigint"))
    d = snap.select("product_id", daily.alias("quantity_demanded"), back.alias("days_ago"))
    return d.select(
        "product_id", F.date_sub(F.lit(as_of).cast("date"), F.col("days_ago")).alias("date"), "quantity_demanded", F.col("quantity_demanded").alias("quantity_fulfilled"),
        F.lit(False).alias("is_forecast"),
    )


def priority_rank(c: str) -> Column:
    return lookup(c, {"URGENT": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}, 0)
