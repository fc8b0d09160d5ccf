"""Marketing-aware reorder recommendations over a product snapshot with inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cases, lookup, ratio, whole
from .snapshot import priority_rank

# Demand boosts, volatility and response per marketing mix, safety and cap days.
ADS_BOOST = [(3.0, 1.15), (2.0, 1.08)]
MAIL_BOOST = [(1.0, 1.12), (0.5, 1.06)]
STAR_BOOST = 1.05
CHANNEL_VOLATILITY = {
    "multi_channel_star": 1.1, "facebook_focused": 1.3, "email_focused": 2.0, "organic_focused": 1.0, "marketing_dependent": 1.4, "low_marketing_impact": 0.9,
}
CAMPAIGN_RESPONSE = {
    "multi_channel_star": 1.5, "facebook_focused": 1.3, "email_focused": 1.4, "organic_focused": 0.8, "marketing_dependent": 1.2, "low_marketing_impact": 0.6,
}
FORECAST_DAYS, SAFETY_DAYS, CAP_DAYS = 42, 14, 90
STAR = "multi_channel_star"
DEFAULT_POINT, DEFAULT_CAP = 21, 75


def is_star() -> Column:
    return F.col("marketing_mix_type") == STAR


def on(c: str) -> Column:
    return F.col(c) == 1


def daily_pace() -> Column:
    return F.col("units_sold") / F.lit(30.0)


def _boost(c: str, steps: list[tuple[float, float]]) -> Column:
    return cases([(F.col(c) >= bound, factor) for bound, factor in steps], 1.0)


def adjusted_demand(snap: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """Daily demand lifted by ad return, e-mail efficiency and multi-channel stars, over the forecast days."""
    lift = _boost("ads_roas_7d", ADS_BOOST) * _boost("email_efficiency_3d", MAIL_BOOST) * F.when(is_star(), STAR_BOOST).otherwise(1.0)
    return (
        snap.withColumns({"base_daily_demand": daily_pace(), "marketing_multiplier": lift})
        .withColumn("marketing_adjusted_daily_demand", F.col("base_daily_demand") * F.col("marketing_multiplier"))
        .withColumns(
            {"marketing_adjusted_6week_demand": F.col("marketing_adjusted_daily_demand") * days, "demand_forecast_confidence": forecast_confidence()}
        )
    )


def forecast_confidence() -> Column:
    def plus(c: Column) -> Column:
        return F.when(c, 0.1).otherwise(0.0)

    raw = F.lit(0.7) + plus(F.col("ads_roas_7d") > 0) + plus(F.col("email_efficiency_3d") > 0) + plus(F.col("units_sold") > 10) + plus(is_star())
    return F.least(F.greatest(raw, F.lit(0.3)), F.lit(0.95))


def channel_safety(snap: DataFrame) -> DataFrame:
    """14 days of demand, scaled by the volatility of the marketing mix and the star adjustments."""
    base = daily_pace() * SAFETY_DAYS
    factor = lookup("marketing_mix_type", CHANNEL_VOLATILITY, 1.0)
    stock = (
        base * factor
        * F.when(on("ads_star"), 1.1).otherwise(1.0)
        * F.when(on("email_champion"), 1.15).otherwise(1.0)
        * F.when(on("organic_winner"), 0.95).otherwise(1.0)
    )
    pace = F.when(daily_pace() == 0, 1.0).otherwise(daily_pace())
    return snap.withColumns(
        {
            "base_safety_stock": base,
            "channel_volatility_multiplier": factor,
            "channel_adjusted_safety_stock": stock,
            "channel_adjusted_safety_days": stock / pace,
        }
    )


def marketing_priority() -> Column:
    """Later rules win: low impact overrides the high classes."""
    return cases(
        [
            (F.col("marketing_mix_type") == "low_marketing_impact", "LOW"),
            (on("email_champion") & (F.col("email_efficiency_3d") > 1.5), "HIGH"),
            (on("ads_star") & (F.col("ads_roas_7d") > 4.0), "HIGH"),
            (is_star(), "HIGH"),
        ],
        "MEDIUM",
    )


NEEDS = ("ads_roas_7d", "email_efficiency_3d", "marketing_mix_type")


def marketing_reorder(snap: DataFrame) -> DataFrame:
    """Reorder quantity from lifted demand and channel safety stock, capped at 90 days.

    Without the marketing columns the plain form is used: base demand, one week of safety stock.
    """
    if any(c not in snap.columns for c in NEEDS):
        return plain_reorder(snap)
    d = channel_safety(adjusted_demand(snap))
    estimate = daily_pace() * 10
    available = F.coalesce(F.col("available_inventory").cast("double"), F.col("current_inventory_level").cast("double"), estimate)
    need = F.greatest(F.lit(0.0), F.col("marketing_adjusted_6week_demand") + F.col("channel_adjusted_safety_stock") - available)
    weight = (
        F.when(is_star(), 1.1).otherwise(1.0) * F.when(on("ads_star"), 1.05).otherwise(1.0) * F.when(on("email_champion"), 1.08).otherwise(1.0)
    )
    d = d.withColumn("marketing_optimized_reorder", F.least(need * weight, F.col("marketing_adjusted_daily_demand") * CAP_DAYS))
    price = F.col("revenue") / F.when(F.col("units_sold") == 0, 1).otherwise(F.col("units_sold"))
    return d.withColumns(
        {"marketing_priority": marketing_priority(), "marketing_revenue_opportunity": F.col("marketing_optimized_reorder") * price}
    )


def plain_reorder(snap: DataFrame) -> DataFrame:
    stock = F.coalesce(F.col("current_inventory_level").cast("double"), daily_pace() * 10)
    return snap.withColumns(
        {
            "base_daily_demand": daily_pace(),
            "marketing_multiplier": F.lit(1.0),
            "marketing_adjusted_daily_demand": daily_pace(),
            "marketing_adjusted_6week_demand": daily_pace() * FORECAST_DAYS,
            "channel_volatility_multiplier": F.lit(1.0),
            "channel_adjusted_safety_stock": daily_pace() * 7,
            "marketing_optimized_reorder": F.greatest(F.lit(0.0), daily_pace() * (FORECAST_DAYS + 7) - stock),
            "marketing_priority": F.lit("MEDIUM"),
            "demand_forecast_confidence": F.lit(0.7),
            "marketing_revenue_opportunity": F.lit(0.0),
        }
    )


def campaign_impact(snap: DataFrame, lift: float = 0.3, days: int = 7) -> DataFrame:
    response = lookup("marketing_mix_type", CAMPAIGN_RESPONSE, 1.0)
    return snap.withColumns(
        {
            "campaign_demand_lift": daily_pace() * lift * response * days,
            "campaign_inventory_needed": daily_pace() * lift * response * days,
            "campaign_prep_days": F.when(on("ads_star"), 14).otherwise(21),
        }
    )


def campaign_requirements(snap: DataFrame) -> DataFrame:
    likely = (F.col("ads_roas_7d") > 3.0) | (F.col("email_efficiency_3d") > 1.0) | is_star()
    return snap.withColumns(
        {
            "has_upcoming_campaign": F.when(likely, 1).otherwise(0),
            "campaign_priority": F.when(likely, "high").otherwise("none"),
            "campaign_inventory_boost": F.when(likely, daily_pace() * 7 * 0.3).otherwise(0.0),
        }
    )


def demand_multiplier(snap: DataFrame) -> DataFrame:
    """1.2 for marketing-driven products with return above 2, 1.15 for e-mail-responsive ones with a campaign."""
    m = F.when(on("marketing_driven") & (F.col("ads_roas_7d") > 2.0), 1.2).otherwise(1.0) * F.when(
        on("email_responsive") & on("has_upcoming_campaign"), 1.15
    ).otherwise(1.0)
    planned = 1 + F.col("marketing_efficiency") * F.coalesce(ratio("planned_spend", "marketing_spend"), F.lit(0.0))
    return snap.withColumns(
        {
            "demand_multiplier": m,
            "adjusted_demand": daily_pace() * m,
            "spend_adjusted_demand": daily_pace() * planned,
        }
    )


def six_week_table(snap: DataFrame) -> DataFrame:
    """Stock, risk, priority, confidence and recommended order per product, standard and marketing-optimised."""
    d = marketing_reorder(snap)
    real = F.col("current_inventory_level").isNotNull()
    pace, units = daily_pace(), F.col("units_sold")
    estimated = F.greatest(F.lit(1).cast("bigint"), whole(pace * 10))
    stock = F.when(real, F.col("current_inventory_level")).otherwise(estimated)
    have = F.when(real, F.coalesce("available_inventory", "current_inventory_level")).otherwise(estimated)
    d = d.withColumns(
        {
            "current_stock": stock,
            "available_stock": have,
            "reorder_point": F.when(real, F.coalesce("reorder_point", F.lit(DEFAULT_POINT))).otherwise(F.lit(DEFAULT_POINT)).cast("bigint"),
            "max_stock": F.when(real, F.coalesce("max_stock_level", F.lit(DEFAULT_CAP))).otherwise(F.lit(DEFAULT_CAP)).cast("bigint"),
            "safety_days": F.when(real, F.coalesce("safety_stock_days", F.lit(SAFETY_DAYS))).otherwise(F.lit(SAFETY_DAYS)).cast("bigint"),
            "data_source": F.when(real, "REAL_INVENTORY").otherwise("ESTIMATED"),
            "daily_sales": pace,
            "six_week_demand": pace * FORECAST_DAYS,
        }
    )
    have, point = F.col("available_stock"), F.col("reorder_point")
    d = d.withColumn("days_until_stockout", have / F.greatest(pace, F.lit(0.1)))
    d = d.withColumns(
        {
            "stockout_risk": cases([(have <= point, "HIGH"), (F.col("days_until_stockout") < 60, "MEDIUM")], "LOW"),
            "overstock_risk": cases([(have > F.col("max_stock"), "HIGH"), (have > F.col("max_stock") * 0.8, "MEDIUM")], "LOW"),
            "confidence": F.when(real, F.when(units > 10, "HIGH").otherwise("MEDIUM")).otherwise(F.when(units > 50, "MEDIUM").otherwise("LOW")),
            "revenue_at_risk": F.when(have < point, (point - have) * (F.col("revenue") / F.greatest(units, F.lit(1)))).otherwise(0.0),
        }
    )
    out, over = F.col("stockout_risk"), F.col("overstock_risk") == "LOW"
    standard = F.greatest(F.lit(0).cast("bigint"), whole(F.greatest(F.lit(0.0), F.col("six_week_demand") + pace * F.col("safety_days") - have)))
    capped = F.when(standard > pace * 90, whole(pace * 60)).otherwise(standard)
    return d.select(
        "product_id", "product_sku", "marketing_mix_type", "current_stock", "available_stock", "reorder_point", "data_source", "daily_sales", "days_until_stockout",
        "stockout_risk", "overstock_risk",
        cases([(out == "HIGH", "URGENT"), ((out == "MEDIUM") & over, "HIGH"), ((out == "LOW") & over, "MEDIUM")], "LOW").alias("priority"),
        "confidence", "revenue_at_risk", "six_week_demand", capped.alias("standard_order"), whole("marketing_optimized_reorder").alias("recommended_order"),
        "marketing_priority", "demand_forecast_confidence", "channel_adjusted_safety_days", "marketing_revenue_opportunity",
    )


def reorder_totals(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if(F.col("priority") == "URGENT").alias("urgent_reorders"),
        F.coalesce(F.sum(F.when(F.col("stockout_risk") == "HIGH", F.col("revenue_at_risk"))), F.lit(0.0)).alias("revenue_at_risk"),
        F.count_if(F.col("overstock_risk") == "HIGH").alias("overstock_products"),
        F.sum("recommended_order").alias("total_reorder_units"),
    )


def by_priority(table: DataFrame) -> DataFrame:
    return table.withColumn("priority_score", priority_rank("priority")).orderBy(F.desc("priority_score"), F.desc("revenue_at_risk"), "product_id")
