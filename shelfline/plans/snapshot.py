"""Snapshot features, recommendations and reorder tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..operators import reorder as ro
from ..operators import snapshot as op
from ..session import scratch
from ..sources import sinks
from ..sources.tables import EVENT_AS_OF, Tables
from . import inventory as inv
from .registry import query
from .sqltext import define


def _r(cols: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols.split())


_FEATURES = """SELECT *, units_sold AS demand_velocity, coalesce(avg_selling_price, revenue / CASE WHEN units_sold = 0 THEN 1 ELSE units_sold END) AS unit_price, total_marketing_spend AS marketing_spend,
    total_attributed_revenue AS attributed_revenue, CASE WHEN total_marketing_spend > 0 THEN total_attributed_revenue / total_marketing_spend ELSE 0 END AS marketing_efficiency,
    CASE WHEN revenue > 0 THEN organic_revenue / revenue ELSE 0 END AS organic_ratio, CASE WHEN ads_spend > 0 THEN ads_attributed_revenue / ads_spend ELSE 0 END AS ads_roas_7d,
    CASE WHEN emails_sent > 0 THEN email_attributed_revenue / emails_sent ELSE 0 END AS email_efficiency_3d, coalesce(product_category, 'other') AS category_clean"""
_FLAGS = """SELECT *, CASE WHEN ads_star = 1 AND email_champion = 1 THEN 'multi_channel_star' WHEN ads_star = 1 THEN 'facebook_focused' WHEN email_champion = 1 THEN 'email_focused' WHEN organic_winner = 1 THEN 'organic_focused'
    WHEN marketing_driven = 1 THEN 'marketing_dependent' ELSE 'low_marketing_impact' END AS marketing_mix_type FROM (SELECT *, CASE WHEN email_efficiency_3d > 1 AND email_responsive = 1 THEN 1 ELSE 0 END AS email_champion
    FROM (SELECT *, CASE WHEN demand_velocity < 0 THEN NULL WHEN demand_velocity <= 1 THEN 'low' WHEN demand_velocity <= 3 THEN 'medium' WHEN demand_velocity <= 10 THEN 'high' END AS demand_category,
      CASE WHEN revenue < 0 THEN NULL WHEN revenue <= 100 THEN 'low_value' WHEN revenue <= 200 THEN 'medium_value' ELSE 'high_value' END AS revenue_category, CASE WHEN ads_roas_7d > 2 THEN 1 ELSE 0 END AS high_ads_roas,
      CASE WHEN email_efficiency_3d > 0.5 THEN 1 ELSE 0 END AS high_email_efficiency, CASE WHEN organic_ratio > 0.7 THEN 1 ELSE 0 END AS strong_organic, CASE WHEN demand_velocity >= 2 AND revenue >= 150 THEN 1 ELSE 0 END AS high_performer,
      CASE WHEN attributed_revenue > organic_revenue THEN 1 ELSE 0 END AS marketing_driven, CASE WHEN email_attributed_revenue > 0 THEN 1 ELSE 0 END AS email_responsive, CASE WHEN ads_roas_7d > 3 AND demand_velocity > 1 THEN 1 ELSE 0 END AS ads_star,
      CASE WHEN organic_ratio > 0.8 AND demand_velocity > 2 THEN 1 ELSE 0 END AS organic_winner FROM ({src}) f) g) h"""
define("snap", _FLAGS.replace("{src}", _FEATURES + " FROM performance"))
define(
    "month_totals",
    """SELECT product_id, any_value(product_name) AS product_name, any_value(product_category) AS product_category, any_value(product_sku) AS product_sku, CAST(sum(units_sold) AS BIGINT) AS units_sold, sum(revenue) AS revenue,
    sum(ads_spend) AS ads_spend, sum(ads_attributed_revenue) AS ads_attributed_revenue, CAST(sum(emails_sent) AS BIGINT) AS emails_sent, sum(email_attributed_revenue) AS email_attributed_revenue, sum(total_marketing_spend) AS total_marketing_spend,
    sum(total_attributed_revenue) AS total_attributed_revenue, sum(organic_revenue) AS organic_revenue, sum(revenue) / nullif(sum(units_sold), 0) AS avg_selling_price FROM performance WHERE date >= DATE '2024-01-31' - 30 GROUP BY 1""",
)
define(
    "month_snap",
    "SELECT f.*, current_inventory_level, available_inventory, reorder_point, max_stock_level, safety_stock_days FROM ("
    + _FLAGS.replace("{src}", _FEATURES + " FROM month_totals")
    + ") f LEFT JOIN stock_file s ON s.product_sku = f.product_sku",
)


def snap(t: Tables) -> DataFrame:
    """Processed snapshot rows: one per product and day."""
    return op.processed(t.performance)


def month_totals(t: Tables) -> DataFrame:
    p = t.performance.filter(F.col("date") >= F.date_sub(F.lit(EVENT_AS_OF).cast("date"), 30))
    sums = ("units_sold", "revenue", "ads_spend", "ads_attributed_revenue", "emails_sent", "email_attributed_revenue", "total_marketing_spend", "total_attributed_revenue", "organic_revenue")
    names = ("product_name", "product_category", "product_sku")
    g = p.groupBy("product_id", *names).agg(*[F.sum(c).alias(c) for c in sums])
    return g.withColumns({"avg_selling_price": ratio("revenue", "units_sold"), "date": F.lit(EVENT_AS_OF).cast("date")})


def month_snap(t: Tables) -> DataFrame:
    """One month per product with processed features and, where the SKU is known, its stock."""
    stock = inv.inventory(t).select("product_sku", "current_inventory_level", "available_inventory", "reorder_point", "max_stock_level", "safety_stock_days")
    return op.processed(month_totals(t)).join(stock, "product_sku", "left")


@query("P16_snapshot_features", f"SELECT date, product_id, demand_velocity, {_r('unit_price marketing_efficiency organic_ratio ads_roas_7d email_efficiency_3d')}, category_clean FROM snap")
def features(t: Tables) -> DataFrame:
    return op.features(t.performance).select(
        "date", "product_id", "demand_velocity", "unit_price", "marketing_efficiency", "organic_ratio", "ads_roas_7d", "email_efficiency_3d", "category_clean"
    )


@query("P17_demand_revenue_bins", "SELECT date, product_id, demand_category, revenue_category FROM snap")
def bins(t: Tables) -> DataFrame:
    return snap(t).select("date", "product_id", "demand_category", "revenue_category")


_FL = "high_ads_roas, high_email_efficiency, strong_organic, high_performer, marketing_driven, email_responsive, ads_star, email_champion, organic_winner"


@query("P18_performance_flags", f"SELECT date, product_id, {_FL} FROM snap")
def flags(t: Tables) -> DataFrame:
    return snap(t).select("date", "product_id", *_FL.split(", "))


@query("P19_marketing_mix", "SELECT date, product_id, marketing_mix_type FROM snap")
def mix(t: Tables) -> DataFrame:
    return snap(t).select("date", "product_id", "marketing_mix_type")


@query("U01_row_classification", "SELECT marketing_mix_type, count(*) AS rows FROM snap GROUP BY 1")
def row_class(t: Tables) -> DataFrame:
    return snap(t).groupBy("marketing_mix_type").agg(F.count(F.lit(1)).alias("rows"))


define("strategic_in", "SELECT date, product_id, product_name, category_clean, demand_velocity, revenue, unit_price, marketing_efficiency, organic_ratio, high_performer, marketing_driven, CAST(1 AS DOUBLE) AS supply_constraint, CAST(0.3 AS DOUBLE) AS profit_margin, demand_velocity * unit_price * CAST(0.3 AS DOUBLE) AS current_performance FROM snap")
define("tactical_in", "SELECT date, product_id, demand_velocity, revenue, marketing_spend, attributed_revenue, organic_ratio, demand_velocity AS demand_forecast, demand_velocity * 7 AS inventory_level, demand_velocity * 3 AS reorder_point, revenue * CAST(0.3 AS DOUBLE) AS profit_objective, CAST(0.95 AS DOUBLE) AS service_level_objective, marketing_spend AS cost_objective FROM snap")
define(
    "strategic",
    """SELECT date, product_id, product_name, category_clean AS category, current_performance, demand_velocity * (1 + marketing_efficiency) AS demand_potential,
    CASE WHEN high_performer = 1 AND marketing_driven = 1 THEN 'increase_marketing_investment' WHEN demand_velocity > 2 AND organic_ratio > 0.7 THEN 'maintain_organic_focus' WHEN marketing_efficiency > 2 THEN 'scale_marketing' ELSE 'optimize_or_discontinue' END AS recommendation,
    CASE WHEN high_performer = 1 AND marketing_driven = 1 THEN 'high' WHEN demand_velocity > 2 AND organic_ratio > 0.7 THEN 'medium' WHEN marketing_efficiency > 2 THEN 'high' ELSE 'low' END AS priority,
    demand_velocity * (1 + marketing_efficiency) - current_performance AS expected_improvement, CAST(CASE WHEN demand_velocity = 0 THEN 0.3 WHEN high_performer = 1 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence, demand_velocity, revenue, marketing_efficiency FROM strategic_in""",
)
define(
    "tactical",
    """SELECT date, product_id, profit_score, service_score, cost_efficiency,
    CASE WHEN inventory_level < reorder_point THEN 'immediate_reorder' WHEN demand_forecast > inventory_level * 0.5 THEN 'increase_stock' WHEN service_score > 0.95 AND cost_efficiency > 0.7 THEN 'maintain_current' ELSE 'optimize_inventory' END AS action,
    CASE WHEN inventory_level < reorder_point THEN 'high' WHEN demand_forecast > inventory_level * 0.5 THEN 'medium' WHEN service_score > 0.95 AND cost_efficiency > 0.7 THEN 'low' ELSE 'medium' END AS urgency,
    greatest(demand_forecast * 7 * CASE WHEN demand_forecast > 0 THEN CAST(1.5 AS DOUBLE) ELSE 1 END, reorder_point) AS recommended_stock_level, CAST(inventory_level AS DOUBLE) AS current_inventory, CAST(demand_forecast AS DOUBLE) AS demand_forecast,
    (profit_score + service_score + cost_efficiency) / 3 AS optimization_confidence FROM (SELECT *, least(profit_objective / greatest(max(profit_objective) OVER (), 1), 1) AS profit_score, least(inventory_level / greatest(demand_forecast, 1), CAST(1 AS DOUBLE)) AS service_score,
      greatest(0, 1 - cost_objective / greatest(revenue, 1)) AS cost_efficiency FROM tactical_in)""",
)
define(
    "recommendations",
    """SELECT date, product_id, product_name, category, recommendation AS strategic_recommendation, action AS tactical_action, priority, urgency, expected_improvement, recommended_stock_level, current_performance, demand_velocity, revenue,
    (confidence + optimization_confidence) / 2 AS overall_confidence FROM strategic FULL JOIN (SELECT date, product_id, action, urgency, recommended_stock_level, optimization_confidence FROM tactical) USING (date, product_id)""",
)


@query("P20_strategic_features", f"SELECT date, product_id, product_name, category_clean, demand_velocity, high_performer, marketing_driven, {_r('revenue unit_price marketing_efficiency organic_ratio supply_constraint profit_margin current_performance')} FROM strategic_in")
def strategic_in(t: Tables) -> DataFrame:
    return op.strategic_input(snap(t))


@query("P21_tactical_features", f"SELECT date, product_id, demand_velocity, demand_forecast, inventory_level, reorder_point, {_r('revenue marketing_spend attributed_revenue organic_ratio profit_objective service_level_objective cost_objective')} FROM tactical_in")
def tactical_in(t: Tables) -> DataFrame:
    return op.tactical_input(snap(t))


@query("R19_strategic_recommendation", f"SELECT date, product_id, product_name, category, recommendation, priority, demand_velocity, {_r('current_performance demand_potential expected_improvement confidence revenue marketing_efficiency')} FROM strategic")
def strategic(t: Tables) -> DataFrame:
    return op.strategic(snap(t))


@query("R20_tactical_scores", f"SELECT date, product_id, action, urgency, {_r('profit_score service_score cost_efficiency recommended_stock_level current_inventory demand_forecast optimization_confidence')} FROM tactical")
def tactical(t: Tables) -> DataFrame:
    return op.tactical(snap(t))


_REC = f"date, product_id, product_name, category, strategic_recommendation, tactical_action, priority, urgency, demand_velocity, {_r('expected_improvement recommended_stock_level current_performance revenue overall_confidence')}"


@query("R21_unified_recommendations", f"SELECT {_REC} FROM recommendations")
def unified(t: Tables) -> DataFrame:
    p = snap(t)
    return op.merged(op.strategic(p), op.tactical(p))


@query(
    "J19_key_union_join",
    """SELECT date, product_id, coalesce(recommendation, 'unknown') AS strategic_recommendation, coalesce(action, 'unknown') AS tactical_action FROM (SELECT * FROM strategic WHERE demand_velocity > 0) s FULL JOIN (SELECT * FROM tactical WHERE urgency <> 'low') t USING (date, product_id)""",
)
def key_union(t: Tables) -> DataFrame:
    p = snap(t)
    m = op.merged(op.strategic(p).filter(F.col("demand_velocity") > 0), op.tactical(p).filter(F.col("urgency") != "low"))
    return m.select("date", "product_id", "strategic_recommendation", "tactical_action")


@query("O07_key_set_union", "SELECT date, product_id FROM strategic WHERE demand_velocity > 0 UNION SELECT date, product_id FROM tactical WHERE urgency <> 'low'")
def key_set(t: Tables) -> DataFrame:
    return key_union(t).select("date", "product_id")


@query("O03_top_recommendations", f"SELECT {_REC} FROM recommendations ORDER BY expected_improvement * overall_confidence DESC, product_id, date LIMIT 5")
def top(t: Tables) -> DataFrame:
    return op.top_recommendations(unified(t))


@query("S15_recommendation_export", f"SELECT {_REC}, DATE '2024-01-31' AS optimization_timestamp FROM recommendations")
def export(t: Tables) -> DataFrame:
    """The export written under its declared name and read back."""
    rows = op.recommendation_export(unified(t), EVENT_AS_OF)
    folder = scratch(t.spark, "exports")
    names = sinks.write_export(rows, folder, sinks.export_name("recommendations", date.fromisoformat(EVENT_AS_OF)))
    reader = t.spark.read.schema(rows.schema).option("header", True).option("escape", '"')
    return reader.csv([f"{folder}/{n}" for n in names])


@query(
    "A47_snapshot_summary",
    """SELECT count(*) AS total_products, round(sum(revenue), 4) AS total_revenue, CAST(sum(demand_velocity) AS BIGINT) AS total_units_sold, round(avg(unit_price), 4) AS avg_unit_price, round(sum(marketing_spend), 4) AS total_marketing_spend,
    round(sum(attributed_revenue), 4) AS total_attributed_revenue, round(sum(attributed_revenue) / greatest(sum(marketing_spend), 1), 4) AS overall_marketing_roas, round(sum(organic_revenue) / greatest(sum(revenue), 1), 4) AS organic_revenue_share,
    CAST(sum(high_performer) AS BIGINT) AS high_performers, CAST(sum(marketing_driven) AS BIGINT) AS marketing_driven_products, CAST(sum(email_responsive) AS BIGINT) AS email_responsive_products, CAST(sum(ads_star) AS BIGINT) AS ads_stars,
    CAST(sum(email_champion) AS BIGINT) AS email_champions, CAST(sum(organic_winner) AS BIGINT) AS organic_winners, count(*) FILTER (marketing_mix_type = 'multi_channel_star') AS multi_channel_stars, round(avg(ads_roas_7d), 4) AS avg_ads_roas_7d,
    round(avg(email_efficiency_3d), 4) AS avg_email_efficiency_3d, CAST(sum(high_ads_roas) AS BIGINT) AS high_ads_roas_products, CAST(sum(high_email_efficiency) AS BIGINT) AS high_email_efficiency_products FROM snap""",
    digits=4,
)
def summary(t: Tables) -> DataFrame:
    return op.summary(snap(t))


@query(
    "A48_value_distributions",
    """SELECT 'marketing_mix_type' AS dimension, marketing_mix_type AS value, count(*) AS products FROM snap GROUP BY 2 UNION ALL SELECT 'category_clean', category_clean, count(*) FROM snap GROUP BY 2
    UNION ALL SELECT 'demand_category', demand_category, count(*) FROM snap WHERE demand_category IS NOT NULL GROUP BY 2""",
)
def distributions(t: Tables) -> DataFrame:
    return op.distributions(snap(t))


@query(
    "A49_category_totals",
    "SELECT category_clean, round(sum(revenue), 4) AS revenue, CAST(sum(demand_velocity) AS BIGINT) AS units, round(sum(marketing_spend), 4) AS marketing_spend, count(*) AS products FROM snap GROUP BY 1",
    digits=4,
)
def category_totals(t: Tables) -> DataFrame:
    return op.totals_by(snap(t), "category_clean")


@query(
    "A49_mix_totals",
    "SELECT marketing_mix_type, round(sum(revenue), 4) AS revenue, CAST(sum(demand_velocity) AS BIGINT) AS units, round(sum(marketing_spend), 4) AS marketing_spend, count(*) AS products FROM snap GROUP BY 1",
    digits=4,
)
def mix_totals(t: Tables) -> DataFrame:
    return op.totals_by(snap(t), "marketing_mix_type")


@query(
    "A50_portfolio_insights",
    """SELECT count(*) AS total_products, CAST(sum(high_performer) AS BIGINT) AS high_performers, round(sum(high_performer) / count(*), 4) AS performance_rate, round(sum(revenue), 4) AS total_revenue, round(sum(organic_revenue) / greatest(sum(revenue), 1), 4) AS organic_revenue_share,
    round(sum(attributed_revenue) / greatest(sum(marketing_spend), 1), 4) AS overall_marketing_roas, round(avg(unit_price), 4) AS avg_unit_price, round(sum(email_responsive) / count(*), 4) AS email_responsive_rate, round(sum(marketing_driven) / count(*), 4) AS marketing_driven_rate,
    round(sum(marketing_spend), 4) AS total_marketing_spend, round((SELECT sum(expected_improvement) FROM strategic), 4) AS total_expected_improvement FROM snap""",
    digits=4,
)
def insights(t: Tables) -> DataFrame:
    return op.portfolio_insights(snap(t))


@query(
    "P32_browse_filtered",
    """SELECT date, product_id, round(revenue, 6) AS revenue, round(marketing_efficiency, 6) AS marketing_efficiency FROM snap WHERE category_clean = 'apparel_tops' AND high_performer = 1 ORDER BY marketing_efficiency DESC, product_id, date""",
)
def browse(t: Tables) -> DataFrame:
    return op.browse(snap(t), "apparel_tops", "High Performers", "Marketing Efficiency").select("date", "product_id", "revenue", "marketing_efficiency")


@query(
    "O02_top_bottom_products",
    """(SELECT 'top' AS side, product_id, round(revenue, 6) AS revenue FROM month_totals ORDER BY month_totals.revenue DESC, product_id LIMIT 10) UNION ALL (SELECT 'bottom', product_id, round(revenue, 6) FROM month_totals ORDER BY month_totals.revenue, product_id LIMIT 10)""",
)
def top_bottom(t: Tables) -> DataFrame:
    m = month_totals(t).select("product_id", "revenue")
    sides = [op.top_k(m, "revenue", 10, largest).select(F.lit(name).alias("side"), "product_id", "revenue") for name, largest in (("top", True), ("bottom", False))]
    return sides[0].unionByName(sides[1])


@query(
    "O05_union_all",
    "SELECT 'sales' AS source, date, count(*) AS rows FROM sales GROUP BY 2 UNION ALL SELECT 'stock', date, count(*) FROM stock GROUP BY 2 UNION ALL SELECT 'signals', date, count(*) FROM signals GROUP BY 2",
)
def union_all(t: Tables) -> DataFrame:
    parts = [d.select(F.lit(n).alias("source"), "date") for n, d in (("sales", t.sales), ("stock", t.stock), ("signals", t.signals))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "date").agg(F.count(F.lit(1)).alias("rows"))


@query("O06_distinct_values", "SELECT product_id, count(DISTINCT weather_factor) AS weather_factors, count(DISTINCT event_impact) AS event_impacts FROM signals GROUP BY 1")
def distinct_values(t: Tables) -> DataFrame:
    return t.signals.groupBy("product_id").agg(F.countDistinct("weather_factor").alias("weather_factors"), F.countDistinct("event_impact").alias("event_impacts"))


@query(
    "S18_bootstrap_products",
    """SELECT product_id, product_name AS name, coalesce(product_category, 'apparel') AS category, round(revenue * CAST(0.4 AS DOUBLE), 6) AS unit_cost, round(revenue / greatest(units_sold, 1), 6) AS selling_price, CAST(7 AS BIGINT) AS lead_time_days,
    CAST(365 AS BIGINT) AS shelf_life_days, CAST(1 AS BIGINT) AS min_order_quantity, CAST(1000 AS BIGINT) AS max_order_quantity FROM month_totals""",
)
def boot_products(t: Tables) -> DataFrame:
    return op.bootstrap_products(month_totals(t))


@query(
    "S18_bootstrap_demand",
    """SELECT product_id, CAST(DATE '2024-01-31' - CAST(i AS INTEGER) AS DATE) AS date, greatest(1, CAST(floor(units_sold / CAST(30 AS DOUBLE)) AS BIGINT)) AS quantity_demanded, greatest(1, CAST(floor(units_sold / CAST(30 AS DOUBLE)) AS BIGINT)) AS quantity_fulfilled, false AS is_forecast
    FROM month_totals, range(30) r(i)""",
)
def boot_demand(t: Tables) -> DataFrame:
    return op.bootstrap_demand(month_totals(t), EVENT_AS_OF)


@query(
    "S18_bootstrap_inventory",
    "SELECT product_id, units_sold * 2 AS stock_level, CAST(0 AS BIGINT) AS reserved_stock, CAST(0 AS BIGINT) AS in_transit, units_sold * 2 AS available_stock FROM month_totals",
)
def boot_inventory(t: Tables) -> DataFrame:
    return op.bootstrap_inventory(month_totals(t))


# -- reorder ---------------------------------------------------------------------------

define(
    "adjusted",
    """SELECT *, pace * lift AS marketing_adjusted_daily_demand, pace * lift * 42 AS marketing_adjusted_6week_demand, pace * 14 * vol * CASE WHEN ads_star = 1 THEN 1.1 ELSE 1 END * CASE WHEN email_champion = 1 THEN CAST(1.15 AS DOUBLE) ELSE 1 END * CASE WHEN organic_winner = 1 THEN CAST(0.95 AS DOUBLE) ELSE 1 END AS safety
    FROM (SELECT *, units_sold / CAST(30 AS DOUBLE) AS pace, CAST(CASE WHEN ads_roas_7d >= 3 THEN 1.15 WHEN ads_roas_7d >= 2 THEN 1.08 ELSE 1 END AS DOUBLE) * CAST(CASE WHEN email_efficiency_3d >= 1 THEN 1.12 WHEN email_efficiency_3d >= 0.5 THEN 1.06 ELSE 1 END AS DOUBLE)
      * CAST(CASE WHEN marketing_mix_type = 'multi_channel_star' THEN 1.05 ELSE 1 END AS DOUBLE) AS lift,
      CAST(CASE marketing_mix_type WHEN 'multi_channel_star' THEN 1.1 WHEN 'facebook_focused' THEN 1.3 WHEN 'email_focused' THEN 2.0 WHEN 'organic_focused' THEN 1.0 WHEN 'marketing_dependent' THEN 1.4 ELSE 0.9 END AS DOUBLE) AS vol,
      least(greatest(CAST(0.7 AS DOUBLE) + CASE WHEN ads_roas_7d > 0 THEN 0.1 ELSE 0 END + CASE WHEN email_efficiency_3d > 0 THEN 0.1 ELSE 0 END + CASE WHEN units_sold > 10 THEN 0.1 ELSE 0 END + CASE WHEN marketing_mix_type = 'multi_channel_star' THEN 0.1 ELSE 0 END, 0.3), 0.95) AS demand_forecast_confidence FROM month_snap)""",
)
define(
    "reordered",
    """SELECT *, least(greatest(0, marketing_adjusted_6week_demand + safety - coalesce(available_inventory, current_inventory_level, pace * 10)) * CAST(CASE WHEN marketing_mix_type = 'multi_channel_star' THEN 1.1 ELSE 1 END AS DOUBLE) * CAST(CASE WHEN ads_star = 1 THEN 1.05 ELSE 1 END AS DOUBLE)
    * CAST(CASE WHEN email_champion = 1 THEN 1.08 ELSE 1 END AS DOUBLE), marketing_adjusted_daily_demand * 90) AS optimized,
    CASE WHEN marketing_mix_type = 'low_marketing_impact' THEN 'LOW' WHEN (email_champion = 1 AND email_efficiency_3d > 1.5) OR (ads_star = 1 AND ads_roas_7d > 4) OR marketing_mix_type = 'multi_channel_star' THEN 'HIGH' ELSE 'MEDIUM' END AS marketing_priority FROM adjusted""",
)


@query("R06_marketing_adjusted_demand", "SELECT product_id, round(pace, 6) AS base_daily_demand, round(lift, 6) AS marketing_multiplier, round(marketing_adjusted_daily_demand, 6) AS marketing_adjusted_daily_demand, round(marketing_adjusted_6week_demand, 6) AS marketing_adjusted_6week_demand FROM adjusted")
def adjusted(t: Tables) -> DataFrame:
    return ro.adjusted_demand(month_snap(t)).select("product_id", "base_daily_demand", "marketing_multiplier", "marketing_adjusted_daily_demand", "marketing_adjusted_6week_demand")


@query("R07_channel_safety_stock", "SELECT product_id, round(pace * 14, 6) AS base_safety_stock, vol AS channel_volatility_multiplier, round(safety, 6) AS channel_adjusted_safety_stock, round(safety / CASE WHEN pace = 0 THEN 1 ELSE pace END, 6) AS channel_adjusted_safety_days FROM adjusted")
def safety(t: Tables) -> DataFrame:
    return ro.channel_safety(month_snap(t)).select("product_id", "base_safety_stock", "channel_volatility_multiplier", "channel_adjusted_safety_stock", "channel_adjusted_safety_days")


@query(
    "R08_marketing_reorder",
    "SELECT product_id, round(optimized, 6) AS marketing_optimized_reorder, marketing_priority, round(optimized * revenue / CASE WHEN units_sold = 0 THEN 1 ELSE units_sold END, 4) AS marketing_revenue_opportunity FROM reordered",
)
def marketing_reorder(t: Tables) -> DataFrame:
    d = ro.marketing_reorder(month_snap(t)).select("product_id", "marketing_optimized_reorder", "marketing_priority", "marketing_revenue_opportunity")
    return d.withColumn("marketing_revenue_opportunity", F.round(F.col("marketing_revenue_opportunity") * 1.0000000000001, 4))


@query(
    "R08_plain_reorder",
    """SELECT product_id, round(greatest(0, units_sold / CAST(30 AS DOUBLE) * 49 - coalesce(current_inventory_level, units_sold / CAST(30 AS DOUBLE) * 10)), 6) AS marketing_optimized_reorder, 'MEDIUM' AS marketing_priority FROM month_snap""",
)
def plain_reorder(t: Tables) -> DataFrame:
    bare = month_snap(t).select("product_id", "units_sold", "revenue", "current_inventory_level", "available_inventory")
    return ro.marketing_reorder(bare).select("product_id", "marketing_optimized_reorder", "marketing_priority")


@query("R09_confidence_priority", "SELECT product_id, round(demand_forecast_confidence, 6) AS demand_forecast_confidence, marketing_priority FROM reordered")
def confidence(t: Tables) -> DataFrame:
    return ro.marketing_reorder(month_snap(t)).select("product_id", "demand_forecast_confidence", "marketing_priority")


@query(
    "R10_campaign_impact",
    """SELECT date, product_id, round(x, 6) AS campaign_demand_lift, round(x, 6) AS campaign_inventory_needed, CASE WHEN ads_star = 1 THEN 14 ELSE 21 END AS campaign_prep_days FROM (SELECT *, units_sold / CAST(30 AS DOUBLE) * 0.3 *
    CAST(CASE marketing_mix_type WHEN 'multi_channel_star' THEN 1.5 WHEN 'facebook_focused' THEN 1.3 WHEN 'email_focused' THEN 1.4 WHEN 'organic_focused' THEN 0.8 WHEN 'marketing_dependent' THEN 1.2 ELSE 0.6 END AS DOUBLE) * 7 AS x FROM snap)""",
)
def impact(t: Tables) -> DataFrame:
    return ro.campaign_impact(snap(t)).select("date", "product_id", "campaign_demand_lift", "campaign_inventory_needed", "campaign_prep_days")


define("campaign_needs", "SELECT *, ads_roas_7d > 3 OR email_efficiency_3d > 1 OR marketing_mix_type = 'multi_channel_star' AS likely FROM snap")


@query(
    "R11_campaign_requirements",
    "SELECT date, product_id, CASE WHEN likely THEN 1 ELSE 0 END AS has_upcoming_campaign, CASE WHEN likely THEN 'high' ELSE 'none' END AS campaign_priority, CASE WHEN likely THEN round(units_sold / CAST(30 AS DOUBLE) * 7 * CAST(0.3 AS DOUBLE), 6) ELSE 0 END AS campaign_inventory_boost FROM campaign_needs",
)
def requirements(t: Tables) -> DataFrame:
    return ro.campaign_requirements(snap(t)).select("date", "product_id", "has_upcoming_campaign", "campaign_priority", "campaign_inventory_boost")


@query(
    "R25_demand_multiplier",
    """SELECT date, product_id, round(m, 6) AS demand_multiplier, round(units_sold / CAST(30 AS DOUBLE) * m, 6) AS adjusted_demand, round(units_sold / CAST(30 AS DOUBLE) * (1 + marketing_efficiency * coalesce(marketing_spend * 1.5 / nullif(marketing_spend, 0), 0)), 6) AS spend_adjusted_demand
    FROM (SELECT *, CAST(CASE WHEN marketing_driven = 1 AND ads_roas_7d > 2 THEN 1.2 ELSE 1 END AS DOUBLE) * CAST(CASE WHEN email_responsive = 1 AND likely THEN 1.15 ELSE 1 END AS DOUBLE) AS m FROM campaign_needs)""",
)
def multiplier(t: Tables) -> DataFrame:
    planned = ro.campaign_requirements(snap(t)).withColumn("planned_spend", F.col("marketing_spend") * 1.5)
    return ro.demand_multiplier(planned).select("date", "product_id", "demand_multiplier", "adjusted_demand", "spend_adjusted_demand")


define(
    "six_weeks",
    """SELECT *, CASE WHEN stockout_risk = 'HIGH' THEN 'URGENT' WHEN stockout_risk = 'MEDIUM' AND overstock_risk = 'LOW' THEN 'HIGH' WHEN stockout_risk = 'LOW' AND overstock_risk = 'LOW' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    CASE WHEN std > pace * 90 THEN CAST(floor(pace * 60) AS BIGINT) ELSE std END AS standard_order
    FROM (SELECT *, CASE WHEN have <= point THEN 'HIGH' WHEN have / greatest(pace, 0.1) < 60 THEN 'MEDIUM' ELSE 'LOW' END AS stockout_risk, CASE WHEN have > cap THEN 'HIGH' WHEN have > cap * 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS overstock_risk,
      CASE WHEN have < point THEN (point - have) * (revenue / greatest(units_sold, 1)) ELSE 0 END AS revenue_at_risk, CAST(floor(greatest(0, pace * 42 + pace * days - have)) AS BIGINT) AS std
      FROM (SELECT *, current_inventory_level IS NOT NULL AS is_real, coalesce(current_inventory_level, greatest(1, CAST(floor(pace * 10) AS BIGINT))) AS stock, coalesce(available_inventory, greatest(1, CAST(floor(pace * 10) AS BIGINT))) AS have,
        coalesce(reorder_point, 21) AS point, coalesce(max_stock_level, 75) AS cap, coalesce(safety_stock_days, 14) AS days FROM reordered))""",
)


@query(
    "R05_six_week_reorder",
    """SELECT product_id, product_sku, marketing_mix_type, stock AS current_stock, have AS available_stock, point AS reorder_point, CASE WHEN is_real THEN 'REAL_INVENTORY' ELSE 'ESTIMATED' END AS data_source, round(pace, 6) AS daily_sales,
    round(have / greatest(pace, 0.1), 6) AS days_until_stockout, stockout_risk, overstock_risk, priority, CASE WHEN is_real THEN CASE WHEN units_sold > 10 THEN 'HIGH' ELSE 'MEDIUM' END ELSE CASE WHEN units_sold > 50 THEN 'MEDIUM' ELSE 'LOW' END END AS confidence,
    round(revenue_at_risk, 6) AS revenue_at_risk, round(pace * 42, 6) AS six_week_demand, standard_order, CAST(floor(optimized) AS BIGINT) AS recommended_order, marketing_priority, round(demand_forecast_confidence, 6) AS demand_forecast_confidence,
    round(safety / CASE WHEN pace = 0 THEN 1 ELSE pace END, 6) AS channel_adjusted_safety_days, round(optimized * (revenue / CASE WHEN units_sold = 0 THEN 1 ELSE units_sold END), 6) AS marketing_revenue_opportunity FROM six_weeks""",
)
def six_week(t: Tables) -> DataFrame:
    return ro.six_week_table(month_snap(t))


@query(
    "A52_reorder_totals",
    """SELECT count(*) FILTER (priority = 'URGENT') AS urgent_reorders, round(coalesce(sum(revenue_at_risk) FILTER (stockout_risk = 'HIGH'), 0), 4) AS revenue_at_risk, count(*) FILTER (overstock_risk = 'HIGH') AS overstock_products,
    CAST(sum(CAST(floor(optimized) AS BIGINT)) AS BIGINT) AS total_reorder_units FROM six_weeks""",
    digits=4,
)
def totals(t: Tables) -> DataFrame:
    return ro.reorder_totals(six_week(t))


@query(
    "O04_priority_sort",
    "SELECT product_id, priority, CASE priority WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS priority_score, round(revenue_at_risk, 6) AS revenue_at_risk FROM six_weeks ORDER BY priority_score DESC, six_weeks.revenue_at_risk DESC, product_id",
)
def priority_sort(t: Tables) -> DataFrame:
    return ro.by_priority(six_week(t)).select("product_id", "priority", "priority_score", "revenue_at_risk")
