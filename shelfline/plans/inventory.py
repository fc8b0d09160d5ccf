"""Inventory model and unified tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as attr
from ..operators import inventory as op
from ..sources.tables import EVENT_AS_OF, ORDER_AS_OF, Tables
from .registry import query
from .sqltext import EV, OD, define


def _m(x: str, d: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,4)), {d}) AS DOUBLE)"


_RULES = """CAST(CASE lower(category) WHEN 'apparel_tops' THEN 14 WHEN 'apparel_bottoms' THEN 21 WHEN 'accessories' THEN 28 ELSE 21 END AS BIGINT) AS reorder_point,
    CAST(CASE lower(category) WHEN 'apparel_tops' THEN 50 WHEN 'apparel_bottoms' THEN 30 WHEN 'accessories' THEN 20 ELSE 30 END AS BIGINT) AS reorder_quantity,
    CAST(CASE lower(category) WHEN 'apparel_tops' THEN 100 WHEN 'apparel_bottoms' THEN 75 WHEN 'accessories' THEN 50 ELSE 75 END AS BIGINT) AS max_stock_level,
    CAST(CASE lower(category) WHEN 'apparel_tops' THEN 5 WHEN 'apparel_bottoms' THEN 3 WHEN 'accessories' THEN 2 ELSE 3 END AS BIGINT) AS min_stock_level"""

define(
    "recent_sales",
    f"""SELECT product_id, CAST(sum(quantity) AS BIGINT) AS qty_90d, sum(price * quantity) FILTER (order_date >= {OD} - 30) AS revenue_30d
    FROM shop_orders JOIN line_items USING (order_id) WHERE order_date >= {OD} - 90 AND cancelled_at IS NULL GROUP BY 1""",
)
define(
    "revenue_ranks",
    "SELECT product_id, revenue_30d, percent_rank() OVER (ORDER BY revenue_30d DESC) * 100 AS monthly_revenue_rank FROM recent_sales WHERE revenue_30d IS NOT NULL",
)
define(
    "stock_file",
    f"""SELECT sku AS product_sku, product_id, name AS product_name, category, inventory_quantity AS current_inventory_level, CAST(0 AS BIGINT) AS reserved_inventory, inventory_quantity AS available_inventory,
    reorder_point, reorder_quantity, max_stock_level, min_stock_level, CAST(42 AS BIGINT) AS lead_time_days, CAST(14 AS BIGINT) AS safety_stock_days, unit_cost, selling_price,
    {_m('(selling_price - unit_cost) / nullif(selling_price, 0) * 100')} AS profit_margin_percentage, {_m('selling_price - unit_cost')} AS profit_per_unit, {_m('inventory_quantity * unit_cost')} AS inventory_value,
    'Unknown' AS supplier_name, coalesce(qty_90d, 0) / CAST(90 AS DOUBLE) AS average_daily_sales,
    CASE WHEN coalesce(qty_90d, 0) > 0 THEN {_m('inventory_quantity / (qty_90d / CAST(90 AS DOUBLE))', 1)} ELSE 999 END AS days_of_stock_remaining,
    CASE WHEN inventory_quantity <= reorder_point THEN 'URGENT' WHEN inventory_quantity <= reorder_point * 1.5 THEN 'HIGH' WHEN inventory_quantity <= reorder_point * 2 THEN 'MEDIUM' ELSE 'LOW' END AS reorder_urgency,
    CASE WHEN inventory_quantity > max_stock_level THEN 'HIGH' WHEN inventory_quantity > max_stock_level * 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS overstock_risk, CAST(1.1 AS DOUBLE) AS seasonality_factor,
    CASE WHEN coalesce(monthly_revenue_rank, 100) <= 20 THEN 'A' WHEN coalesce(monthly_revenue_rank, 100) <= 50 THEN 'B' ELSE 'C' END AS abc_classification, coalesce(monthly_revenue_rank, 100) AS monthly_revenue_rank
    FROM (SELECT p.* EXCLUDE (lead_time_days), {_RULES}, qty_90d, monthly_revenue_rank FROM products p LEFT JOIN recent_sales s ON s.product_id = p.product_id LEFT JOIN revenue_ranks r ON r.product_id = p.product_id
      WHERE status = 'active' AND sku IS NOT NULL)""",
)
_INV = """product_sku, product_id, product_name, category, current_inventory_level, reserved_inventory, available_inventory, reorder_point, reorder_quantity, max_stock_level, min_stock_level, lead_time_days,
    safety_stock_days, round(unit_cost, 6) AS unit_cost, selling_price, profit_margin_percentage, profit_per_unit, inventory_value, supplier_name, round(average_daily_sales, 6) AS average_daily_sales, days_of_stock_remaining,
    reorder_urgency, overstock_risk, seasonality_factor, abc_classification, round(monthly_revenue_rank, 6) AS monthly_revenue_rank"""


def inventory(t: Tables) -> DataFrame:
    return op.current_inventory(t.products, t.shop_orders, t.line_items, ORDER_AS_OF)


@query("R01_current_inventory", f"SELECT {_INV} FROM stock_file")
def current_inventory(t: Tables) -> DataFrame:
    return inventory(t)


@query("A42_recent_sales", "SELECT product_id, qty_90d, round(revenue_30d, 4) AS revenue_30d FROM recent_sales", digits=4)
def recent(t: Tables) -> DataFrame:
    return op.recent_sales(t.shop_orders, t.line_items, ORDER_AS_OF)


@query("W01_revenue_percent_rank", "SELECT product_id, round(monthly_revenue_rank, 6) AS monthly_revenue_rank FROM revenue_ranks")
def ranks(t: Tables) -> DataFrame:
    return op.revenue_ranks(op.recent_sales(t.shop_orders, t.line_items, ORDER_AS_OF)).select("product_id", "monthly_revenue_rank")


@query(
    "P22_margins",
    f"""SELECT product_id, {_m('(selling_price - unit_cost) / nullif(selling_price, 0) * 100')} AS profit_margin_percentage, {_m('selling_price - unit_cost')} AS profit_per_unit,
    {_m('inventory_quantity * unit_cost')} AS inventory_value FROM products""",
)
def margins(t: Tables) -> DataFrame:
    return op.margins(t.products).select("product_id", "profit_margin_percentage", "profit_per_unit", "inventory_value")


@query("P23_category_rules", f"SELECT product_id, {_RULES}, CAST(42 AS BIGINT) AS lead_time_days, CAST(14 AS BIGINT) AS safety_stock_days FROM products")
def rules(t: Tables) -> DataFrame:
    return op.stock_rules(t.products).select("product_id", *op.RULE_NAMES, "lead_time_days", "safety_stock_days")


@query(
    "P24_season_factor",
    """SELECT order_date, CAST(CASE WHEN extract(month FROM order_date) IN (11, 12, 1) THEN 1.3 WHEN extract(month FROM order_date) IN (6, 7, 8) THEN 1.1 WHEN extract(month FROM order_date) IN (9, 10) THEN 1.2 ELSE 1 END AS DOUBLE) AS seasonality_factor,
    count(*) AS orders FROM shop_orders GROUP BY 1, 2""",
)
def season(t: Tables) -> DataFrame:
    return t.shop_orders.groupBy("order_date", op.season_factor(F.col("order_date")).alias("seasonality_factor")).agg(F.count(F.lit(1)).alias("orders"))


@query("P25_stock_status", "SELECT product_sku, days_of_stock_remaining, reorder_urgency, overstock_risk, abc_classification FROM stock_file")
def status(t: Tables) -> DataFrame:
    return inventory(t).select("product_sku", "days_of_stock_remaining", "reorder_urgency", "overstock_risk", "abc_classification")


@query(
    "P26_abc_ascending",
    """SELECT product_id, round(p, 6) AS revenue_percentile, CASE WHEN p >= 80 THEN 'A' WHEN p >= 50 THEN 'B' ELSE 'C' END AS abc_classification
    FROM (SELECT product_id, percent_rank() OVER (ORDER BY revenue_30d) * 100 AS p FROM recent_sales WHERE revenue_30d IS NOT NULL)""",
)
def abc_up(t: Tables) -> DataFrame:
    return op.abc_ascending(op.recent_sales(t.shop_orders, t.line_items, ORDER_AS_OF))


@query(
    "P33_velocity_trend",
    f"""SELECT product_id, qty_recent, qty_before, round(qty_recent / nullif(qty_before, 0), 6) AS sales_trend, CASE WHEN qty_recent / nullif(qty_before, 0) > 1.1 THEN 'increasing' WHEN qty_recent / nullif(qty_before, 0) < 0.9 THEN 'decreasing' ELSE 'stable' END AS sales_velocity_trend
    FROM (SELECT product_id, CAST(coalesce(sum(quantity) FILTER (order_date >= {OD} - 30), 0) AS BIGINT) AS qty_recent, CAST(coalesce(sum(quantity) FILTER (order_date < {OD} - 30), 0) AS BIGINT) AS qty_before
      FROM shop_orders JOIN line_items USING (order_id) WHERE order_date >= {OD} - 60 AND cancelled_at IS NULL GROUP BY 1)""",
)
def velocity(t: Tables) -> DataFrame:
    return op.velocity_trend(t.shop_orders, t.line_items, ORDER_AS_OF)


@query(
    "J08_active_variants",
    "SELECT product_id, p.sku, p.name, category, status, vendor FROM products p WHERE status = 'active' AND sku IS NOT NULL",
)
def variants(t: Tables) -> DataFrame:
    v = t.products.select("product_id", "sku", "vendor")
    return op.active_variants(v, t.products).select("product_id", "sku", "name", "category", "status", "vendor")


@query(
    "J09_inventory_with_sales",
    """SELECT p.product_id, inventory_quantity, qty_90d, round(monthly_revenue_rank, 6) AS monthly_revenue_rank FROM products p LEFT JOIN recent_sales s ON s.product_id = p.product_id
    LEFT JOIN revenue_ranks r ON r.product_id = p.product_id""",
)
def with_sales(t: Tables) -> DataFrame:
    s = op.recent_sales(t.shop_orders, t.line_items, ORDER_AS_OF)
    return op.with_recent_sales(t.products.select("product_id", "inventory_quantity"), s)


_PERF = """p.date, p.product_id, p.product_name, p.product_category, p.product_sku, units_sold, revenue, orders, avg_selling_price, ads_spend, ads_attributed_revenue, ads_attributed_units,
    email_attributed_revenue, email_attributed_units, total_marketing_spend, total_attributed_revenue, organic_revenue, organic_units"""
define(
    "stocked",
    f"""SELECT {_PERF}, emails_sent, coalesce(ads_7d, ads_attributed_revenue) AS ads_7d_attributed_revenue, coalesce(email_3d, email_attributed_revenue) AS email_3d_attributed_revenue,
    coalesce(i.current_inventory_level, 0) AS current_inventory_level, coalesce(i.available_inventory, 0) AS available_inventory, coalesce(i.reserved_inventory, 0) AS reserved_inventory,
    coalesce(i.reorder_point, 21) AS reorder_point, coalesce(i.reorder_quantity, 30) AS reorder_quantity, coalesce(i.max_stock_level, 75) AS max_stock_level, coalesce(i.min_stock_level, 3) AS min_stock_level,
    coalesce(i.lead_time_days, 42) AS lead_time_days, coalesce(i.safety_stock_days, 14) AS safety_stock_days, coalesce(i.unit_cost, revenue * CAST(0.6 AS DOUBLE)) AS unit_cost, coalesce(i.selling_price, avg_selling_price) AS selling_price,
    coalesce(i.profit_margin_percentage, 40) AS profit_margin_percentage, coalesce(i.profit_per_unit, avg_selling_price * CAST(0.4 AS DOUBLE)) AS profit_per_unit, coalesce(i.inventory_value, 0) AS inventory_value,
    coalesce(i.average_daily_sales, units_sold / CAST(30 AS DOUBLE)) AS average_daily_sales, coalesce(i.days_of_stock_remaining, 999) AS days_of_stock_remaining, coalesce(i.reorder_urgency, 'UNKNOWN') AS reorder_urgency,
    coalesce(i.overstock_risk, 'UNKNOWN') AS overstock_risk, coalesce(i.abc_classification, 'C') AS abc_classification, coalesce(i.seasonality_factor, 1) AS seasonality_factor,
    CASE WHEN i.product_sku IS NOT NULL THEN 'inventory_data_available' ELSE 'inventory_data_missing' END AS inventory_data_status, units_sold / CAST(30 AS DOUBLE) AS pace
    FROM performance p LEFT JOIN stock_file i ON i.product_sku = p.product_sku
    LEFT JOIN (SELECT product_id, date, sum(ads_7d_revenue) AS ads_7d, sum(email_3d_revenue) AS email_3d FROM credit_windows GROUP BY 1, 2) w ON w.product_id = p.product_id AND w.date = p.date
    WHERE p.date >= {EV} - 30""",
)
_DOUBLES = [
    "revenue", "avg_selling_price", "ads_spend", "ads_attributed_revenue", "email_attributed_revenue", "total_marketing_spend", "total_attributed_revenue", "organic_revenue",
    "unit_cost", "selling_price", "profit_margin_percentage", "profit_per_unit", "inventory_value", "average_daily_sales", "days_of_stock_remaining", "seasonality_factor",
]
_REST = """date, product_id, product_name, product_category, product_sku, units_sold, orders, ads_attributed_units, email_attributed_units, organic_units, current_inventory_level, available_inventory,
    reserved_inventory, reorder_point, reorder_quantity, max_stock_level, min_stock_level, lead_time_days, safety_stock_days, reorder_urgency, overstock_risk, abc_classification, inventory_data_status"""
_OUT = _REST + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _DOUBLES)
_ORDER = f"greatest(0, {_m('pace * 42 * seasonality_factor + pace * safety_stock_days - available_inventory', 0)})"
_RISK = f"CASE WHEN days_of_stock_remaining < 42 THEN {_m('(42 - days_of_stock_remaining) * pace * selling_price')} ELSE 0 END"
_KEEP = "WHERE units_sold > 0 OR current_inventory_level > 0"


@query("J07_performance_with_stock", f"SELECT {_OUT} FROM stocked")
def with_stock(t: Tables) -> DataFrame:
    return op.with_inventory(t.performance, inventory(t))


@query("R02_unified_inventory", f"SELECT {_OUT}, {_ORDER} AS recommended_order_quantity, {_RISK} AS revenue_at_risk FROM stocked {_KEEP}")
def unified(t: Tables) -> DataFrame:
    return op.unified(t.performance, inventory(t), EVENT_AS_OF)


def _windows(t: Tables) -> DataFrame:
    w = attr.window_credit(t.conversions, t.touches)
    return w.groupBy("product_id", "date").agg(F.sum("ads_7d_revenue").alias("ads_7d"), F.sum("email_3d_revenue").alias("email_3d"))


@query(
    "R03_unified_marketing_inventory",
    f"""SELECT {_OUT}, emails_sent, round(ads_7d_attributed_revenue, 6) AS ads_7d_attributed_revenue, round(email_3d_attributed_revenue, 6) AS email_3d_attributed_revenue,
    CASE WHEN ads_spend > 0 OR emails_sent > 0 THEN 'marketing_data_available' ELSE 'marketing_data_missing' END AS marketing_data_status,
    {_ORDER} AS recommended_order_quantity, {_RISK} AS revenue_at_risk FROM stocked {_KEEP}""",
)
def unified_marketing(t: Tables) -> DataFrame:
    return op.unified_marketing(t.performance, _windows(t), inventory(t), EVENT_AS_OF)


@query(
    "R04_unified_priority",
    f"""SELECT {_OUT}, {_ORDER} AS recommended_order_quantity, {_m('pace * 42 * seasonality_factor', 1)} AS six_week_demand_forecast,
    CASE WHEN available_inventory <= reorder_point THEN 'URGENT' WHEN available_inventory <= reorder_point * 1.5 THEN 'HIGH' WHEN available_inventory <= reorder_point * 2 THEN 'MEDIUM' ELSE 'LOW' END AS stock_priority FROM stocked""",
)
def unified_priority(t: Tables) -> DataFrame:
    return op.unified_priority(t.performance, inventory(t), EVENT_AS_OF)


@query(
    "P31_attribution_window_choice",
    "SELECT product_id, date, round(ads_7d_attributed_revenue, 6) AS ads_7d_attributed_revenue, round(email_3d_attributed_revenue, 6) AS email_3d_attributed_revenue FROM stocked",
)
def window_choice(t: Tables) -> DataFrame:
    d = t.performance.join(_windows(t), ["product_id", "date"], "left")
    return d.select(
        "product_id",
        "date",
        F.coalesce("ads_7d", "ads_attributed_revenue").alias("ads_7d_attributed_revenue"),
        F.coalesce("email_3d", "email_attributed_revenue").alias("email_3d_attributed_revenue"),
    )


@query(
    "O01_sorted_by_urgency",
    """SELECT product_sku, reorder_urgency, days_of_stock_remaining FROM stock_file
    ORDER BY CASE reorder_urgency WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, days_of_stock_remaining, product_sku""",
)
def sorted_inventory(t: Tables) -> DataFrame:
    return op.by_urgency(inventory(t)).select("product_sku", "reorder_urgency", "days_of_stock_remaining")


@query(
    "O01_sorted_by_priority",
    """SELECT product_id, date, reorder_urgency, round(revenue, 6) AS revenue, days_of_stock_remaining FROM stocked WHERE units_sold > 0 OR current_inventory_level > 0
    ORDER BY CASE reorder_urgency WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, revenue DESC, days_of_stock_remaining, product_id, date""",
)
def sorted_unified(t: Tables) -> DataFrame:
    return op.by_priority(op.unified(t.performance, inventory(t), EVENT_AS_OF)).select("product_id", "date", "reorder_urgency", "revenue", "days_of_stock_remaining")
