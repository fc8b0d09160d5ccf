"""Current inventory model and its join with product performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import percent_rank_of
from ..functions.scalar import above, at_least, cases, lookup, money, ratio, since, up_to
from .sales import line_revenue

# Stock rules per category (reorder point, reorder quantity, maximum, minimum),
# lead time, safety days, month factors, and the defaults for products without inventory data.
STOCK_RULES = {
    "apparel_tops": (14, 50, 100, 5),
    "apparel_bottoms": (21, 30, 75, 3),
    "accessories": (28, 20, 50, 2),
}
STOCK_RULE_DEFAULT = (21, 30, 75, 3)
RULE_NAMES = ("reorder_point", "reorder_quantity", "max_stock_level", "min_stock_level")
LEAD_TIME_DAYS, SAFETY_DAYS = 42, 14
SEASON_FACTORS = [((11, 12, 1), 1.3), ((6, 7, 8), 1.1), ((9, 10), 1.2)]
ABC_DESCENDING = [(20, "A"), (50, "B")]
ABC_ASCENDING = [(80, "A"), (50, "B")]
NO_SALES_DAYS = 999


def one_decimal(c: Column) -> Column:
    return F.round(c.cast("decimal(18,4)"), 1).cast("double")


def margins(products: DataFrame) -> DataFrame:
    cost, price = F.col("unit_cost"), F.col("selling_price")
    return products.withColumns(
        {
            "profit_margin_percentage": money(ratio(price - cost, price) * 100),
            "profit_per_unit": money(price - cost),
            "inventory_value": money(F.col("inventory_quantity") * cost),
        }
    )


def stock_rules(products: DataFrame) -> DataFrame:
    """Category rules as map literals inside the projection: nothing to join or broadcast."""
    rules = {
        name: lookup(F.lower("category"), {k: v[i] for k, v in STOCK_RULES.items()}, STOCK_RULE_DEFAULT[i]).cast("bigint")
        for i, name in enumerate(RULE_NAMES)
    }
    return products.withColumns(
        {**rules, "lead_time_days": F.lit(LEAD_TIME_DAYS).cast("bigint"), "safety_stock_days": F.lit(SAFETY_DAYS).cast("bigint")}
    )


def season_factor(d: Column) -> Column:
    return cases([(F.month(d).isin(*months), factor) for months, factor in SEASON_FACTORS], 1.0)


def active_variants(variants: DataFrame, products: DataFrame) -> DataFrame:
    """Variants of active products that carry an SKU."""
    return variants.filter(F.col("sku").isNotNull()).join(
        products.filter(F.col("status") == "active").select("product_id", "name", "category", "status"), "product_id"
    )


def recent_sales(orders: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """90-day quantity and 30-day revenue per product from one join; revenue is null without 30-day lines."""
    o = orders.filter(since("order_date", as_of, 90) & F.col("cancelled_at").isNull()).select("order_id", "order_date")
    li = items.select("order_id", "product_id", "quantity", line_revenue().alias("revenue"))
    return (
        o.join(li, "order_id")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("qty_90d"), F.sum(F.when(since("order_date", as_of, 30), F.col("revenue"))).alias("revenue_30d"))
    )


def with_revenue_ranks(sales: DataFrame, descending: bool = True) -> DataFrame:
    """Percent rank (0 to 100) by 30-day revenue; products without such revenue get none."""
    ranked = percent_rank_of(sales, "revenue_30d", "monthly_revenue_rank", descending, beside=["qty_90d"])
    return ranked.withColumn("monthly_revenue_rank", F.col("monthly_revenue_rank") * 100)


def revenue_ranks(sales: DataFrame, descending: bool = True) -> DataFrame:
    return with_revenue_ranks(sales, descending).filter(F.col("revenue_30d").isNotNull())


def abc_ascending(sales: DataFrame) -> DataFrame:
    r = revenue_ranks(sales, descending=False)
    return r.select("product_id", F.col("monthly_revenue_rank").alias("revenue_percentile"), at_least("monthly_revenue_rank", ABC_ASCENDING, "C").alias("abc_classification"))


def stock_status(df: DataFrame) -> DataFrame:
    """Days of stock, urgency, overstock risk and ABC class from joined sales and rank columns."""
    have, point, cap = F.col("available_inventory"), F.col("reorder_point"), F.col("max_stock_level")
    qty = F.coalesce("qty_90d", F.lit(0))
    rank = F.coalesce("monthly_revenue_rank", F.lit(100.0))
    return df.withColumns(
        {
            "average_daily_sales": qty / F.lit(90.0),
            "days_of_stock_remaining": F.when(qty > 0, one_decimal(ratio(have, qty / F.lit(90.0)))).otherwise(float(NO_SALES_DAYS)),
            "reorder_urgency": urgency(have, point),
            "overstock_risk": cases([(have > cap, "HIGH"), (have > cap * 0.8, "MEDIUM")], "LOW"),
            "monthly_revenue_rank": rank,
            "abc_classification": up_to(rank, ABC_DESCENDING, "C"),
        }
    )


def urgency(have: Column, point: Column) -> Column:
    return cases([(have <= point, "URGENT"), (have <= point * 1.5, "HIGH"), (have <= point * 2.0, "MEDIUM")], "LOW")


def urgency_rank(c: Column) -> Column:
    return lookup(c, {"URGENT": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}, 0)


def with_recent_sales(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Products with their sales and rank. Sales without a product are not ranked, so that the join and the ranks read
    the same shuffled totals."""
    sales = sales.filter(F.col("product_id").isNotNull())
    return products.join(with_revenue_ranks(sales).select("product_id", "qty_90d", "monthly_revenue_rank"), "product_id", "left")


def current_inventory(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """The current inventory model: margins, category rules, sales pace, urgency, overstock, ABC."""
    base = products.filter((F.col("status") == "active") & F.col("sku").isNotNull())
    base = stock_rules(margins(base)).withColumns(
        {
            "current_inventory_level": F.coalesce("inventory_quantity", F.lit(0)),
            "available_inventory": F.coalesce("inventory_quantity", F.lit(0)),
            "reserved_inventory": F.lit(0).cast("bigint"),
            "supplier_name": F.lit("Unknown"),
            "seasonality_factor": season_factor(F.lit(as_of).cast("date")),
        }
    )
    d = stock_status(with_recent_sales(base, recent_sales(orders, items, as_of)))
    return d.select(
        F.col("sku").alias("product_sku"), "product_id", F.col("name").alias("product_name"), "category", "current_inventory_level",
        "reserved_inventory", "available_inventory", *RULE_NAMES, "lead_time_days", "safety_stock_days", "unit_cost", "selling_price",
        "profit_margin_percentage", "profit_per_unit", "inventory_value", "supplier_name", "average_daily_sales", "days_of_stock_remaining",
        "reorder_urgency", "overstock_risk", "seasonality_factor", "abc_classification", "monthly_revenue_rank",
    )


def by_urgency(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(urgency_rank(F.col("reorder_urgency")).desc(), F.col("days_of_stock_remaining").asc(), "product_sku")


PERFORMANCE_COLUMNS = (
    "date", "product_id", "product_name", "product_category", "product_sku", "units_sold", "revenue", "orders", "avg_selling_price",
    "ads_spend", "ads_attributed_revenue", "ads_attributed_units", "email_attributed_revenue", "email_attributed_units",
    "total_marketing_spend", "total_attributed_revenue", "organic_revenue", "organic_units",
)


def with_inventory(performance: DataFrame, inventory: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Performance rows with inventory columns on the SKU; defaults where the SKU is unknown."""
    price, revenue, units = F.col("avg_selling_price"), F.col("revenue"), F.col("units_sold")
    default = dict(zip(RULE_NAMES, STOCK_RULE_DEFAULT))
    fill = {
        **{c: F.lit(0).cast("bigint") for c in ("current_inventory_level", "available_inventory", "reserved_inventory")},
        **{c: F.lit(v).cast("bigint") for c, v in default.items()},
        "lead_time_days": F.lit(LEAD_TIME_DAYS).cast("bigint"),
        "safety_stock_days": F.lit(SAFETY_DAYS).cast("bigint"),
        "unit_cost": revenue * 0.6,
        "selling_price": price,
        "profit_margin_percentage": F.lit(40.0),
        "profit_per_unit": price * 0.4,
        "inventory_value": F.lit(0.0),
        "average_daily_sales": units / F.lit(30.0),
        "days_of_stock_remaining": F.lit(float(NO_SALES_DAYS)),
        "reorder_urgency": F.lit("UNKNOWN"),
        "overstock_risk": F.lit("UNKNOWN"),
        "abc_classification": F.lit("C"),
        "seasonality_factor": F.lit(1.0),
    }
    inv = inventory.select(F.col("product_sku"), F.lit(True).alias("in_stock_file"), *[F.col(c).alias(f"inv_{c}") for c in fill])
    d = performance.join(inv, "product_sku", "left")
    return d.select(
        *[c for c in (*PERFORMANCE_COLUMNS, *extra)],
        *[F.coalesce(F.col(f"inv_{c}"), v).alias(c) for c, v in fill.items()],
        F.when(F.col("in_stock_file"), "inventory_data_available").otherwise("inventory_data_missing").alias("inventory_data_status"),
    )


def pace() -> Column:
    return F.col("units_sold") / F.lit(30.0)


def recommended_order() -> Column:
    """max(0, six-week demand with season + safety stock - available), to whole units."""
    need = pace() * LEAD_TIME_DAYS * F.col("seasonality_factor") + pace() * F.col("safety_stock_days") - F.col("available_inventory")
    return F.greatest(F.lit(0.0), F.round(need.cast("decimal(18,4)"), 0).cast("double"))


def revenue_at_risk() -> Column:
    days = F.col("days_of_stock_remaining")
    return F.when(days < LEAD_TIME_DAYS, money((LEAD_TIME_DAYS - days) * pace() * F.col("selling_price"))).otherwise(0.0)


def unified(performance: DataFrame, inventory: DataFrame, as_of: str, days: int = 30, extra: tuple[str, ...] = ()) -> DataFrame:
    """Sales and real inventory in one table: recommended order and revenue at risk per product and day."""
    d = with_inventory(performance.filter(since("date", as_of, days)), inventory, extra)
    d = d.filter((F.col("units_sold") > 0) | (F.col("current_inventory_level") > 0))
    return d.withColumns({"recommended_order_quantity": recommended_order(), "revenue_at_risk": revenue_at_risk()})


def unified_marketing(performance: DataFrame, windows: DataFrame, inventory: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The unified table with windowed attribution (7-day ads, 3-day e-mail, else the default) and a marketing flag."""
    w = windows.select("product_id", "date", "ads_7d", "email_3d")
    p = performance.join(w, ["product_id", "date"], "left").withColumns(
        {
            "ads_7d_attributed_revenue": F.coalesce("ads_7d", "ads_attributed_revenue"),
            "email_3d_attributed_revenue": F.coalesce("email_3d", "email_attributed_revenue"),
        }
    )
    extra = ("ads_7d_attributed_revenue", "email_3d_attributed_revenue", "emails_sent")
    d = unified(p, inventory, as_of, days, extra)
    active = (F.coalesce("ads_spend", F.lit(0.0)) > 0) | (F.coalesce("emails_sent", F.lit(0)) > 0)
    return d.withColumn("marketing_data_status", F.when(active, "marketing_data_available").otherwise("marketing_data_missing"))


def unified_priority(performance: DataFrame, inventory: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Variant of the unified table with a priority from the joined stock and the six-week forecast."""
    d = with_inventory(performance.filter(since("date", as_of, days)), inventory)
    return d.withColumns(
        {
            "stock_priority": urgency(F.col("available_inventory"), F.col("reorder_point")),
            "six_week_demand_forecast": one_decimal(pace() * LEAD_TIME_DAYS * F.col("seasonality_factor")),
            "recommended_order_quantity": recommended_order(),
        }
    )


def by_priority(d: DataFrame) -> DataFrame:
    known = F.when(F.col("reorder_urgency") == "UNKNOWN", "LOW").otherwise(F.col("reorder_urgency"))
    return d.orderBy(urgency_rank(known).desc(), F.desc("revenue"), F.asc("days_of_stock_remaining"), "product_id", "date")


def velocity_trend(orders: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Last 30 days against the 30 before: increasing above 1.1, decreasing below 0.9."""
    o = orders.filter(since("order_date", as_of, 60) & F.col("cancelled_at").isNull()).select("order_id", "order_date")
    recent = since("order_date", as_of, 30)
    g = (
        o.join(items.select("order_id", "product_id", "quantity"), "order_id")
        .groupBy("product_id")
        .agg(
            F.coalesce(F.sum(F.when(recent, F.col("quantity"))), F.lit(0)).alias("qty_recent"),
            F.coalesce(F.sum(F.when(~recent, F.col("quantity"))), F.lit(0)).alias("qty_before"),
        )
    )
    r = ratio("qty_recent", "qty_before")
    return g.select("*", r.alias("sales_trend"), F.when(r < 0.9, "decreasing").otherwise(F.coalesce(above(r, [(1.1, "increasing")]), F.lit("stable"))).alias("sales_velocity_trend"))
