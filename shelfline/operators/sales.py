"""Orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import above, cases, count_if, dow, money, ratio, since, up_to

# Segment, value, velocity and lifecycle thresholds and their labels.
SPEND_SEGMENTS = [(1000, "premium"), (500, "regular")]
RECENCY_STEPS = [(60, "recent"), (180, "at_risk")]
TITLE_WORDS = {
    "apparel_tops": ["shirt", "top"],
    "apparel_bottoms": ["pant", "jean"],
    "footwear": ["shoe", "boot"],
}
SHOP_CHANNEL = "shopify"


def is_settled() -> Column:
    """Paid and not cancelled."""
    return (F.col("financial_status") == "paid") & F.col("cancelled_at").isNull()


def line_revenue() -> Column:
    return F.col("price") * F.col("quantity")


def net_line_revenue() -> Column:
    return line_revenue() - F.col("total_discount")


def spend_segment(c="customer_total_spent") -> Column:
    return above(c, SPEND_SEGMENTS, "budget")


def order_count_segment(c="customer_orders_count", rest=None) -> Column:
    return cases(
        [(F.col(c) == 1, "new_customer"), (F.col(c).between(2, 5), "returning_customer"), (F.col(c) > 5, "loyal_customer")], rest
    )


def order_value_class(c="total_price") -> Column:
    return cases([(F.col(c) < 25, "low_value"), (F.col(c) <= 100, "medium_value"), (F.col(c) > 100, "high_value")])


def line_velocity(c="quantity") -> Column:
    return cases([(F.col(c) > 5, "high_velocity"), (F.col(c) >= 2, "medium_velocity"), (F.col(c) == 1, "low_velocity")])


def category_from_title(c="name") -> Column:
    rules = [(F.lower(c).rlike("|".join(words)), label) for label, words in TITLE_WORDS.items()]
    return cases(rules, "other")


def sales_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Settled orders joined to their lines: one row per line sold.

    Plain inner equi-join; the optimizer broadcasts a side under its size limit, else sorts and
    merges, splitting a hot order at run time.
    """
    o = orders.filter(is_settled()).select(
        "order_id",
        "created_at",
        "order_date",
        "customer_email",
        "shipping_country",
        spend_segment().alias("customer_segment"),
        F.coalesce("source_name", F.lit("web")).alias("fulfillment_method"),
        ratio("total_discounts", "total_price").alias("discount_rate"),
    )
    li = items.select("order_id", "product_id", "quantity", net_line_revenue().alias("revenue"))
    return o.join(li, "order_id")


def sales_feed(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Lines sold in the layout of the sales feed."""
    return sales_lines(orders, items).select(
        F.col("order_date").alias("date"),
        "product_id",
        F.lit(SHOP_CHANNEL).alias("channel"),
        F.col("quantity").alias("quantity_sold"),
        "revenue",
        "customer_segment",
        "fulfillment_method",
        F.col("order_id").alias("source_order_id"),
    )


def daily_sales(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Product sales per day.

    The first line of each order and product is marked, which reuses the join's partitioning on the order, makes the
    order count a plain count and leaves one distinct count (customers). Orders seldom hold a product twice, so a fold
    would keep a hash map of nearly all lines of a task; the marks need one sort, which spills.
    """
    w = Window.partitionBy("order_id", "product_id", "order_date", "customer_email").orderBy("product_id")
    lines = sales_lines(orders, items).select(
        "order_id", "product_id", "order_date", "customer_email", (F.col("customer_segment") == "premium").alias("premium"), "quantity", "revenue", "discount_rate"
    )
    lines = lines.withColumn("first", F.row_number().over(w) == 1)
    unit, premium = ratio("revenue", "quantity"), F.when(F.col("premium"), F.col("revenue")).otherwise(0.0)
    return lines.groupBy(F.col("order_date").alias("sale_date"), "product_id").agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum("revenue").alias("total_revenue"),
        count_if(F.col("first")).alias("order_count"),
        F.countDistinct("customer_email").alias("unique_customers"),
        ratio(F.sum(unit), F.count(unit)).alias("avg_unit_price"),
        F.sum(premium).alias("premium_revenue"),
        ratio(F.sum("discount_rate"), F.count("discount_rate")).alias("avg_discount_rate"),
    )


def customer_value(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Lifetime value per customer; orders folded first, so no distinct count is needed."""
    per_order = (
        sales_lines(orders, items)
        .groupBy("order_id", "customer_email", "order_date")
        .agg(F.sum("revenue").alias("r"), F.count(F.lit(1)).alias("n"))
    )
    return per_order.groupBy("customer_email").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("r").alias("total_spent"),
        ratio(F.sum("r"), F.sum("n")).alias("avg_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.datediff(F.max("order_date"), F.min("order_date")).cast("bigint").alias("customer_lifespan_days"),
        ratio(F.sum("r"), F.count(F.lit(1))).alias("ltv_per_order"),
    )


def order_attributes(orders: DataFrame) -> DataFrame:
    total = F.when(F.col("total_price") >= 0, F.col("total_price"))
    return orders.select(
        "order_id",
        total.alias("total_price_clean"),
        money("total_price").alias("total_price_rounded"),
        "order_date",
        F.hour("created_at").cast("bigint").alias("order_hour"),
        dow("order_date").alias("order_day_of_week"),
        order_count_segment(rest="unknown").alias("customer_segment"),
        order_value_class().alias("order_value_category"),
    )


def order_totals(orders: DataFrame, items: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Recent orders with their line count, units and mean line value. Lines meet the recent orders first and are folded
    where the join has put them, so lines of older orders are neither kept nor shuffled again."""
    keys = ["order_id", "customer_email", "order_date", "order_value", "financial_status"]
    recent = orders.filter(since("order_date", as_of, days)).withColumn("order_value", F.col("total_price")).select(*keys)
    lines = recent.join(items.select("order_id", "quantity", F.lit(1).alias("line")), "order_id", "left")
    joined = lines.groupBy(*keys).agg(F.count("line").alias("items_count"), F.sum("quantity").alias("total_units"))
    return joined.withColumn("avg_item_value", ratio("order_value", "items_count"))


def order_products(orders: DataFrame, items: DataFrame, as_of: str, days: int = 90, span: int = 1000) -> DataFrame:
    """Products bought per recent order as sorted lists, one list per thousand product numbers.

    A list therefore never holds more than `span` entries, however large the order.
    """
    recent = orders.filter(since("order_date", as_of, days)).select("order_id")
    bought = recent.join(items.select("order_id", "product_id"), "order_id").distinct()
    g = bought.groupBy("order_id", F.floor(F.col("product_id") / span).cast("bigint").alias("part")).agg(F.sort_array(F.collect_list("product_id")).alias("p"))
    return g.select("order_id", "part", F.array_join(F.col("p").cast("array<string>"), ",").alias("products_purchased"))


def channel_daily_revenue(sales: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return (
        sales.filter(since("date", as_of, days))
        .groupBy(F.col("date").alias("sale_date"), "channel")
        .agg(F.sum("revenue").alias("total_revenue"), F.count(F.lit(1)).alias("transaction_count"))
    )


def rfm_segments(customers: DataFrame, as_of: str) -> DataFrame:
    """RFM segment, annualised value and churn score per customer profile."""
    today = F.lit(as_of).cast("date")
    c = customers.select(
        "customer_id",
        "total_spent",
        "total_orders",
        F.datediff(today, "last_order_date").cast("bigint").alias("days_since_last_order"),
        F.datediff(today, "first_order_date").cast("bigint").alias("customer_age_days"),
        cases(
            [(since("last_email_open", as_of, 30), "active"), (since("last_email_open", as_of, 90), "declining")], "inactive"
        ).alias("email_engagement_status"),
    )
    quiet, spent, n, mail = (F.col(x) for x in ("days_since_last_order", "total_spent", "total_orders", "email_engagement_status"))
    return c.withColumns(
        {
            "rfm_segment": cases(
                [
                    ((quiet <= 30) & (spent >= 500) & (n >= 5), "champions"),
                    ((quiet <= 60) & (spent >= 300) & (n >= 3), "loyal_customers"),
                    ((quiet <= 30) & (n == 1), "new_customers"),
                    (quiet.between(61, 120) & (spent >= 200), "potential_loyalists"),
                    (quiet.between(121, 180), "at_risk"),
                    (quiet > 180, "cannot_lose_them"),
                ],
                "others",
            ),
            "predicted_annual_clv": F.when(F.col("customer_age_days") > 0, ratio(spent, "customer_age_days") * 365).otherwise(0.0),
            "churn_risk_score": cases(
                [
                    ((quiet > 180) & (mail == "inactive"), 0.9),
                    ((quiet > 120) & (mail == "declining"), 0.7),
                    ((quiet > 90) & (mail == "active"), 0.4),
                    (quiet > 60, 0.2),
                ],
                0.1,
            ),
        }
    )


def lifecycle(orders: DataFrame, attribution: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Customer lifecycle export: order history and channel preference, each side folded per customer first."""
    today = F.lit(as_of).cast("date")
    recent = since("order_date", as_of, 30)
    history = (
        orders.filter(F.col("customer_email").isNotNull() & since("order_date", as_of, days))
        .groupBy("customer_email")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("total_price").alias("spent"),
            F.avg("total_price").alias("avg_value"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            count_if(recent).alias("orders_last_30_days"),
            F.coalesce(F.sum(F.when(recent, F.col("total_price"))), F.lit(0.0)).alias("spent_30"),
        )
    )

    def touched(side: str, channel: str):
        return count_if(F.col(f"{side}_touch_channel") == channel).alias(f"{channel}_{side}_touch_count")

    journeys = attribution.groupBy("customer_email").agg(
        touched("first", "facebook"),
        touched("first", "email"),
        touched("last", "facebook"),
        touched("last", "email"),
        F.avg("journey_duration_hours").alias("hours"),
        F.avg("touchpoint_count").alias("touches"),
        F.sum("ads_attributed_revenue").alias("ads_rev"),
        F.sum("email_attributed_revenue").alias("mail_rev"),
    )
    counts = [f"{c}_{s}_touch_count" for s in ("first", "last") for c in ("facebook", "email")]
    d = history.join(journeys, "customer_email", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    quiet = F.datediff(today, "last_order_date")
    ads, mail = F.col("facebook_first_touch_count"), F.col("email_first_touch_count")
    return d.select(
        F.col("customer_email").alias("email"),
        order_count_segment("total_orders").alias("customer_segment"),
        F.when(F.col("orders_last_30_days") > 0, "active").otherwise(up_to(quiet, RECENCY_STEPS, "churned")).alias("lifecycle_stage"),
        "total_orders",
        money("spent").alias("lifetime_value"),
        money("avg_value").alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        "orders_last_30_days",
        money("spent_30").alias("revenue_last_30_days"),
        *counts,
        F.round(F.coalesce("hours", F.lit(0.0)), 4).alias("avg_journey_duration_hours"),
        F.round(F.coalesce("touches", F.lit(0.0)), 4).alias("avg_touchpoints_per_journey"),
        quiet.cast("bigint").alias("days_since_last_order"),
        F.datediff(today, "first_order_date").cast("bigint").alias("customer_age_days"),
        cases(
            [(ads > mail, "facebook_driven"), (mail > ads, "email_driven"), ((ads == mail) & (ads > 0), "multi_channel")], "organic"
        ).alias("acquisition_channel_preference"),
        money(F.coalesce("ads_rev", F.lit(0.0))).alias("ads_attributed_revenue"),
        money(F.coalesce("mail_rev", F.lit(0.0))).alias("email_attributed_revenue"),
    )


def customer_class(attribution: DataFrame) -> DataFrame:
    """New / returning / loyal per journey from the customer's order count, one aggregate and one join."""
    n = attribution.groupBy("customer_email").agg(F.count("order_id").alias("n_orders"))
    label = cases([(F.col("n_orders") == 1, "new_customer"), (F.col("n_orders").between(2, 5), "returning_customer")], "loyal_customer")
    return attribution.join(n, "customer_email").select("order_id", "customer_email", "date", label.alias("customer_segment"))


def shop_kpis(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("order_date").alias("date")).agg(
        F.sum("total_price").alias("daily_revenue"),
        F.avg("total_price").alias("average_order_value"),
        F.countDistinct(F.when(F.col("customer_orders_count") == 1, F.col("customer_email"))).alias("new_customers"),
        F.avg((F.col("financial_status") == "paid").cast("double")).alias("order_conversion_rate"),
    )


def sales_export(orders: DataFrame, items: DataFrame, products: DataFrame, credit: DataFrame, as_of: str, days: int) -> DataFrame:
    """Daily sales by product and country with attributed and organic revenue.

    `credit` carries one row per order (ads and e-mail revenue). An order's credit is shared
    over its lines by revenue, so joining it does not multiply anything.
    """
    o = orders.filter((F.col("financial_status") == "paid") & since("order_date", as_of, days) & (F.col("order_date") < F.lit(as_of).cast("date")))
    o = o.select("order_id", "order_date", "customer_email", "customer_orders_count", "shipping_country")
    per_order = items.select("order_id", "product_id", "quantity", "price", line_revenue().alias("rev"), "total_discount")
    # The total of an order is summed over its joined lines, which are together already: one pass over the line table.
    lines = o.join(per_order, "order_id").withColumn("order_rev", F.sum("rev").over(Window.partitionBy("order_id"))).join(credit, "order_id", "left")
    share = ratio("rev", "order_rev", 0.0)
    g = lines.groupBy(F.col("order_date").alias("sale_date"), "product_id", "shipping_country").agg(
        F.sum("quantity").alias("units_sold"),
        F.sum("rev").alias("revenue"),
        F.countDistinct("order_id").alias("order_count"),
        F.avg("price").alias("avg_unit_price"),
        F.sum("total_discount").alias("total_discounts"),
        F.countDistinct("customer_email").alias("unique_customers"),
        F.avg("customer_orders_count").alias("avg_customer_order_history"),
        F.count(F.lit(1)).alias("country_order_count"),
        F.coalesce(F.sum(F.col("ads_credit") * share), F.lit(0.0)).alias("ads_attributed_revenue"),
        F.coalesce(F.sum(F.col("email_credit") * share), F.lit(0.0)).alias("email_attributed_revenue"),
    )
    named = g.join(products.select("product_id", F.col("name").alias("product_name"), "sku", F.col("vendor").alias("brand")), "product_id", "left")
    return named.withColumn("organic_revenue", F.col("revenue") - F.col("ads_attributed_revenue") - F.col("email_attributed_revenue"))
