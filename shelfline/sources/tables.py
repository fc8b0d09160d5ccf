"""Canonical retail tables, projected from the star schema and the event table on disk.

The dense product-by-day source is `events` (dated January 2024); the large join source is
`orders` with `lineitem` (up to August 2001). Every column is a per-row expression or one
aggregate, so a table costs no more than its scan plus at most one shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..session import tune

# Reference dates: the day after the last event and after the last order.
EVENT_AS_OF = "2024-01-31"
ORDER_AS_OF = "2001-08-02"

# Sales channels and product categories.
CHANNELS = ["online", "pos", "marketplace", "wholesale"]
CATEGORY_BY_TYPE = {"ECONOMY": "apparel_tops", "SMALL": "apparel_bottoms", "PROMO": "accessories"}


def pick(index: Column, values: list[str]) -> Column:
    """values[index] as a literal lookup."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def customer_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- order side ---------------------------------------------------------------

    @cached_property
    def products(self) -> DataFrame:
        p = self.raw("part")
        kind = F.coalesce(
            *[F.when(F.col("p_type") == k, F.lit(v)) for k, v in CATEGORY_BY_TYPE.items()], F.lit("other")
        )
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            kind.alias("category"),
            F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_brand").alias("vendor"),
            (F.col("p_retailprice") * 0.6).alias("unit_cost"),
            F.col("p_retailprice").alias("selling_price"),
            (1 + F.col("p_size") % 21).cast("bigint").alias("lead_time_days"),
            F.lit(365).cast("bigint").alias("shelf_life_days"),
            F.lit(1).cast("bigint").alias("min_order_quantity"),
            F.lit(10000).cast("bigint").alias("max_order_quantity"),
            F.when(F.col("p_size") % 10 == 0, "draft").otherwise("active").alias("status"),
            F.col("p_size").cast("bigint").alias("inventory_quantity"),
        )

    @cached_property
    def shop_orders(self) -> DataFrame:
        o = self.raw("orders")
        key, cust, total, when = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderdate")
        return o.select(
            key.alias("order_id"),
            cust.alias("customer_id"),
            customer_name(cust).alias("customer_email"),
            when.alias("created_at"),
            when.cast("date").alias("order_date"),
            F.when((F.col("o_orderpriority") == "5-LOW") & (key % 3 == 0), when).alias("cancelled_at"),
            F.when(F.col("o_orderstatus") == "P", "pending").otherwise("paid").alias("financial_status"),
            total.alias("total_price"),
            (total * 0.02).alias("total_discounts"),
            (1 + cust % 8).alias("customer_orders_count"),
            (total / 300.0).alias("customer_total_spent"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "web").alias("source_name"),
            F.concat(F.lit("NATION_"), (cust % 25).cast("string")).alias("shipping_country"),
            F.when(key % 3 == 0, F.concat(F.lit("/landing/Campaign-"), (key % 10).cast("string"), F.lit("/home")))
            .when(key % 3 == 1, F.concat(F.lit("/shop?utm_campaign=campaign-"), (cust % 10).cast("string")))
            .otherwise("/")
            .alias("landing_site"),
        )

    @cached_property
    def line_items(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("bigint").alias("line_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("total_discount"),
            F.col("l_shipdate").alias("updated_at"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        """Customer profiles: attributes of the customer plus totals over all its orders."""
        totals = self.raw("orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("o_totalprice").alias("total_spent"),
            F.min("o_orderdate").cast("date").alias("first_order_date"),
            F.max("o_orderdate").cast("date").alias("last_order_date"),
        )
        c = self.raw("customer")
        key = F.col("c_custkey")
        stages = ["new", "active", "at_risk", "churned"]
        profile = c.select(
            key.alias("customer_id"),
            F.col("c_name").alias("email"),
            F.col("c_mktsegment").alias("customer_segment"),
            pick(key % 4, stages).alias("lifecycle_stage"),
            ((key % 120) / 100.0).alias("email_engagement_score"),
            F.date_sub(F.lit(ORDER_AS_OF).cast("date"), (key % 200).cast("int")).alias("last_email_open"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("country"),
        )
        return profile.join(totals, "customer_id", "left").withColumns(
            {
                "total_orders": F.coalesce("total_orders", F.lit(0)).cast("bigint"),
                "total_spent": F.coalesce("total_spent", F.lit(0.0)),
                "average_order_value": ratio("total_spent", "total_orders", 0.0),
            }
        )

    # -- event side ---------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            "ts",
            F.col("ts").cast("date").alias("date"),
            "user_id",
            "event_type",
            "value",
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("product_id"),
        )

    def _kind(self, *kinds: str) -> DataFrame:
        return self.events.filter(F.col("event_type").isin(*kinds))

    @cached_property
    def sales(self) -> DataFrame:
        return self._kind("purchase").select(
            "event_id",
            "ts",
            "date",
            "product_id",
            pick(F.col("user_id") % 4, CHANNELS).alias("channel"),
            (1 + F.col("event_id") % 5).alias("quantity_sold"),
            F.col("value").alias("revenue"),
            F.col("user_id").alias("customer_id"),
        )

    @cached_property
    def stock(self) -> DataFrame:
        return self._kind("view").select(
            "event_id",
            "ts",
            "date",
            "product_id",
            F.concat(F.lit("loc_"), (F.col("user_id") % 5).cast("string")).alias("location"),
            F.floor("value").cast("bigint").alias("stock_level"),
            (F.col("event_id") % 7).alias("reserved_stock"),
            (F.col("event_id") % 11).alias("in_transit"),
            # every 13th row carries a stale figure, for the checks and the repair
            (F.floor("value").cast("bigint") - F.col("event_id") % 7 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0))
            .cast("bigint")
            .alias("available_stock"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        e = F.col("event_id")
        return self._kind("error").select(
            "event_id",
            "ts",
            "date",
            "product_id",
            pick(e % 4, ["high", "medium", "low", "unknown"]).alias("external_demand"),
            ((e % 25 - 12) / 10.0).alias("market_trend"),
            F.col("value").alias("competitor_price"),
            pick(F.col("user_id") % 3, ["cold", "hot", "normal"]).alias("weather_factor"),
            pick(e % 3, ["none", "promotion", "holiday"]).alias("event_impact"),
            ((e % 21 - 10) / 10.0).alias("social_sentiment"),
        )

    @cached_property
    def demand(self) -> DataFrame:
        """Product-by-day demand, actual and forecast rows."""
        units = F.floor("value").cast("bigint")
        bought = F.col("event_type") == "purchase"
        actual = (
            self._kind("purchase", "click")
            .groupBy("product_id", "date")
            .agg(
                F.sum(units).alias("quantity_demanded"),
                F.coalesce(F.sum(F.when(bought, units)), F.lit(0)).alias("quantity_fulfilled"),
            )
            .withColumn("is_forecast", F.lit(False))
        )
        forecast = (
            self._kind("signup")
            .groupBy("product_id", "date")
            .agg(F.sum(units).alias("quantity_demanded"), F.lit(0).cast("bigint").alias("quantity_fulfilled"))
            .withColumn("is_forecast", F.lit(True))
        )
        return actual.unionByName(forecast)

    @cached_property
    def actions(self) -> DataFrame:
        """Replenishment actions: one per sign-up event."""
        e = F.col("event_id")
        return self._kind("signup").select(
            "event_id",
            "ts",
            "date",
            "product_id",
            F.when(e % 4 == 0, "adjust").otherwise("order").alias("action_type"),
            (1 + e % 50).alias("quantity"),
            F.col("value").alias("cost"),
        )

    @cached_property
    def parameters(self) -> DataFrame:
        """Reorder parameters, two versions per product; the later one is active."""
        version = F.explode(F.array(F.lit(1), F.lit(2)))
        return self.products.select("product_id", "lead_time_days", version.alias("version")).select(
            "product_id",
            F.col("version").cast("bigint").alias("version"),
            F.date_add(F.lit("2023-12-01").cast("date"), F.col("version") * 10).alias("effective_date"),
            (F.col("lead_time_days") * 10 * F.col("version")).alias("reorder_point"),
            (F.col("lead_time_days") * 5).alias("safety_stock"),
            (20 + F.col("product_id") % 30).alias("order_quantity"),
            (F.col("version") == 2).alias("is_active"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Optimisation runs, one per error event of the feed."""
        e = F.col("event_id")
        return self._kind("error").select(
            F.concat(F.lit("run_"), e.cast("string")).alias("run_id"),
            "ts",
            "date",
            (e % 40).alias("convergence_iterations"),
            (e % 9 != 0).alias("constraints_satisfied"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """Tidy performance metrics, one per click event."""
        e = F.col("event_id")
        cat = pick(e % 3, ["service", "cost", "efficiency"])
        return self._kind("click").select(
            "event_id",
            "ts",
            "date",
            cat.alias("metric_category"),
            F.when(e % 3 == 1, F.col("value")).otherwise((e % 100) / 100.0).alias("metric_value"),
        )

    @cached_property
    def ads(self) -> DataFrame:
        """Ad results per date, product and audience, with the attributed products as JSON text."""

        def n(kind):
            return F.count_if(F.col("event_type") == kind)

        def v(kind):
            return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))

        agg = (
            self._kind("view", "click", "purchase", "signup")
            .groupBy("date", "product_id", (F.col("user_id") % 3).alias("audience"))
            .agg(
                (100 * n("view")).alias("impressions"),
                n("click").alias("clicks"),
                (0.1 * v("click")).alias("spend"),
                (40 * n("view")).alias("reach"),
                n("view").alias("view_content"),
                n("click").alias("add_to_cart"),
                n("signup").alias("initiate_checkout"),
                n("purchase").alias("purchases"),
                v("purchase").alias("purchase_value"),
            )
        )
        p = F.col("product_id")
        return agg.select(
            "date",
            F.concat(F.lit("camp_"), (p % 10).cast("string")).alias("campaign_id"),
            F.concat(F.lit("Campaign-"), (p % 10).cast("string")).alias("campaign_name"),
            F.concat_ws("_", F.lit("ad"), p.cast("string"), F.col("audience").cast("string")).alias("ad_id"),
            pick(F.col("audience"), ["18-24", "25-45", "30-65"]).alias("age_range"),
            pick(F.col("audience"), ["all", "female", "male"]).alias("gender"),
            pick(p % 2, ["GB", "FR"]).alias("country"),
            p.alias("product_id"),
            "impressions",
            "clicks",
            "spend",
            "reach",
            "view_content",
            "add_to_cart",
            "initiate_checkout",
            "purchases",
            "purchase_value",
            F.when(
                p % 25 != 3,
                F.concat(
                    F.lit('[{"product_id":'),
                    p.cast("string"),
                    F.lit('},{"product_id":'),
                    ((p + 1) % 100).cast("string"),
                    F.lit("}]"),
                ),
            ).alias("attributed_products"),
        )

    @cached_property
    def email(self) -> DataFrame:
        """E-mail results per date and product, with the featured products as JSON text."""

        def n(kind):
            return F.count_if(F.col("event_type") == kind)

        p = F.col("product_id")
        agg = (
            self._kind("view", "click", "signup", "purchase")
            .groupBy("date", "product_id")
            .agg(
                (50 * n("signup")).alias("recipients"),
                (48 * n("signup")).alias("delivered"),
                (12 * n("view")).alias("opens"),
                (10 * n("view")).alias("unique_opens"),
                (3 * n("click")).alias("clicks"),
                (2 * n("click")).alias("unique_clicks"),
                n("purchase").alias("unsubscribes"),
                F.coalesce(F.sum(F.when(F.col("event_type") == "signup", F.col("value"))), F.lit(0.0)).alias("attributed_revenue"),
                n("purchase").alias("attributed_orders"),
            )
        )
        even = p % 2 == 0
        return agg.select(
            "date",
            "product_id",
            F.when(even, F.concat(F.lit("mail_"), (p % 10).cast("string"))).alias("campaign_id"),
            F.when(even, F.concat(F.lit("Newsletter-"), (p % 10).cast("string"))).alias("campaign_name"),
            F.when(~even, F.concat(F.lit("flow_"), (p % 10).cast("string"))).alias("flow_id"),
            F.when(~even, F.concat(F.lit("Flow-"), (p % 10).cast("string"))).alias("flow_name"),
            F.when(even, "campaign").otherwise("flow").alias("message_type"),
            customer_name(p).alias("segment_name"),
            "recipients",
            "delivered",
            "opens",
            "unique_opens",
            "clicks",
            "unique_clicks",
            "unsubscribes",
            "attributed_revenue",
            "attributed_orders",
            F.when(p % 20 == 12, "[]")
            .when(
                p % 20 != 11,
                F.concat(
                    F.lit('[{"product_id":'),
                    p.cast("string"),
                    F.lit(',"featured_position":1},{"product_id":'),
                    ((p + 7) % 100).cast("string"),
                    F.lit(',"featured_position":2}]'),
                ),
            )
            .alias("featured_products"),
        )

    @cached_property
    def conversions(self) -> DataFrame:
        return self._kind("purchase").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            customer_name(F.col("user_id")).alias("customer_email"),
            F.col("ts").alias("order_ts"),
            "date",
            "product_id",
            F.col("value").alias("revenue"),
        )

    @cached_property
    def touches(self) -> DataFrame:
        return self._kind("view", "click", "signup").select(
            F.col("event_id").alias("touch_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("touch_ts"),
            F.when(F.col("event_type") == "view", "facebook")
            .when(F.col("event_type") == "click", "email")
            .otherwise("organic")
            .alias("channel"),
            F.concat(F.lit("camp_"), (F.col("product_id") % 10).cast("string")).alias("campaign_id"),
        )

    @cached_property
    def performance(self) -> DataFrame:
        """Product-by-day performance: one pass over the events, then product attributes."""

        def n(kind, *extra):
            c = F.col("event_type") == kind
            for x in extra:
                c = c & x
            return F.count_if(c)

        def v(kind):
            return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))

        even = F.col("event_id") % 2 == 0
        base = (
            self.events.groupBy("date", "product_id")
            .agg(
                F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", 1 + F.col("event_id") % 5)), F.lit(0)).alias("units_sold"),
                v("purchase").alias("revenue"),
                n("purchase").alias("orders"),
                (0.1 * v("click")).alias("ads_spend"),
                (100 * n("view")).alias("ads_impressions"),
                n("click").alias("ads_clicks"),
                (0.3 * v("view")).alias("ads_attributed_revenue"),
                n("view", even).alias("ads_attributed_units"),
                (50 * n("signup")).alias("emails_sent"),
                n("view").alias("emails_opened"),
                n("click").alias("emails_clicked"),
                (0.2 * v("signup")).alias("email_attributed_revenue"),
                n("signup", even).alias("email_attributed_units"),
                F.floor(F.max(F.when(F.col("event_type") == "view", F.col("value")))).cast("bigint").alias("inventory_level"),
            )
            .withColumns(
                {
                    "avg_selling_price": ratio("revenue", "units_sold"),
                    "total_marketing_spend": F.col("ads_spend"),
                    "total_attributed_revenue": F.col("ads_attributed_revenue") + F.col("email_attributed_revenue"),
                    "total_attributed_units": F.col("ads_attributed_units") + F.col("email_attributed_units"),
                    "inventory_cost": F.col("inventory_level") * 0.25,
                    "profit_margin": 0.1 + (F.col("product_id") % 5) * 0.1,
                }
            )
            .withColumns(
                {
                    "organic_revenue": F.greatest(F.lit(0.0), F.col("revenue") - F.col("total_attributed_revenue")),
                    "organic_units": F.greatest(F.lit(0).cast("bigint"), F.col("units_sold") - F.col("total_attributed_units")),
                }
            )
        )
        names = self.products.select(
            "product_id", F.col("name").alias("product_name"), F.col("category").alias("product_category"), F.col("sku").alias("product_sku")
        )
        return base.join(names, "product_id", "left")
