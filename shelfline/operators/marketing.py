"""Ad and e-mail results: per-row metrics, product allocation, campaign and segment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at_least, cases, count_if, dow, money, product_list, ratio, ratio_pos, since

# Class thresholds and labels.
ROAS_CLASSES = [(4.0, "high_performance"), (2.0, "medium_performance"), (1.0, "low_performance")]
CTR_CLASSES = [(2.0, "high_engagement"), (1.0, "medium_engagement"), (0.5, "low_engagement")]
MAIL_CLASSES = [(25, 3, "high_engagement"), (20, 2, "medium_engagement"), (15, 1, "low_engagement")]
MAIL_VALUE_CLASSES = [(1.0, "high_value"), (0.5, "medium_value"), (0.1, "low_value")]
DEMAND_STEPS = ((20, "high"), (10, "medium"))


def performance_class(roas: str) -> Column:
    return F.coalesce(at_least(roas, ROAS_CLASSES), F.when(F.col(roas) > 0, "break_even"), F.lit("loss_making"))


def pct(num: str, den: str) -> Column:
    return ratio_pos(num, den) * 100


def ad_metrics(ads: DataFrame) -> DataFrame:
    return ads.withColumns(
        {
            "ctr": pct("clicks", "impressions"),
            "cpc": ratio_pos("spend", "clicks"),
            "cpm": ratio_pos("spend", "impressions") * 1000,
            "roas": ratio_pos("purchase_value", "spend"),
            "view_content_rate": pct("view_content", "impressions"),
            "add_to_cart_rate": pct("add_to_cart", "view_content"),
            "checkout_rate": pct("initiate_checkout", "add_to_cart"),
            "purchase_rate": pct("purchases", "initiate_checkout"),
            "cost_per_acquisition": ratio_pos("spend", "purchases", None),
        }
    )


def ad_classes(ads: DataFrame) -> DataFrame:
    return ad_metrics(ads).withColumns(
        {"performance_category": performance_class("roas"), "engagement_quality": at_least("ctr", CTR_CLASSES, "poor_engagement")}
    )


def mail_metrics(mail: DataFrame) -> DataFrame:
    return mail.withColumns(
        {
            "delivery_rate": pct("delivered", "recipients"),
            "open_rate": pct("unique_opens", "delivered"),
            "click_to_open_rate": pct("unique_clicks", "unique_opens"),
            "click_rate": pct("unique_clicks", "delivered"),
            "unsubscribe_rate": pct("unsubscribes", "delivered"),
            "revenue_per_recipient": ratio_pos("attributed_revenue", "recipients"),
            "revenue_per_click": ratio_pos("attributed_revenue", "unique_clicks"),
            "average_order_value": ratio_pos("attributed_revenue", "attributed_orders"),
        }
    )


def mail_classes(mail: DataFrame) -> DataFrame:
    engaged = [((F.col("open_rate") >= o) & (F.col("click_rate") >= c), label) for o, c, label in MAIL_CLASSES]
    return mail_metrics(mail).withColumns(
        {
            "engagement_quality": cases(engaged, "poor_engagement"),
            "revenue_performance": at_least("revenue_per_recipient", MAIL_VALUE_CLASSES, "minimal_value"),
            "day_type": F.when(dow("date").isin(0, 6), "weekend").otherwise("weekday"),
        }
    )


def per_product(df: DataFrame, list_col: str, *measures: str) -> DataFrame:
    """One row per listed product, each measure split evenly over the list; absent or bad lists drop out."""
    items = product_list(list_col)
    size = F.size("__items")
    e = df.withColumn("__items", items).select("*", F.explode("__items").alias("__p"), size.alias("listed"))
    return e.select(
        *[c for c in df.columns if c not in measures and c not in ("product_id", list_col)],
        F.col("__p.product_id").alias("product_id"),
        F.col("__p.featured_position").alias("featured_position"),
        *[ratio(m, "listed").alias(m) for m in measures],
    )


AD_MEASURES = ("spend", "impressions", "clicks", "purchases", "purchase_value")
MAIL_MEASURES = ("recipients", "opens", "clicks", "attributed_revenue", "attributed_orders")


def ad_product_performance(ads: DataFrame) -> DataFrame:
    d = per_product(ad_metrics(ads), "attributed_products", *AD_MEASURES)
    return d.groupBy("date", "product_id", "campaign_name").agg(
        *[F.sum(m).alias(f"total_{m}") for m in AD_MEASURES],
        *[F.avg(m).alias(f"avg_{m}") for m in ("ctr", "cpc", "roas")],
        ratio(F.sum("spend"), F.sum("purchases")).alias("cost_per_purchase"),
    )


def ad_campaign_audience(ads: DataFrame) -> DataFrame:
    s = {m: F.sum(m) for m in ("spend", "impressions", "clicks", "purchases", "purchase_value")}
    return ads.groupBy("campaign_id", "campaign_name", F.col("date").alias("campaign_date"), "age_range", "gender", "country").agg(
        *[v.alias(f"daily_{k}") for k, v in s.items()],
        (ratio(s["clicks"], s["impressions"]) * 100).alias("ctr_percent"),
        ratio(s["spend"], s["clicks"]).alias("cpc"),
        ratio(s["purchase_value"], s["spend"]).alias("roas"),
        (ratio(s["purchases"], s["clicks"]) * 100).alias("conversion_rate"),
    )


def mail_product_performance(mail: DataFrame) -> DataFrame:
    d = per_product(mail_metrics(mail), "featured_products", *MAIL_MEASURES)
    return d.groupBy("date", "product_id", "campaign_name", "flow_name", "message_type").agg(
        *[F.sum(m).alias(f"total_{m}") for m in MAIL_MEASURES],
        F.avg("open_rate").alias("avg_open_rate"),
        F.avg("click_rate").alias("avg_click_rate"),
        ratio(F.sum("attributed_revenue"), F.sum("recipients")).alias("revenue_per_recipient"),
        ratio(F.sum("attributed_revenue"), F.sum("opens")).alias("revenue_per_open"),
    )


def customer_mail_join(customers: DataFrame, mail: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Customers with the mail addressed to their segment; the date test stands after the join, as published.

    A customer whose mail is all older than the window therefore drops out.
    """
    m = mail.select("segment_name", F.col("date").alias("mail_date"), "opens", "clicks", "attributed_revenue")
    joined = customers.join(m, F.col("email") == F.col("segment_name"), "left")
    return joined.filter(since("mail_date", as_of, days) | F.col("mail_date").isNull())


def customer_engagement(customers: DataFrame, mail: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    keys = ["email", "customer_segment", "lifecycle_stage", "total_orders", "total_spent", "email_engagement_score"]
    sent = F.count("mail_date")
    return customer_mail_join(customers, mail, as_of, days).groupBy(*keys).agg(
        sent.alias("emails_received_30d"),
        F.sum("opens").alias("total_opens_30d"),
        F.sum("clicks").alias("total_clicks_30d"),
        F.sum("attributed_revenue").alias("email_attributed_revenue_30d"),
        (ratio(F.sum("opens"), sent) * 100).alias("open_rate_30d"),
        (ratio(F.sum("clicks"), F.sum("opens")) * 100).alias("click_through_rate_30d"),
    )


def demand_signals(products: DataFrame, ads: DataFrame, mail: DataFrame, as_of: str) -> DataFrame:
    """Demand level, trend and sentiment per product from the last day's ads and e-mail."""
    today = F.lit(as_of).cast("date")
    a = (
        per_product(ad_metrics(ads.filter(F.col("date") == today)), "attributed_products", "purchases")
        .groupBy("product_id")
        .agg(F.sum("purchases").alias("bought"), F.avg("roas").alias("avg_roas"))
    )
    m = (
        per_product(mail_metrics(mail.filter(F.col("date") == today)), "featured_products", "attributed_orders")
        .groupBy("product_id")
        .agg(F.sum("attributed_orders").alias("ordered"), F.avg("open_rate").alias("avg_open_rate"))
    )
    both = a.join(m, "product_id", "full").join(products.select("product_id"), "product_id", "left_semi")
    total = F.coalesce("bought", F.lit(0.0)) + F.coalesce("ordered", F.lit(0.0))
    level = cases([(total > bound, label) for bound, label in DEMAND_STEPS], "low")
    return both.select(
        today.alias("date"),
        "product_id",
        level.alias("external_demand"),
        (F.coalesce("avg_roas", F.lit(0.0)) / 10).alias("market_trend"),
        (F.coalesce("avg_open_rate", F.lit(0.0)) / 100).alias("social_sentiment"),
    )


def mail_campaigns(mail: DataFrame) -> DataFrame:
    return (
        mail_metrics(mail.filter(F.col("message_type") == "campaign"))
        .groupBy("campaign_name")
        .agg(
            F.sum("recipients").alias("total_recipients"),
            F.avg("open_rate").alias("avg_open_rate"),
            F.avg("click_rate").alias("avg_click_rate"),
            F.sum("attributed_revenue").alias("total_revenue"),
            ratio(F.sum("attributed_revenue"), F.sum("recipients")).alias("revenue_per_recipient"),
        )
    )


def ad_roas_first_product(ads: DataFrame) -> DataFrame:
    first = F.get(product_list("attributed_products"), 0)["product_id"]
    return (
        ads.filter(F.col("attributed_products").isNotNull())
        .groupBy(first.alias("product_id"), "campaign_name")
        .agg(F.sum("spend").alias("total_spend"), F.sum("purchase_value").alias("total_revenue"), ratio(F.sum("purchase_value"), F.sum("spend")).alias("roas"))
    )


def campaign_daily(ads: DataFrame) -> DataFrame:
    return ad_metrics(ads).groupBy("date", "campaign_id", "campaign_name").agg(
        *[F.sum(c).alias(f"total_{c}") for c in AD_MEASURES], F.avg("ctr").alias("avg_ctr"), F.avg("roas").alias("avg_roas")
    )


def ad_allocation(ads: DataFrame) -> DataFrame:
    return per_product(ads.select("date", "campaign_id", "ad_id", "spend", "attributed_products"), "attributed_products", "spend").select(
        "date", "campaign_id", "ad_id", "product_id", F.col("spend").alias("allocated_spend")
    )


def audience_performance(ads: DataFrame, min_spend: float = 100.0) -> DataFrame:
    g = (
        ad_metrics(ads)
        .filter(F.col("spend") > 0)
        .groupBy("age_range", "gender", "country")
        .agg(
            F.count(F.lit(1)).alias("ad_count"),
            F.sum("spend").alias("total_spend"),
            F.sum("purchase_value").alias("total_revenue"),
            F.avg("roas").alias("avg_roas"),
            F.avg("ctr").alias("avg_ctr"),
        )
    )
    return g.filter(F.col("total_spend") > min_spend)


def campaign_averages(ads: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    daily = (
        ads.filter(since("date", as_of, days))
        .groupBy("date", "campaign_id")
        .agg(F.sum("spend").alias("s"), F.sum("purchase_value").alias("r"))
    )
    return daily.groupBy("campaign_id").agg(
        F.avg("s").alias("avg_daily_spend"), F.avg("r").alias("avg_daily_revenue"), F.avg(ratio("r", "s")).alias("avg_roas")
    )


def message_type_summary(mail: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (
        mail_metrics(mail.filter(since("date", as_of, days)))
        .groupBy("message_type")
        .agg(
            F.count(F.lit(1)).alias("total_sends"),
            money(F.avg("open_rate")).alias("avg_open_rate"),
            money(F.avg("click_rate")).alias("avg_click_rate"),
            money(F.avg("revenue_per_recipient")).alias("avg_revenue_per_recipient"),
            F.sum("attributed_revenue").alias("total_attributed_revenue"),
        )
    )


def mail_mentions(mail: DataFrame) -> DataFrame:
    d = per_product(mail, "featured_products", "attributed_revenue", "unique_clicks")
    return d.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("email_mentions"),
        F.sum("attributed_revenue").alias("total_email_attributed_revenue"),
        F.sum("unique_clicks").alias("total_email_clicks"),
        F.avg("featured_position").alias("avg_featured_position"),
    )


def mail_segments(mail: DataFrame, as_of: str, days: int = 90, min_recipients: int = 100) -> DataFrame:
    g = (
        mail_metrics(mail.filter(F.col("segment_name").isNotNull() & since("date", as_of, days)))
        .groupBy("segment_name", "message_type")
        .agg(
            F.count(F.lit(1)).alias("email_count"),
            F.avg("open_rate").alias("avg_open_rate"),
            F.avg("click_rate").alias("avg_click_rate"),
            F.avg("revenue_per_recipient").alias("avg_revenue_per_recipient"),
            F.sum("attributed_revenue").alias("total_revenue"),
            F.sum("recipients").alias("total_recipients"),
        )
    )
    return g.filter(F.col("total_recipients") > min_recipients)


def channel_summary(ads: DataFrame, mail: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Ads per campaign and day, and e-mail rows, in one layout with cost ratios."""
    a = (
        ad_metrics(ads.filter(since("date", as_of, days)))
        .groupBy("date", F.lit("facebook").alias("channel"), F.col("campaign_id").alias("campaign_identifier"), "campaign_name")
        .agg(
            F.lit(None).cast("string").alias("flow_name"),
            F.sum("spend").alias("spend"),
            F.sum("impressions").alias("impressions"),
            F.sum("clicks").alias("clicks"),
            F.sum("purchase_value").alias("attributed_revenue"),
            F.sum("purchases").alias("attributed_conversions"),
            F.avg("roas").alias("roas"),
        )
    )
    m = mail.filter(since("date", as_of, days)).select(
        "date",
        F.lit("email").alias("channel"),
        F.coalesce("campaign_id", "flow_id").alias("campaign_identifier"),
        F.coalesce("campaign_name", "flow_name").alias("campaign_name"),
        "flow_name",
        F.lit(0.0).alias("spend"),
        F.lit(0).cast("bigint").alias("impressions"),
        F.col("unique_clicks").alias("clicks"),
        "attributed_revenue",
        F.col("attributed_orders").alias("attributed_conversions"),
        (ratio_pos("attributed_revenue", "recipients") * 1000).alias("roas"),
    )
    return a.unionByName(m).withColumns(
        {
            "cost_per_click": ratio_pos("spend", "clicks"),
            "cost_per_acquisition": ratio_pos("spend", "attributed_conversions"),
            "click_through_rate_percentage": pct("clicks", "impressions"),
        }
    )


def ad_kpis(ads: DataFrame) -> DataFrame:
    s = {c: F.sum(c) for c in ("spend", "impressions", "clicks", "purchases", "purchase_value", "reach")}
    return ads.groupBy("campaign_id").agg(
        ratio(s["purchase_value"], s["spend"]).alias("roas"),
        ratio(s["spend"], s["purchases"]).alias("cpa"),
        (ratio(s["clicks"], s["impressions"]) * 100).alias("ctr"),
        (ratio(s["purchases"], s["clicks"]) * 100).alias("conversion_rate"),
        ratio(s["spend"], s["clicks"]).alias("cpc"),
        (ratio(s["spend"], s["impressions"]) * 1000).alias("cpm"),
        ratio(s["impressions"], s["reach"]).alias("frequency"),
    )


def mail_kpis(mail: DataFrame) -> DataFrame:
    g = mail_metrics(mail).groupBy("message_type").agg(
        F.avg("open_rate").alias("open_rate"),
        F.avg("click_rate").alias("click_rate"),
        F.avg("revenue_per_recipient").alias("revenue_per_recipient"),
        F.avg("click_to_open_rate").alias("click_to_open_rate"),
        F.avg("unsubscribe_rate").alias("unsubscribe_rate"),
    )
    return g.withColumn("engagement_score", F.col("open_rate") * 0.3 + F.col("click_rate") * 0.7)


def violations_by_day(ads: DataFrame) -> DataFrame:
    g = ad_metrics(ads).groupBy("date").agg(
        F.count(F.lit(1)).alias("total_records"),
        count_if(F.col("spend") < 0).alias("negative_spend_records"),
        count_if(F.col("impressions") < F.col("clicks")).alias("invalid_ctr_records"),
        count_if(F.col("purchase_value") < 0).alias("negative_revenue_records"),
        count_if(F.col("campaign_id").isNull()).alias("missing_campaign_id"),
        F.avg((F.col("roas") > 10).cast("double")).alias("high_roas_outlier_rate"),
    )
    bad = ("negative_spend_records", "invalid_ctr_records", "negative_revenue_records", "missing_campaign_id")
    return g.filter(" OR ".join(f"{c} > 0" for c in bad))
