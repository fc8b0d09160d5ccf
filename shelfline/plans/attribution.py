"""Journeys and attribution models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as op
from ..sources.tables import EVENT_AS_OF, Tables
from .registry import query
from .sqltext import EV, define

define(
    "journey_touches",
    """SELECT c.order_id, c.order_ts, c.revenue, c.date, c.customer_email, c.product_id, c.customer_id, t.channel, t.campaign_id, t.touch_ts, t.touch_id
    FROM touches t JOIN conversions c ON t.customer_id = c.customer_id AND t.touch_ts <= c.order_ts AND c.order_ts - t.touch_ts <= INTERVAL 7 DAY""",
)
define(
    "attribution",
    """SELECT order_id, customer_id, customer_email, date, order_ts, product_id, revenue AS total_attributed_revenue, first_touch_channel, last_touch_channel,
    first_touch_ts, last_touch_ts, coalesce(n, 0) AS touchpoint_count, coalesce(nf, 0) AS ads_touches, coalesce(ne, 0) AS email_touches, ads_campaign_id, email_campaign_id,
    datesub('hour', first_touch_ts, last_touch_ts) AS journey_duration_hours,
    CAST(round(CAST(revenue * coalesce(nf / n, 0) AS DECIMAL(18,4)), 2) AS DOUBLE) AS ads_attributed_revenue,
    CAST(round(CAST(revenue * coalesce(ne / n, 0) AS DECIMAL(18,4)), 2) AS DOUBLE) AS email_attributed_revenue, (nf + ne) / n AS attribution_weight
    FROM conversions LEFT JOIN (SELECT order_id, arg_min(channel, touch_ts) AS first_touch_channel, arg_max(channel, touch_ts) AS last_touch_channel,
      min(touch_ts) AS first_touch_ts, max(touch_ts) AS last_touch_ts, count(*) AS n, count(*) FILTER (channel = 'facebook') AS nf, count(*) FILTER (channel = 'email') AS ne,
      arg_max(campaign_id, touch_ts) FILTER (channel = 'facebook') AS ads_campaign_id, arg_max(campaign_id, touch_ts) FILTER (channel = 'email') AS email_campaign_id
      FROM journey_touches GROUP BY 1) s USING (order_id)""",
)
define(
    "placed",
    "SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY touch_ts, touch_id) AS position, count(*) OVER (PARTITION BY order_id) AS n FROM journey_touches",
)


def attribution(t: Tables) -> DataFrame:
    return op.attribution(t.conversions, t.touches)


def touches(t: Tables) -> DataFrame:
    return op.journey_touches(t.conversions, t.touches)


@query(
    "M01_touch_sequences",
    """SELECT order_id, CAST((position - 1) // 1000 AS BIGINT) AS chunk, count(*) AS touches, '[' || string_agg('{"channel":"' || channel || '","campaign_id":"' || campaign_id || '","timestamp":"' ||
    strftime(touch_ts, '%Y-%m-%dT%H:%M:%S') || '"}', ',' ORDER BY position) || ']' AS touchpoint_sequence FROM placed GROUP BY 1, 2""",
)
def sequences(t: Tables) -> DataFrame:
    return op.sequences(touches(t))


@query("J15_expand_touches", "SELECT order_id, position, channel, campaign_id FROM placed")
def expand(t: Tables) -> DataFrame:
    return op.expand_sequences(op.sequences(touches(t)))


@query(
    "M02_first_last_touch",
    "SELECT order_id, first_touch_channel, last_touch_channel, touchpoint_count, ads_touches, email_touches FROM attribution",
)
def first_last(t: Tables) -> DataFrame:
    return attribution(t).select("order_id", "first_touch_channel", "last_touch_channel", "touchpoint_count", "ads_touches", "email_touches")


@query("M03_journey_duration", "SELECT order_id, first_touch_ts, last_touch_ts, journey_duration_hours FROM attribution")
def duration(t: Tables) -> DataFrame:
    return attribution(t).select("order_id", "first_touch_ts", "last_touch_ts", "journey_duration_hours")


@query(
    "M04_time_decay",
    """SELECT channel, campaign_id, count(DISTINCT customer_email) AS attributed_customers, round(sum(revenue * w), 4) AS weighted_attributed_revenue,
    round(avg(w), 4) AS avg_attribution_weight, round(sum(revenue), 4) AS total_revenue_influenced
    FROM (SELECT *, CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) WHEN n = 2 THEN CASE position WHEN 1 THEN 0.3 ELSE 0.7 END
      WHEN n = 3 THEN CASE position WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.5 END
      ELSE power(CAST(2 AS DOUBLE), position - n) / (2 - power(CAST(2 AS DOUBLE), 1 - n)) END AS w FROM placed) GROUP BY 1, 2""",
    digits=4,
)
def time_decay(t: Tables) -> DataFrame:
    return op.time_decay_by_campaign(touches(t))


_RECENCY = """SELECT order_id, channel, round(w / sum(w) OVER (PARTITION BY order_id), 6) AS attribution_weight,
    round(revenue * w / sum(w) OVER (PARTITION BY order_id), 6) AS channel_attributed_revenue
    FROM (SELECT order_id, channel, revenue, sum(exp(-0.1 * datesub('hour', touch_ts, order_ts))) AS w FROM journey_touches GROUP BY 1, 2, 3)"""


@query("M05_recency_decay", _RECENCY)
def recency(t: Tables) -> DataFrame:
    return op.recency_weights(touches(t))


@query(
    "W08_normalised_weight",
    """SELECT order_id, channel, round(count(*) / sum(count(*)) OVER (PARTITION BY order_id), 6) AS weight FROM journey_touches GROUP BY 1, 2""",
)
def normalised_weight(t: Tables) -> DataFrame:
    # rate 0 gives every touch the weight 1, so the share is the touch share
    return op.recency_weights(touches(t), 0.0).select("order_id", "channel", F.col("attribution_weight").alias("weight"))


@query(
    "M06_linear_credit",
    "SELECT order_id, total_attributed_revenue, ads_attributed_revenue, email_attributed_revenue, touchpoint_count FROM attribution",
)
def linear(t: Tables) -> DataFrame:
    return op.linear_credit(attribution(t))


@query(
    "M07_position_based",
    """SELECT order_id, channel, round(sum(w), 6) AS weight, round(sum(revenue * w), 6) AS attributed_revenue
    FROM (SELECT *, CASE WHEN n <= 2 THEN CAST(1 AS DOUBLE) / n WHEN position = 1 OR position = n THEN 0.4 ELSE CAST(0.2 AS DOUBLE) / (n - 2) END AS w FROM placed) GROUP BY 1, 2""",
)
def position_based(t: Tables) -> DataFrame:
    return op.position_based(touches(t))


define(
    "credit_windows",
    """SELECT c.order_id, c.product_id, c.date, c.revenue, """
    + ", ".join(f"CASE WHEN c.order_ts - a.touch_ts <= INTERVAL {w} DAY THEN c.revenue ELSE 0 END AS ads_{w}d_revenue" for w in (1, 7, 28))
    + ", "
    + ", ".join(f"CASE WHEN c.order_ts - e.touch_ts <= INTERVAL {w} DAY THEN c.revenue ELSE 0 END AS email_{w}d_revenue" for w in (1, 3, 7))
    + """ FROM conversions c ASOF LEFT JOIN (SELECT * FROM touches WHERE channel = 'facebook') a ON c.customer_id = a.customer_id AND c.order_ts >= a.touch_ts
    ASOF LEFT JOIN (SELECT * FROM touches WHERE channel = 'email') e ON c.customer_id = e.customer_id AND c.order_ts >= e.touch_ts""",
)


@query("M08_attribution_windows", "SELECT * FROM credit_windows")
def windows(t: Tables) -> DataFrame:
    return op.window_credit(t.conversions, t.touches)


@query(
    "A41_windowed_product_revenue",
    """SELECT product_id, date, round(sum(ads_7d_revenue), 6) AS ads_7d_attributed_revenue, round(sum(email_3d_revenue), 6) AS email_3d_attributed_revenue,
    round(sum(revenue), 6) AS revenue FROM credit_windows GROUP BY 1, 2""",
)
def windowed_product(t: Tables) -> DataFrame:
    return windows(t).groupBy("product_id", "date").agg(
        F.sum("ads_7d_revenue").alias("ads_7d_attributed_revenue"),
        F.sum("email_3d_revenue").alias("email_3d_attributed_revenue"),
        F.sum("revenue").alias("revenue"),
    )


_URL = """SELECT DISTINCT order_id, campaign_id, 'facebook' AS channel FROM shop_orders JOIN (SELECT DISTINCT campaign_id, lower(campaign_name) AS nm FROM ads) c
    ON lower(landing_site) LIKE '%' || nm || '%' OR contains(lower(landing_site), 'utm_campaign=' || regexp_replace(nm, '[^a-z0-9_-]+', '', 'g'))"""


@query("J06_campaign_url_join", _URL)
def url_join(t: Tables) -> DataFrame:
    campaigns = t.ads.select("campaign_id", "campaign_name").distinct()
    return op.campaign_url_matches(t.shop_orders, campaigns)


@query(
    "M09_campaign_touches",
    f"SELECT campaign_id, channel, count(*) AS orders, round(sum(total_price), 4) AS revenue FROM ({_URL}) m JOIN shop_orders USING (order_id) GROUP BY 1, 2",
    digits=4,
)
def campaign_touches(t: Tables) -> DataFrame:
    m = url_join(t).join(t.shop_orders.select("order_id", "total_price"), "order_id")
    return m.groupBy("campaign_id", "channel").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_price").alias("revenue"))


@query(
    "J04_customer_journey",
    """SELECT c.order_id, c.customer_email, c.order_ts, c.revenue AS order_value, first_touch_channel, last_touch_channel, ads_attributed_revenue, email_attributed_revenue, touchpoint_count,
    journey_duration_hours, p.total_orders AS lifetime_orders, round(p.total_spent, 4) AS lifetime_value, customer_segment, lifecycle_stage, email_engagement_score,
    CASE WHEN ads_attributed_revenue > 0 OR email_attributed_revenue > 0 THEN 'attributed' ELSE 'organic' END AS order_type
    FROM conversions c LEFT JOIN attribution a ON a.order_id = c.order_id LEFT JOIN customers p ON p.email = c.customer_email""",
    digits=4,
)
def journey_view(t: Tables) -> DataFrame:
    orders = t.conversions.select("order_id", "customer_email", "order_ts", F.col("revenue").alias("order_value"))
    return op.journey_view(orders, attribution(t), t.customers)


@query(
    "J05_either_key_join",
    """SELECT b.order_id, b.date, mail_campaign_id, mail_flow_id, mail_key, round(open_rate, 6) AS open_rate, round(click_rate, 6) AS click_rate FROM
    (SELECT order_id, date, 'mail_' || (order_id % 5) * 2 AS mail_campaign_id, 'flow_' || (order_id % 3) AS mail_flow_id FROM attribution) b
    LEFT JOIN (SELECT *, concat_ws('|', date, campaign_id, flow_id) AS mail_key FROM (SELECT date, campaign_id, flow_id, sum(unique_opens) / nullif(sum(delivered), 0) * 100 AS open_rate,
      sum(unique_clicks) / nullif(sum(delivered), 0) * 100 AS click_rate FROM email GROUP BY 1, 2, 3)) m
    ON (b.mail_campaign_id = m.campaign_id OR b.mail_flow_id = m.flow_id) AND b.date = m.date""",
)
def either_key(t: Tables) -> DataFrame:
    from . import marketing

    o = F.col("order_id")
    base = attribution(t).select(
        "order_id",
        "date",
        F.concat(F.lit("mail_"), ((o % 5) * 2).cast("string")).alias("mail_campaign_id"),
        F.concat(F.lit("flow_"), (o % 3).cast("string")).alias("mail_flow_id"),
    )
    return op.either_key_join(base, marketing.mail_by_message(t))


@query(
    "J16_customer_clv",
    """SELECT order_id, customer_email, round(total_clv, 6) AS total_clv, total_orders, first_attribution_date, last_attribution_date FROM attribution JOIN
    (SELECT customer_email, sum(total_attributed_revenue) AS total_clv, count(DISTINCT order_id) AS total_orders, min(date) AS first_attribution_date, max(date) AS last_attribution_date
     FROM attribution GROUP BY 1) USING (customer_email)""",
)
def customer_clv(t: Tables) -> DataFrame:
    a = attribution(t)
    return a.select("order_id", "customer_email").join(op.clv(a), "customer_email")


@query(
    "J17_segments_on_journeys",
    """SELECT order_id, customer_email, total_attributed_revenue, round(v, 6) AS lifetime_value, round(a, 6) AS avg_order_value,
    CASE WHEN n = 1 THEN 'new_customer' WHEN n BETWEEN 2 AND 5 THEN 'returning_customer' ELSE 'loyal_customer' END AS customer_segment,
    CASE WHEN v >= 500 THEN 'high_value' WHEN v >= 200 THEN 'medium_value' ELSE 'low_value' END AS value_segment
    FROM attribution JOIN (SELECT customer_email, count(*) AS n, sum(total_attributed_revenue) AS v, avg(total_attributed_revenue) AS a FROM attribution GROUP BY 1) USING (customer_email)""",
)
def segments(t: Tables) -> DataFrame:
    return op.with_customer_segments(attribution(t))


@query(
    "A07_touch_revenue_by_product",
    """SELECT date AS attribution_date, product_id, first_touch_channel, last_touch_channel, round(sum(total_attributed_revenue), 6) AS total_attributed_revenue,
    count(DISTINCT order_id) AS attributed_orders, round(sum(CASE WHEN first_touch_channel = 'facebook' THEN total_attributed_revenue ELSE 0 END), 6) AS ads_first_touch_revenue,
    round(sum(CASE WHEN last_touch_channel = 'facebook' THEN total_attributed_revenue ELSE 0 END), 6) AS ads_last_touch_revenue,
    round(sum(CASE WHEN first_touch_channel = 'email' THEN total_attributed_revenue ELSE 0 END), 6) AS email_first_touch_revenue,
    round(sum(CASE WHEN last_touch_channel = 'email' THEN total_attributed_revenue ELSE 0 END), 6) AS email_last_touch_revenue,
    round(avg(touchpoint_count), 6) AS avg_touchpoints, count(DISTINCT customer_email) AS unique_customers FROM attribution GROUP BY 1, 2, 3, 4""",
)
def touch_revenue(t: Tables) -> DataFrame:
    return op.daily_touch_revenue(attribution(t))


@query(
    "A34_channel_pairs",
    f"""SELECT first_touch_channel, last_touch_channel, count(*) AS conversion_count, CAST(round(CAST(sum(total_attributed_revenue) AS DECIMAL(18,4)), 2) AS DOUBLE) AS total_revenue,
    CAST(round(CAST(sum(total_attributed_revenue) / count(*) AS DECIMAL(18,4)), 2) AS DOUBLE) AS revenue_per_conversion, round(avg(journey_duration_hours), 4) AS avg_journey_hours,
    round(avg(touchpoint_count), 4) AS avg_touchpoints, CASE WHEN first_touch_channel = last_touch_channel THEN 'single_channel'
    WHEN first_touch_channel = 'facebook' AND last_touch_channel = 'email' THEN 'facebook_to_email' WHEN first_touch_channel = 'email' AND last_touch_channel = 'facebook' THEN 'email_to_facebook'
    ELSE 'multi_channel' END AS journey_type FROM attribution WHERE date >= {EV} - 30 AND total_attributed_revenue > 0 GROUP BY 1, 2""",
    digits=4,
)
def channel_pairs(t: Tables) -> DataFrame:
    return op.channel_pairs(attribution(t), EVENT_AS_OF)


@query(
    "A35_journey_patterns",
    f"""SELECT journey_pattern, count(*) AS journey_frequency, round(avg(revenue), 6) AS avg_revenue, round(avg(n), 6) AS avg_touchpoints, round(avg(hours), 6) AS avg_duration_hours,
    round(avg(CASE WHEN hours > 0 THEN n / hours END), 6) AS avg_velocity, round(sum(revenue), 6) AS total_revenue
    FROM (SELECT order_id, revenue, string_agg(channel, ' -> ' ORDER BY position) AS journey_pattern, count(*) AS n, datesub('hour', min(touch_ts), max(touch_ts)) AS hours
      FROM placed WHERE date >= {EV} - 90 GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 5 ORDER BY total_revenue DESC, min(order_id) LIMIT 20""",
)
def patterns(t: Tables) -> DataFrame:
    return op.journey_patterns(touches(t), EVENT_AS_OF)


_ATT30 = f"FROM attribution WHERE date >= {EV} - 30"


@query(
    "A36_model_comparison",
    f"""SELECT attribution_model, round(a, 4) AS ads_attributed_revenue, round(e, 4) AS email_attributed_revenue, round(a + e, 4) AS total_attributed_revenue FROM (
    SELECT 'first_touch' AS attribution_model, sum(total_attributed_revenue) FILTER (first_touch_channel = 'facebook') AS a, sum(total_attributed_revenue) FILTER (first_touch_channel = 'email') AS e {_ATT30}
    UNION ALL SELECT 'last_touch', sum(total_attributed_revenue) FILTER (last_touch_channel = 'facebook'), sum(total_attributed_revenue) FILTER (last_touch_channel = 'email') {_ATT30}
    UNION ALL SELECT 'linear', sum(ads_attributed_revenue), sum(email_attributed_revenue) {_ATT30})""",
    digits=4,
)
def models(t: Tables) -> DataFrame:
    return op.model_comparison(attribution(t), EVENT_AS_OF)


@query(
    "A37_attribution_demand_rate",
    """SELECT product_id, first_touch_channel, last_touch_channel, round(sum(r), 4) AS total_attributed_revenue, CAST(sum(n) AS BIGINT) AS total_attribution_events,
    round(avg(h), 4) AS avg_customer_journey_hours, round(sum(n) / 30, 4) AS daily_attribution_rate, round(sum(r) / sum(n), 4) AS revenue_per_attribution
    FROM (SELECT date, product_id, first_touch_channel, last_touch_channel, sum(total_attributed_revenue) AS r, count(*) AS n, avg(journey_duration_hours) AS h FROM attribution
      WHERE touchpoint_count > 0 AND date >= DATE '2024-01-31' - 30 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    digits=4,
)
def demand_rate(t: Tables) -> DataFrame:
    return op.demand_rate(attribution(t), EVENT_AS_OF)


@query(
    "A38_budget_share",
    f"""SELECT first_touch_channel, round(r, 4) AS attributed_revenue, c AS attributed_customers, round(h, 4) AS avg_journey_hours,
    CAST(round(CAST(r / c AS DECIMAL(18,4)), 2) AS DOUBLE) AS revenue_per_customer, CAST(round(CAST(r / sum(r) OVER () * 100 AS DECIMAL(18,4)), 2) AS DOUBLE) AS recommended_budget_percentage
    FROM (SELECT first_touch_channel, sum(total_attributed_revenue) AS r, count(DISTINCT customer_email) AS c, avg(journey_duration_hours) AS h {_ATT30} GROUP BY 1)""",
    digits=4,
)
def budget(t: Tables) -> DataFrame:
    return op.budget_share(attribution(t), EVENT_AS_OF)


@query(
    "A39_clv_by_channel_pair",
    f"""SELECT first_touch_channel, last_touch_channel, count(*) AS customer_count, round(avg(v), 4) AS avg_customer_clv, round(sum(v), 4) AS total_channel_clv, round(avg(n), 4) AS avg_orders_per_customer
    FROM attribution JOIN (SELECT customer_email, sum(total_attributed_revenue) AS v, count(DISTINCT order_id) AS n FROM attribution GROUP BY 1) USING (customer_email)
    WHERE date >= {EV} - 90 GROUP BY 1, 2""",
    digits=4,
)
def clv_pairs(t: Tables) -> DataFrame:
    return op.clv_by_channel_pair(attribution(t), EVENT_AS_OF)


@query(
    "A40_campaign_totals",
    f"""SELECT ads_campaign_id, email_campaign_id, date AS attribution_date, round(sum(ads_attributed_revenue), 4) AS ads_total_attributed,
    round(sum(email_attributed_revenue), 4) AS email_total_attributed, count(DISTINCT order_id) AS attributed_orders FROM attribution WHERE date >= {EV} - 90 GROUP BY 1, 2, 3""",
    digits=4,
)
def campaign_totals(t: Tables) -> DataFrame:
    return op.campaign_totals(attribution(t), EVENT_AS_OF)


@query(
    "A19_ad_attribution_weight",
    """SELECT ads_campaign_id AS campaign_id, round(sum(total_attributed_revenue * CASE WHEN first_touch_channel = 'facebook' OR last_touch_channel = 'facebook' THEN 0.4 ELSE 0.2 END), 4) AS attributed_revenue,
    round(sum(total_attributed_revenue), 4) AS total_revenue FROM attribution WHERE ads_campaign_id IS NOT NULL GROUP BY 1""",
    digits=4,
)
def ad_credit(t: Tables) -> DataFrame:
    return op.ad_credit(attribution(t))


@query("W07_last_campaign_per_channel", "SELECT order_id, ads_campaign_id, email_campaign_id FROM attribution WHERE touchpoint_count > 0")
def last_campaigns(t: Tables) -> DataFrame:
    return op.last_campaigns(touches(t))


@query(
    "W09_weekly_order_velocity",
    "SELECT order_id, CAST(date_trunc('week', date) AS DATE) AS week, count(*) OVER (PARTITION BY date_trunc('week', date)) AS weekly_order_velocity FROM attribution",
)
def weekly(t: Tables) -> DataFrame:
    return op.weekly_velocity(attribution(t))


@query(
    "P27_revenue_shares",
    """SELECT order_id, CASE WHEN first_touch_channel = last_touch_channel THEN 'single_touch' ELSE 'multi_touch' END AS attribution_complexity,
    CAST(round(CAST(ads_attributed_revenue / nullif(total_attributed_revenue, 0) * 100 AS DECIMAL(18,4)), 2) AS DOUBLE) AS ads_attribution_percentage,
    CAST(round(CAST(email_attributed_revenue / nullif(total_attributed_revenue, 0) * 100 AS DECIMAL(18,4)), 2) AS DOUBLE) AS email_attribution_percentage FROM attribution""",
)
def shares(t: Tables) -> DataFrame:
    return op.revenue_shares(attribution(t))


@query(
    "P28_journey_scores",
    """SELECT order_id, round(total_attributed_revenue / nullif(ads_touches + email_touches, 0), 6) AS revenue_per_touchpoint,
    CASE WHEN touchpoint_count = 1 THEN 'simple' WHEN touchpoint_count BETWEEN 2 AND 4 THEN 'moderate' ELSE 'complex' END AS journey_complexity,
    CAST(CASE WHEN first_touch_channel = last_touch_channel THEN 0.9 WHEN touchpoint_count <= 3 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS attribution_confidence FROM attribution""",
)
def scores(t: Tables) -> DataFrame:
    return op.journey_scores(attribution(t))


@query(
    "P29_journey_bins",
    """SELECT order_id, CASE WHEN touchpoint_count <= 0 THEN NULL WHEN touchpoint_count <= 1 THEN 'simple' WHEN touchpoint_count <= 3 THEN 'moderate' WHEN touchpoint_count <= 10 THEN 'complex' END AS journey_complexity,
    CAST(CASE WHEN first_touch_channel = last_touch_channel THEN 0.9 ELSE 0.7 END AS DOUBLE) AS attribution_confidence FROM attribution""",
)
def bins(t: Tables) -> DataFrame:
    return op.journey_bins(attribution(t))


@query(
    "A58_clv_weighted_demand",
    """SELECT product_id, round(sum(demand * clv) / nullif(sum(clv), 0), 4) AS clv_weighted_demand FROM (SELECT product_id, seg, count(*) AS demand, avg(v) AS clv
    FROM attribution JOIN (SELECT customer_email, sum(total_attributed_revenue) AS v,
      CASE WHEN count(*) = 1 THEN 'new_customer' WHEN count(*) <= 5 THEN 'returning_customer' ELSE 'loyal_customer' END AS seg FROM attribution GROUP BY 1) USING (customer_email) GROUP BY 1, 2) GROUP BY 1""",
    digits=4,
)
def clv_demand(t: Tables) -> DataFrame:
    return op.clv_weighted_demand(attribution(t))


@query(
    "M10_channel_safety_stock",
    """SELECT product_id, round(n / 30 * 14, 4) AS base_safety_stock, round(rv / nullif(r, 0), 4) AS volatility_multiplier, round(n / 30 * 14 * rv / nullif(r, 0), 4) AS channel_safety_stock
    FROM (SELECT product_id, count(*) AS n, sum(total_attributed_revenue) AS r, sum(total_attributed_revenue * CASE coalesce(last_touch_channel, 'organic') WHEN 'facebook' THEN 1.3 WHEN 'email' THEN 2.0 ELSE 1.0 END) AS rv
      FROM attribution GROUP BY 1)""",
    digits=4,
)
def channel_safety(t: Tables) -> DataFrame:
    return op.channel_safety_stock(attribution(t))


@query(
    "A54_attribution_kpis",
    """SELECT date, round(sum(ads_attributed_revenue + email_attributed_revenue) / nullif(sum(total_attributed_revenue), 0), 4) AS attribution_accuracy, round(avg(touchpoint_count), 4) AS journey_complexity,
    round(avg(journey_duration_hours), 4) AS time_to_conversion, round(avg(CASE WHEN touchpoint_count > 1 THEN 1.0 ELSE 0.0 END), 4) AS channel_assist_rate,
    round(sum(ads_attributed_revenue + email_attributed_revenue) / nullif(sum(touchpoint_count), 0), 4) AS revenue_per_touchpoint FROM attribution GROUP BY 1""",
    digits=4,
)
def kpis(t: Tables) -> DataFrame:
    return op.attribution_kpis(attribution(t))
