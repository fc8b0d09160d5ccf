"""Ads and e-mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..operators import marketing as op
from ..sources.tables import EVENT_AS_OF, Tables
from .registry import query
from .sqltext import EV, define

define(
    "ad_rows",
    """SELECT *, CASE WHEN impressions > 0 THEN clicks / impressions * 100 ELSE 0 END AS ctr, CASE WHEN clicks > 0 THEN spend / clicks ELSE 0 END AS cpc,
    CASE WHEN impressions > 0 THEN spend / impressions * 1000 ELSE 0 END AS cpm, CASE WHEN spend > 0 THEN purchase_value / spend ELSE 0 END AS roas,
    CASE WHEN impressions > 0 THEN view_content / impressions * 100 ELSE 0 END AS view_content_rate, CASE WHEN view_content > 0 THEN add_to_cart / view_content * 100 ELSE 0 END AS add_to_cart_rate,
    CASE WHEN add_to_cart > 0 THEN initiate_checkout / add_to_cart * 100 ELSE 0 END AS checkout_rate, CASE WHEN initiate_checkout > 0 THEN purchases / initiate_checkout * 100 ELSE 0 END AS purchase_rate,
    CASE WHEN purchases > 0 THEN spend / purchases END AS cost_per_acquisition FROM ads""",
)
define(
    "mail_rows",
    """SELECT *, CASE WHEN recipients > 0 THEN delivered / recipients * 100 ELSE 0 END AS delivery_rate, CASE WHEN delivered > 0 THEN unique_opens / delivered * 100 ELSE 0 END AS open_rate,
    CASE WHEN unique_opens > 0 THEN unique_clicks / unique_opens * 100 ELSE 0 END AS click_to_open_rate, CASE WHEN delivered > 0 THEN unique_clicks / delivered * 100 ELSE 0 END AS click_rate,
    CASE WHEN delivered > 0 THEN unsubscribes / delivered * 100 ELSE 0 END AS unsubscribe_rate, CASE WHEN recipients > 0 THEN attributed_revenue / recipients ELSE 0 END AS revenue_per_recipient,
    CASE WHEN unique_clicks > 0 THEN attributed_revenue / unique_clicks ELSE 0 END AS revenue_per_click, CASE WHEN attributed_orders > 0 THEN attributed_revenue / attributed_orders ELSE 0 END AS average_order_value
    FROM email""",
)
define(
    "ad_listed",
    """SELECT * EXCLUDE (product_id, items), CAST(json_extract_string(unnest(items), '$.product_id') AS BIGINT) AS listed_id, len(items) AS listed
    FROM (SELECT *, from_json(attributed_products, '["JSON"]') AS items FROM ad_rows WHERE attributed_products IS NOT NULL)""",
)
define(
    "mail_listed",
    """SELECT * EXCLUDE (product_id, items, item), CAST(json_extract_string(item, '$.product_id') AS BIGINT) AS listed_id, CAST(json_extract_string(item, '$.featured_position') AS BIGINT) AS position, len(items) AS listed
    FROM (SELECT *, unnest(items) AS item FROM (SELECT *, from_json(featured_products, '["JSON"]') AS items FROM mail_rows WHERE featured_products IS NOT NULL))""",
)


def mail_by_message(t: Tables) -> DataFrame:
    """One row per date and campaign or flow, with rates from sums."""
    return t.email.groupBy("date", "campaign_id", "flow_id").agg(
        (ratio(F.sum("unique_opens"), F.sum("delivered")) * 100).alias("open_rate"),
        (ratio(F.sum("unique_clicks"), F.sum("delivered")) * 100).alias("click_rate"),
    )


@query(
    "P09_ad_metrics",
    """SELECT date, ad_id, round(ctr, 6) AS ctr, round(cpc, 6) AS cpc, round(cpm, 6) AS cpm, round(roas, 6) AS roas, round(view_content_rate, 6) AS view_content_rate, round(add_to_cart_rate, 6) AS add_to_cart_rate,
    round(checkout_rate, 6) AS checkout_rate, round(purchase_rate, 6) AS purchase_rate, round(cost_per_acquisition, 6) AS cost_per_acquisition FROM ad_rows""",
)
def ad_metrics(t: Tables) -> DataFrame:
    return op.ad_metrics(t.ads).select(
        "date", "ad_id", "ctr", "cpc", "cpm", "roas", "view_content_rate", "add_to_cart_rate", "checkout_rate", "purchase_rate", "cost_per_acquisition"
    )


@query(
    "P10_ad_classes",
    """SELECT date, ad_id, CASE WHEN roas >= 4 THEN 'high_performance' WHEN roas >= 2 THEN 'medium_performance' WHEN roas >= 1 THEN 'low_performance' WHEN roas > 0 THEN 'break_even' ELSE 'loss_making' END AS performance_category,
    CASE WHEN ctr >= 2 THEN 'high_engagement' WHEN ctr >= 1 THEN 'medium_engagement' WHEN ctr >= 0.5 THEN 'low_engagement' ELSE 'poor_engagement' END AS engagement_quality FROM ad_rows""",
)
def ad_classes(t: Tables) -> DataFrame:
    return op.ad_classes(t.ads).select("date", "ad_id", "performance_category", "engagement_quality")


@query(
    "P11_mail_metrics",
    """SELECT date, segment_name, round(delivery_rate, 6) AS delivery_rate, round(open_rate, 6) AS open_rate, round(click_to_open_rate, 6) AS click_to_open_rate, round(click_rate, 6) AS click_rate,
    round(unsubscribe_rate, 6) AS unsubscribe_rate, round(revenue_per_recipient, 6) AS revenue_per_recipient, round(revenue_per_click, 6) AS revenue_per_click, round(average_order_value, 6) AS average_order_value FROM mail_rows""",
)
def mail_metrics(t: Tables) -> DataFrame:
    return op.mail_metrics(t.email).select(
        "date", "segment_name", "delivery_rate", "open_rate", "click_to_open_rate", "click_rate", "unsubscribe_rate", "revenue_per_recipient", "revenue_per_click", "average_order_value"
    )


@query(
    "P12_mail_classes",
    """SELECT date, segment_name, CASE WHEN open_rate >= 25 AND click_rate >= 3 THEN 'high_engagement' WHEN open_rate >= 20 AND click_rate >= 2 THEN 'medium_engagement'
    WHEN open_rate >= 15 AND click_rate >= 1 THEN 'low_engagement' ELSE 'poor_engagement' END AS engagement_quality,
    CASE WHEN revenue_per_recipient >= 1 THEN 'high_value' WHEN revenue_per_recipient >= 0.5 THEN 'medium_value' WHEN revenue_per_recipient >= 0.1 THEN 'low_value' ELSE 'minimal_value' END AS revenue_performance,
    CASE WHEN extract(dow FROM date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type FROM mail_rows""",
)
def mail_classes(t: Tables) -> DataFrame:
    return op.mail_classes(t.email).select("date", "segment_name", "engagement_quality", "revenue_performance", "day_type")


@query(
    "A03_ad_product_performance",
    """SELECT date, listed_id AS product_id, campaign_name, round(sum(spend / listed), 4) AS total_spend, round(sum(impressions / listed), 4) AS total_impressions, round(sum(clicks / listed), 4) AS total_clicks,
    round(sum(purchases / listed), 4) AS total_purchases, round(sum(purchase_value / listed), 4) AS total_purchase_value, round(avg(ctr), 4) AS avg_ctr, round(avg(cpc), 4) AS avg_cpc, round(avg(roas), 4) AS avg_roas,
    round(sum(spend / listed) / nullif(sum(purchases / listed), 0), 4) AS cost_per_purchase FROM ad_listed GROUP BY 1, 2, 3""",
    digits=4,
)
def ad_product(t: Tables) -> DataFrame:
    return op.ad_product_performance(t.ads)


@query(
    "A04_campaign_audience",
    """SELECT campaign_id, campaign_name, date AS campaign_date, age_range, gender, country, round(sum(spend), 4) AS daily_spend, CAST(sum(impressions) AS BIGINT) AS daily_impressions, CAST(sum(clicks) AS BIGINT) AS daily_clicks,
    CAST(sum(purchases) AS BIGINT) AS daily_purchases, round(sum(purchase_value), 4) AS daily_purchase_value, round(sum(clicks) * 100 / nullif(sum(impressions), 0), 4) AS ctr_percent,
    round(sum(spend) / nullif(sum(clicks), 0), 4) AS cpc, round(sum(purchase_value) / nullif(sum(spend), 0), 4) AS roas, round(sum(purchases) * 100 / nullif(sum(clicks), 0), 4) AS conversion_rate
    FROM ads GROUP BY ALL""",
    digits=4,
)
def campaign_audience(t: Tables) -> DataFrame:
    return op.ad_campaign_audience(t.ads)


@query(
    "A05_mail_product_performance",
    """SELECT date, listed_id AS product_id, campaign_name, flow_name, message_type, round(sum(recipients / listed), 4) AS total_recipients, round(sum(opens / listed), 4) AS total_opens, round(sum(clicks / listed), 4) AS total_clicks,
    round(sum(attributed_revenue / listed), 4) AS total_attributed_revenue, round(sum(attributed_orders / listed), 4) AS total_attributed_orders, round(avg(open_rate), 4) AS avg_open_rate, round(avg(click_rate), 4) AS avg_click_rate,
    round(sum(attributed_revenue / listed) / nullif(sum(recipients / listed), 0), 4) AS revenue_per_recipient, round(sum(attributed_revenue / listed) / nullif(sum(opens / listed), 0), 4) AS revenue_per_open
    FROM mail_listed GROUP BY 1, 2, 3, 4, 5""",
    digits=4,
)
def mail_product(t: Tables) -> DataFrame:
    return op.mail_product_performance(t.email)


_JOINED = f"""FROM customers c LEFT JOIN email m ON c.email = m.segment_name WHERE m.date >= {EV} - 10 OR m.date IS NULL"""


@query(
    "J20_customer_mail_join",
    f"SELECT c.email, m.date AS mail_date, m.opens, m.clicks {_JOINED}",
)
def customer_mail(t: Tables) -> DataFrame:
    return op.customer_mail_join(t.customers, t.email, EVENT_AS_OF, 10).select("email", "mail_date", "opens", "clicks")


@query(
    "A06_customer_engagement",
    f"""SELECT c.email, customer_segment, lifecycle_stage, total_orders, round(total_spent, 4) AS total_spent, email_engagement_score, count(m.date) AS emails_received_30d, CAST(sum(opens) AS BIGINT) AS total_opens_30d,
    CAST(sum(clicks) AS BIGINT) AS total_clicks_30d, round(sum(attributed_revenue), 4) AS email_attributed_revenue_30d, round(sum(opens) * 100 / nullif(count(m.date), 0), 4) AS open_rate_30d,
    round(sum(clicks) * 100 / nullif(sum(opens), 0), 4) AS click_through_rate_30d {_JOINED.replace("- 10", "- 30")} GROUP BY c.email, customer_segment, lifecycle_stage, total_orders, total_spent, email_engagement_score""",
    digits=4,
)
def engagement(t: Tables) -> DataFrame:
    return op.customer_engagement(t.customers, t.email, EVENT_AS_OF)


@query(
    "A09_demand_signals",
    """SELECT DATE '2024-01-30' AS date, product_id, CASE WHEN coalesce(b, 0) + coalesce(o, 0) > 20 THEN 'high' WHEN coalesce(b, 0) + coalesce(o, 0) > 10 THEN 'medium' ELSE 'low' END AS external_demand,
    round(coalesce(r, 0) / 10, 6) AS market_trend, round(coalesce(op, 0) / 100, 6) AS social_sentiment
    FROM products JOIN (SELECT coalesce(x.listed_id, y.listed_id) AS id, b, r, o, op FROM
      (SELECT listed_id, sum(purchases / listed) AS b, avg(roas) AS r FROM ad_listed WHERE date = DATE '2024-01-30' GROUP BY 1) x
      FULL JOIN (SELECT listed_id, sum(attributed_orders / listed) AS o, avg(open_rate) AS op FROM mail_listed WHERE date = DATE '2024-01-30' GROUP BY 1) y USING (listed_id)) s ON s.id = product_id""",
)
def demand_signals(t: Tables) -> DataFrame:
    return op.demand_signals(t.products, t.ads, t.email, "2024-01-30")


@query(
    "A13_mail_campaigns",
    """SELECT campaign_name, CAST(sum(recipients) AS BIGINT) AS total_recipients, round(avg(open_rate), 4) AS avg_open_rate, round(avg(click_rate), 4) AS avg_click_rate, round(sum(attributed_revenue), 4) AS total_revenue,
    round(sum(attributed_revenue) / nullif(sum(recipients), 0), 4) AS revenue_per_recipient FROM mail_rows WHERE message_type = 'campaign' GROUP BY 1""",
    digits=4,
)
def mail_campaigns(t: Tables) -> DataFrame:
    return op.mail_campaigns(t.email)


@query(
    "A14_ad_roas_first_product",
    """SELECT CAST(json_extract_string(attributed_products, '$[0].product_id') AS BIGINT) AS product_id, campaign_name, round(sum(spend), 4) AS total_spend, round(sum(purchase_value), 4) AS total_revenue,
    round(sum(purchase_value) / nullif(sum(spend), 0), 4) AS roas FROM ads WHERE attributed_products IS NOT NULL GROUP BY 1, 2""",
    digits=4,
)
def roas_first(t: Tables) -> DataFrame:
    return op.ad_roas_first_product(t.ads)


@query(
    "A15_campaign_daily",
    """SELECT date, campaign_id, campaign_name, round(sum(spend), 4) AS total_spend, CAST(sum(impressions) AS BIGINT) AS total_impressions, CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(purchases) AS BIGINT) AS total_purchases,
    round(sum(purchase_value), 4) AS total_purchase_value, round(avg(ctr), 4) AS avg_ctr, round(avg(roas), 4) AS avg_roas FROM ad_rows GROUP BY 1, 2, 3""",
    digits=4,
)
def campaign_daily(t: Tables) -> DataFrame:
    return op.campaign_daily(t.ads)


@query("A16_ad_allocation", "SELECT date, campaign_id, ad_id, listed_id AS product_id, round(spend / listed, 6) AS allocated_spend FROM ad_listed")
def allocation(t: Tables) -> DataFrame:
    return op.ad_allocation(t.ads)


@query(
    "A17_audience_performance",
    """SELECT age_range, gender, country, count(*) AS ad_count, round(sum(spend), 4) AS total_spend, round(sum(purchase_value), 4) AS total_revenue, round(avg(roas), 4) AS avg_roas, round(avg(ctr), 4) AS avg_ctr
    FROM ad_rows WHERE spend > 0 GROUP BY 1, 2, 3 HAVING sum(spend) > 100""",
    digits=4,
)
def audience(t: Tables) -> DataFrame:
    return op.audience_performance(t.ads)


@query(
    "A18_campaign_averages",
    f"""SELECT campaign_id, round(avg(s), 4) AS avg_daily_spend, round(avg(r), 4) AS avg_daily_revenue, round(avg(r / nullif(s, 0)), 4) AS avg_roas
    FROM (SELECT date, campaign_id, sum(spend) AS s, sum(purchase_value) AS r FROM ads WHERE date >= {EV} - 30 GROUP BY 1, 2) GROUP BY 1""",
    digits=4,
)
def campaign_averages(t: Tables) -> DataFrame:
    return op.campaign_averages(t.ads, EVENT_AS_OF)


def _m(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,4)), 2) AS DOUBLE)"


@query(
    "A20_campaign_vs_flow",
    f"""SELECT message_type, count(*) AS total_sends, {_m('avg(open_rate)')} AS avg_open_rate, {_m('avg(click_rate)')} AS avg_click_rate, {_m('avg(revenue_per_recipient)')} AS avg_revenue_per_recipient,
    round(sum(attributed_revenue), 4) AS total_attributed_revenue FROM mail_rows WHERE date >= {EV} - 30 GROUP BY 1""",
    digits=4,
)
def campaign_vs_flow(t: Tables) -> DataFrame:
    return op.message_type_summary(t.email, EVENT_AS_OF)


@query(
    "A21_mail_mentions",
    """SELECT listed_id AS product_id, count(*) AS email_mentions, round(sum(attributed_revenue / listed), 4) AS total_email_attributed_revenue, round(sum(unique_clicks / listed), 4) AS total_email_clicks,
    round(avg(position), 4) AS avg_featured_position FROM mail_listed GROUP BY 1""",
    digits=4,
)
def mentions(t: Tables) -> DataFrame:
    return op.mail_mentions(t.email)


@query(
    "A22_mail_segments",
    f"""SELECT segment_name, message_type, count(*) AS email_count, round(avg(open_rate), 4) AS avg_open_rate, round(avg(click_rate), 4) AS avg_click_rate, round(avg(revenue_per_recipient), 4) AS avg_revenue_per_recipient,
    round(sum(attributed_revenue), 4) AS total_revenue, CAST(sum(recipients) AS BIGINT) AS total_recipients FROM mail_rows WHERE segment_name IS NOT NULL AND date >= {EV} - 90 GROUP BY 1, 2 HAVING sum(recipients) > 100""",
    digits=4,
)
def mail_segments(t: Tables) -> DataFrame:
    return op.mail_segments(t.email, EVENT_AS_OF)


@query(
    "A31_channel_summary",
    f"""SELECT date, channel, campaign_identifier, campaign_name, flow_name, round(spend, 4) AS spend, impressions, clicks, round(attributed_revenue, 4) AS attributed_revenue, attributed_conversions, round(roas, 4) AS roas,
    CASE WHEN clicks > 0 THEN round(spend / clicks, 4) ELSE 0 END AS cost_per_click, CASE WHEN attributed_conversions > 0 THEN round(spend / attributed_conversions, 4) ELSE 0 END AS cost_per_acquisition,
    CASE WHEN impressions > 0 THEN round(clicks / impressions * 100, 4) ELSE 0 END AS click_through_rate_percentage FROM (
    SELECT date, 'facebook' AS channel, campaign_id AS campaign_identifier, campaign_name, CAST(NULL AS VARCHAR) AS flow_name, sum(spend) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
      sum(purchase_value) AS attributed_revenue, CAST(sum(purchases) AS BIGINT) AS attributed_conversions, avg(roas) AS roas FROM ad_rows WHERE date >= {EV} - 7 GROUP BY ALL
    UNION ALL SELECT date, 'email', coalesce(campaign_id, flow_id), coalesce(campaign_name, flow_name), flow_name, 0, 0, unique_clicks, attributed_revenue, attributed_orders,
      CASE WHEN recipients > 0 THEN attributed_revenue / recipients * 1000 ELSE 0 END FROM email WHERE date >= {EV} - 7)""",
    digits=4,
)
def channel_summary(t: Tables) -> DataFrame:
    return op.channel_summary(t.ads, t.email, EVENT_AS_OF)


@query(
    "A54_ad_kpis",
    """SELECT campaign_id, round(sum(purchase_value) / nullif(sum(spend), 0), 4) AS roas, round(sum(spend) / nullif(sum(purchases), 0), 4) AS cpa, round(sum(clicks) / nullif(sum(impressions), 0) * 100, 4) AS ctr,
    round(sum(purchases) / nullif(sum(clicks), 0) * 100, 4) AS conversion_rate, round(sum(spend) / nullif(sum(clicks), 0), 4) AS cpc, round(sum(spend) / nullif(sum(impressions), 0) * 1000, 4) AS cpm,
    round(sum(impressions) / nullif(sum(reach), 0), 4) AS frequency FROM ads GROUP BY 1""",
    digits=4,
)
def ad_kpis(t: Tables) -> DataFrame:
    return op.ad_kpis(t.ads)


@query(
    "A54_mail_kpis",
    """SELECT message_type, round(avg(open_rate), 4) AS open_rate, round(avg(click_rate), 4) AS click_rate, round(avg(revenue_per_recipient), 4) AS revenue_per_recipient, round(avg(click_to_open_rate), 4) AS click_to_open_rate,
    round(avg(unsubscribe_rate), 4) AS unsubscribe_rate, round(avg(open_rate) * 0.3 + avg(click_rate) * 0.7, 4) AS engagement_score FROM mail_rows GROUP BY 1""",
    digits=4,
)
def mail_kpis(t: Tables) -> DataFrame:
    return op.mail_kpis(t.email)


