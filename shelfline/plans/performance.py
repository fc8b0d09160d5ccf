"""Product-by-day performance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as attr
from ..operators import performance as op
from ..session import cut, scratch
from ..sources.tables import EVENT_AS_OF, Tables
from ..sources.versions import Versions
from .registry import query
from .sqltext import EV, define

DAY = "2024-01-30"


def _m(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,4)), 2) AS DOUBLE)"


def _r(cols: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols.split())


define(
    "perf_rates",
    """SELECT *, CASE WHEN marketing_roas >= 4 THEN 'high_performance' WHEN marketing_roas >= 2 THEN 'medium_performance' WHEN marketing_roas >= 1 THEN 'low_performance' WHEN marketing_roas > 0 THEN 'break_even' ELSE 'loss_making' END AS marketing_performance_category,
    CASE WHEN total_units_sold >= 10 THEN 'high_velocity' WHEN total_units_sold >= 5 THEN 'medium_velocity' WHEN total_units_sold >= 1 THEN 'low_velocity' ELSE 'no_sales' END AS sales_velocity_category,
    total_units_sold AS daily_demand_velocity, orders AS daily_order_frequency, CASE WHEN total_product_revenue > 0 THEN net_profit / total_product_revenue ELSE 0 END AS net_profit_margin
    FROM (SELECT *, CASE WHEN total_product_revenue > 0 THEN revenue / total_product_revenue * 100 ELSE 0 END AS organic_revenue_percentage,
      CASE WHEN total_product_revenue > 0 THEN ads_attributed_revenue / total_product_revenue * 100 ELSE 0 END AS ads_revenue_percentage,
      CASE WHEN total_product_revenue > 0 THEN email_attributed_revenue / total_product_revenue * 100 ELSE 0 END AS email_revenue_percentage,
      CASE WHEN inventory_level > 0 THEN total_units_sold / inventory_level END AS inventory_turnover_rate,
      CASE WHEN total_units_sold > 0 THEN inventory_cost / total_units_sold ELSE inventory_cost END AS cost_per_unit_sold, total_product_revenue * profit_margin - total_marketing_spend AS net_profit
      FROM (SELECT *, CASE WHEN total_marketing_spend > 0 THEN total_attributed_revenue / total_marketing_spend END AS marketing_roas, CASE WHEN total_attributed_units > 0 THEN total_marketing_spend / total_attributed_units END AS cost_per_acquisition,
        CASE WHEN ads_spend > 0 THEN ads_attributed_revenue / ads_spend END AS ads_roas, CASE WHEN emails_sent > 0 THEN email_attributed_revenue / emails_sent ELSE 0 END AS revenue_per_email,
        revenue + total_attributed_revenue AS total_product_revenue, units_sold + total_attributed_units AS total_units_sold, CASE WHEN orders > 0 THEN units_sold / orders ELSE 0 END AS units_per_order FROM performance) a) b""",
)


@query(
    "P13_performance_rates",
    f"""SELECT date, product_id, {_r('marketing_roas cost_per_acquisition ads_roas revenue_per_email total_product_revenue')}, total_units_sold, {_r('units_per_order organic_revenue_percentage ads_revenue_percentage email_revenue_percentage inventory_turnover_rate cost_per_unit_sold net_profit net_profit_margin')} FROM perf_rates""",
)
def rates(t: Tables) -> DataFrame:
    return op.with_rates(t.performance).select(
        "date", "product_id", "marketing_roas", "cost_per_acquisition", "ads_roas", "revenue_per_email", "total_product_revenue", "total_units_sold", "units_per_order",
        "organic_revenue_percentage", "ads_revenue_percentage", "email_revenue_percentage", "inventory_turnover_rate", "cost_per_unit_sold", "net_profit", "net_profit_margin",
    )


@query("P14_performance_classes", "SELECT date, product_id, marketing_performance_category, sales_velocity_category FROM perf_rates")
def classes(t: Tables) -> DataFrame:
    return op.with_rates(t.performance).select("date", "product_id", "marketing_performance_category", "sales_velocity_category")


@query(
    "P15_channel_enrichment",
    """SELECT date, product_id, round(ads_attributed_revenue / nullif(ads_spend, 0), 6) AS ads_roas, round(email_attributed_revenue / nullif(emails_sent * CAST(0.01 AS DOUBLE), 0), 6) AS email_roi_per_send,
    round(total_attributed_revenue / nullif(total_marketing_spend, 0), 6) AS overall_marketing_roas, round(organic_revenue / nullif(revenue, 0) * 100, 6) AS organic_revenue_percentage, units_sold + total_attributed_units AS total_demand_velocity,
    CASE WHEN ads_attributed_revenue > email_attributed_revenue THEN 'facebook_driven' WHEN email_attributed_revenue > ads_attributed_revenue THEN 'email_driven' WHEN ads_attributed_revenue > 0 THEN 'balanced' ELSE 'organic_driven' END AS primary_channel FROM performance""",
)
def enrichment(t: Tables) -> DataFrame:
    return op.channel_enrichment(t.performance)


define("day_sales", "SELECT date, product_id, CAST(sum(quantity_sold) AS BIGINT) AS units_sold, sum(revenue) AS revenue, count(*) AS orders, count(DISTINCT customer_id) AS customers, avg(revenue / quantity_sold) AS avg_selling_price FROM sales GROUP BY 1, 2")
define("day_ads", "SELECT date, listed_id AS product_id, sum(spend / listed) AS ads_spend, sum(impressions / listed) AS ads_impressions, sum(clicks / listed) AS ads_clicks, sum(purchase_value / listed) AS ads_revenue, avg(roas) AS ads_avg_roas FROM ad_listed GROUP BY 1, 2")
define("day_mail", "SELECT date, listed_id AS product_id, sum(recipients / listed) AS email_recipients, sum(opens / listed) AS email_opens, sum(clicks / listed) AS email_clicks, sum(attributed_revenue / listed) AS email_revenue FROM mail_listed GROUP BY 1, 2")

define(
    "unified_day",
    f"""SELECT *, revenue + ads_revenue + email_revenue AS total_attributed_revenue, ads_spend AS total_marketing_spend, (revenue + ads_revenue + email_revenue) / nullif(ads_spend, 0) AS overall_roas,
    CASE WHEN units_sold > 100 THEN 'high' WHEN units_sold > 50 THEN 'medium' ELSE 'low' END AS demand_level, DATE '{DAY}' AS analysis_date
    FROM (SELECT p.product_id, name AS product_name, category, coalesce(units_sold, 0) AS units_sold, coalesce(revenue, 0) AS revenue, coalesce(orders, 0) AS orders, coalesce(customers, 0) AS customers,
      coalesce(ads_spend, 0) AS ads_spend, coalesce(ads_impressions, 0) AS ads_impressions, coalesce(ads_clicks, 0) AS ads_clicks, coalesce(ads_revenue, 0) AS ads_revenue, coalesce(ads_avg_roas, 0) AS ads_avg_roas,
      coalesce(email_recipients, 0) AS email_recipients, coalesce(email_opens, 0) AS email_opens, coalesce(email_clicks, 0) AS email_clicks, coalesce(email_revenue, 0) AS email_revenue
      FROM products p LEFT JOIN (SELECT * FROM day_sales WHERE date = DATE '{DAY}') s ON s.product_id = p.product_id LEFT JOIN (SELECT * FROM day_ads WHERE date = DATE '{DAY}') a ON a.product_id = p.product_id
      LEFT JOIN (SELECT * FROM day_mail WHERE date = DATE '{DAY}') m ON m.product_id = p.product_id) u""",
)
_UD = "revenue ads_spend ads_impressions ads_clicks ads_revenue ads_avg_roas email_recipients email_opens email_clicks email_revenue total_attributed_revenue total_marketing_spend overall_roas"


@query("J02_unified_product_performance", f"SELECT product_id, product_name, category, analysis_date, units_sold, orders, customers, demand_level, {_r(_UD, 4)} FROM unified_day", digits=4)
def unified_day(t: Tables) -> DataFrame:
    return op.unified_day(t.products, t.sales, t.ads, t.email, DAY)


@query(
    "A08_performance_build",
    f"""SELECT analysis_date AS date, product_id, units_sold, orders, {_r('revenue ads_spend ads_impressions ads_clicks ads_revenue email_recipients email_opens email_revenue total_marketing_spend total_attributed_revenue', 4)}, round(overall_roas, 4) AS marketing_roas FROM unified_day""",
    digits=4,
)
def build(t: Tables) -> DataFrame:
    u = unified_day(t)
    return u.select(
        F.col("analysis_date").alias("date"), "product_id", "units_sold", "revenue", "orders", "ads_spend", "ads_impressions", "ads_clicks", "ads_revenue", "email_recipients", "email_opens",
        "email_revenue", "total_marketing_spend", "total_attributed_revenue", F.col("overall_roas").alias("marketing_roas"),
    )


@query(
    "S17_daily_summary_table",
    f"SELECT analysis_date AS summary_date, product_id, units_sold, {_r('revenue ads_spend ads_revenue email_revenue total_attributed_revenue overall_roas', 4)}, demand_level FROM unified_day",
    digits=4,
)
def summary(t: Tables) -> DataFrame:
    return op.summary_table(unified_day(t))


@query(
    "S17_incremental_summary",
    """SELECT date, count(*) AS products, CAST(sum(units_sold) AS BIGINT) AS units_sold, round(sum(revenue * CASE WHEN day(date) % 7 = 0 THEN 2 ELSE 1 END), 4) AS revenue, round(sum(total_marketing_spend), 4) AS spend,
    round(sum(total_attributed_revenue), 4) AS attributed, round(sum(total_attributed_revenue) / nullif(sum(total_marketing_spend), 0), 4) AS roas, day(date) % 7 = 0 AS rebuilt FROM performance WHERE date IS NOT NULL AND date <> DATE '2024-01-05' GROUP BY date""",
    digits=4,
)
def incremental_summary(t: Tables) -> DataFrame:
    """A stored summary per day; then every seventh day is restated and one day withdrawn at the source, and the summary
    builds only those again."""
    from ..streaming import jobs

    source, table = (Versions(t.spark, scratch(t.spark, n), "date") for n in ("performance", "summary"))
    rows = cut(t.performance.filter("date is not null").select("date", "product_id", "units_sold", "revenue", "total_marketing_spend", "total_attributed_revenue"), "performance")
    source.publish(source.stage(rows))
    jobs.refresh(source, table, rows, op.day_summary)
    first = table.latest()
    restated = rows.filter(F.day("date") % 7 == 0).withColumn("revenue", F.col("revenue") * 2)
    source.publish(source.stage(restated), drop=["2024-01-05"])
    jobs.refresh(source, table, rows, op.day_summary)
    before = table.manifest(first).select("value", F.col("build").alias("old"))
    again = table.manifest().join(before, "value").select(F.to_date("value").alias("date"), (F.col("build") != F.col("old")).alias("rebuilt"))
    return table.read(op.day_summary(rows)).join(again, "date")


_FO = "revenue avg_selling_price ads_spend ads_impressions ads_clicks ads_revenue email_recipients email_opens email_clicks email_revenue total_revenue ads_roas revenue_per_email_recipient"


@query(
    "J03_full_outer_daily",
    f"""SELECT date, product_id, units_sold, orders, {_r(_FO, 4)} FROM (SELECT *, revenue + ads_revenue + email_revenue AS total_revenue, CASE WHEN ads_spend > 0 THEN ads_revenue / ads_spend END AS ads_roas,
    CASE WHEN email_recipients > 0 THEN email_revenue / email_recipients END AS revenue_per_email_recipient FROM (SELECT date, product_id, coalesce(units_sold, 0) AS units_sold, coalesce(revenue, 0) AS revenue, coalesce(orders, 0) AS orders,
      avg_selling_price, coalesce(ads_spend, 0) AS ads_spend, coalesce(ads_impressions, 0) AS ads_impressions, coalesce(ads_clicks, 0) AS ads_clicks, coalesce(ads_revenue, 0) AS ads_revenue, coalesce(email_recipients, 0) AS email_recipients,
      coalesce(email_opens, 0) AS email_opens, coalesce(email_clicks, 0) AS email_clicks, coalesce(email_revenue, 0) AS email_revenue
      FROM (SELECT * FROM day_sales WHERE date >= {EV} - 30) s FULL JOIN (SELECT * FROM day_ads WHERE date >= {EV} - 30) a USING (date, product_id) FULL JOIN (SELECT * FROM day_mail WHERE date >= {EV} - 30) m USING (date, product_id)))""",
    digits=4,
)
def full_outer(t: Tables) -> DataFrame:
    return op.full_outer_daily(t.sales, t.ads, t.email, EVENT_AS_OF)


@query(
    "A12_marketing_roi",
    """SELECT date, product_id, round(ads_spend, 6) AS ads_spend, round(ads_attributed_revenue, 6) AS ads_attributed_revenue, round(email_attributed_revenue, 6) AS email_attributed_revenue,
    round((ads_attributed_revenue + email_attributed_revenue) / ads_spend, 6) AS marketing_roas FROM performance WHERE ads_spend > 0""",
)
def roi(t: Tables) -> DataFrame:
    return op.marketing_roi(t.performance)


@query(
    "W02_daily_rankings",
    f"""SELECT product_id, product_name, {_r('avg_revenue_rank avg_units_rank avg_roas_rank avg_profit_rank avg_performance_score total_30day_revenue', 4)}, CAST(u AS BIGINT) AS total_30day_units, round(avg_marketing_roas, 4) AS avg_marketing_roas FROM (
    SELECT product_id, product_name, avg(a) AS avg_revenue_rank, avg(b) AS avg_units_rank, avg(c) AS avg_roas_rank, avg(d) AS avg_profit_rank, avg(score) AS avg_performance_score, sum(total_product_revenue) AS total_30day_revenue,
      sum(total_units_sold) AS u, avg(marketing_roas) AS avg_marketing_roas FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY total_product_revenue DESC, product_id) AS a, row_number() OVER (PARTITION BY date ORDER BY total_units_sold DESC, product_id) AS b,
        row_number() OVER (PARTITION BY date ORDER BY marketing_roas DESC NULLS LAST, product_id) AS c, row_number() OVER (PARTITION BY date ORDER BY net_profit DESC, product_id) AS d,
        total_product_revenue * 0.3 + total_units_sold * coalesce(avg_selling_price, 0) * 0.3 + coalesce(marketing_roas, 0) * total_marketing_spend * 0.2 + net_profit * 0.2 AS score FROM perf_rates WHERE date >= {EV} - 30)
    GROUP BY 1, 2 ORDER BY avg_performance_score DESC, product_id LIMIT 50)""",
    digits=4,
)
def rankings(t: Tables) -> DataFrame:
    return op.rankings(t.performance, EVENT_AS_OF)


@query(
    "A24_channel_effectiveness",
    f"""SELECT product_id, product_name, product_category, round(tr, 4) AS total_revenue, CAST(tu AS BIGINT) AS total_units, {_m('ads / tr * 100')} AS ads_revenue_share, {_m('mail / tr * 100')} AS email_revenue_share, {_m('organic / tr * 100')} AS organic_revenue_share,
    {_m('roas')} AS ads_roas, {_m('per_mail')} AS email_efficiency, CASE WHEN roas >= 3 AND ads > mail THEN 'facebook' WHEN per_mail >= 0.5 AND mail > ads THEN 'email' WHEN organic > greatest(ads, mail) THEN 'organic' ELSE 'mixed' END AS best_channel
    FROM (SELECT product_id, product_name, product_category, sum(ads_attributed_revenue) AS ads, avg(ads_roas) AS roas, sum(email_attributed_revenue) AS mail, avg(revenue_per_email) AS per_mail, sum(organic_revenue) AS organic,
      sum(total_product_revenue) AS tr, sum(total_units_sold) AS tu FROM perf_rates WHERE date >= {EV} - 90 GROUP BY 1, 2, 3) WHERE tr > 100""",
    digits=4,
)
def effectiveness(t: Tables) -> DataFrame:
    return op.channel_effectiveness(t.performance, EVENT_AS_OF)


_TREND = "CASE WHEN recent > before * 1.2 THEN 'increasing' WHEN recent < before * 0.8 THEN 'decreasing' ELSE 'stable' END"
_MKT = "CASE WHEN roas > 3 AND recent > 0 THEN 'increase_marketing' WHEN roas < 1.5 THEN 'reduce_marketing' WHEN roas BETWEEN 1.5 AND 3 THEN 'optimize_marketing' ELSE 'no_marketing_data' END"


@query(
    "A25_inventory_insight",
    f"""SELECT product_id, product_name, {_r('recent_avg_daily_demand recent_avg_roas recent_avg_profit_margin historical_avg_daily_demand')}, current_inventory, round(vol, 6) AS demand_volatility, days_with_sales, {_TREND} AS demand_trend,
    CASE WHEN current_inventory / nullif(recent, 0) < 7 AND roas > 2 THEN 'increase_stock' WHEN current_inventory / nullif(recent, 0) > 30 AND roas < 1.5 THEN 'reduce_stock' WHEN vol > recent * 0.5 THEN 'monitor_closely' ELSE 'maintain_current' END AS inventory_recommendation,
    round(current_inventory / nullif(recent, 0), 6) AS days_of_inventory, {_MKT} AS marketing_recommendation
    FROM (SELECT *, recent_avg_daily_demand AS recent, historical_avg_daily_demand AS before, recent_avg_roas AS roas FROM (SELECT product_id, product_name, avg(daily_demand_velocity) FILTER (date >= {EV} - 10) AS recent_avg_daily_demand,
      avg(marketing_roas) FILTER (date >= {EV} - 10) AS recent_avg_roas, avg(net_profit_margin) FILTER (date >= {EV} - 10) AS recent_avg_profit_margin, avg(daily_demand_velocity) FILTER (date BETWEEN {EV} - 90 AND {EV} - 10) AS historical_avg_daily_demand,
      max(inventory_level) FILTER (date = {EV} - 1) AS current_inventory, stddev_samp(daily_demand_velocity) AS vol, count(*) FILTER (daily_demand_velocity > 0) AS days_with_sales FROM perf_rates WHERE date >= {EV} - 90 GROUP BY 1, 2)) WHERE days_with_sales >= 5""",
)
def insight(t: Tables) -> DataFrame:
    # the events span one month, so ten days stand for the recent period
    return op.inventory_insight(t.performance, EVENT_AS_OF, recent_days=10)


define(
    "inventory_export",
    f"""SELECT *, CASE WHEN recent > 0 THEN current_inventory_level / recent END AS cover, {_TREND} AS demand_trend, {_MKT} AS marketing_recommendation FROM (SELECT product_id, max(product_name) AS product_name, max(product_category) AS category, max(product_sku) AS sku,
    avg(total_units_sold) FILTER (date >= {EV} - 10) AS recent, avg(total_units_sold) FILTER (date BETWEEN {EV} - 90 AND {EV} - 10) AS before, sum(total_product_revenue) FILTER (date >= {EV} - 10) AS recent_revenue, avg(marketing_roas) FILTER (date >= {EV} - 10) AS roas,
    max(inventory_level) FILTER (date = {EV} - 1) AS current_inventory_level, max(inventory_cost) FILTER (date = {EV} - 1) AS current_inventory_cost, avg(total_marketing_spend) AS avg_daily_marketing_spend, avg(ads_roas) AS avg_ads_roas,
    avg(revenue_per_email) AS avg_email_revenue_per_send, stddev_samp(total_units_sold) AS demand_volatility, max(total_units_sold) AS peak_daily_demand, count(*) FILTER (total_units_sold > 0) AS days_with_sales, avg(net_profit) AS avg_daily_profit,
    avg(net_profit_margin) AS avg_profit_margin FROM perf_rates WHERE date >= {EV} - 90 GROUP BY 1) WHERE days_with_sales >= 5""",
)


@query(
    "A33_inventory_export",
    f"""SELECT product_id, product_name, category, sku, round(recent, 6) AS avg_daily_demand_recent, round(before, 6) AS avg_daily_demand_historical, round(recent_revenue, 6) AS recent_revenue, round(roas, 6) AS avg_roas_recent, current_inventory_level,
    {_r('current_inventory_cost avg_daily_marketing_spend avg_ads_roas avg_email_revenue_per_send demand_volatility')}, peak_daily_demand, days_with_sales, {_r('avg_daily_profit avg_profit_margin')}, round(cover, 6) AS days_of_inventory_remaining, demand_trend,
    CASE WHEN cover < 7 AND roas > 2 THEN 'increase_stock' WHEN cover > 60 AND roas < 1.5 THEN 'reduce_stock' WHEN demand_volatility > recent * 0.5 THEN 'monitor_closely' ELSE 'maintain_current' END AS inventory_recommendation, marketing_recommendation FROM inventory_export""",
)
def export(t: Tables) -> DataFrame:
    return op.inventory_export(t.performance, EVENT_AS_OF, recent_days=10)


@query(
    "P30_export_flags",
    """SELECT product_id, CASE WHEN demand_trend = 'increasing' AND coalesce(roas, 0) > 2 THEN 1 ELSE 0 END AS high_growth_flag, CASE WHEN cover < 7 THEN 1 ELSE 0 END AS stockout_risk_flag,
    CASE WHEN coalesce(demand_volatility, 0) > coalesce(recent, 0) * 0.5 THEN 1 ELSE 0 END AS high_volatility_flag, CASE WHEN coalesce(roas, 0) > 3 THEN 1 ELSE 0 END AS high_roi_flag FROM inventory_export""",
)
def flags(t: Tables) -> DataFrame:
    return op.export_flags(export(t))


@query(
    "A26_demand_profile",
    f"""SELECT product_id, round(avg(v) FILTER (date >= {EV} - 7), 6) AS recent_7day_demand, round(avg(v) FILTER (date >= {EV} - 30), 6) AS recent_30day_demand, round(CASE WHEN isnan(corr(total_marketing_spend, v)) THEN NULL ELSE corr(total_marketing_spend, v) END, 6) AS marketing_demand_correlation,
    round(avg(marketing_roas), 6) AS avg_marketing_efficiency, round(avg(v) FILTER (extract(dow FROM date) IN (0, 6)), 6) AS weekend_demand, round(avg(v) FILTER (extract(dow FROM date) BETWEEN 1 AND 5), 6) AS weekday_demand,
    round(stddev_samp(v), 6) AS demand_volatility, max(v) AS peak_demand, round(quantile_cont(CAST(v AS DOUBLE), 0.95), 6) AS demand_95th_percentile, round(avg(net_profit_margin), 6) AS avg_profit_margin, round(min(net_profit_margin), 6) AS min_profit_margin
    FROM (SELECT *, daily_demand_velocity AS v FROM perf_rates WHERE date >= {EV} - 90 AND total_units_sold > 0) GROUP BY 1""",
)
def profile(t: Tables) -> DataFrame:
    return op.demand_profile(t.performance, EVENT_AS_OF)


@query(
    "A27_portfolio",
    f"""SELECT product_category, product_count, round(r, 4) AS category_revenue, {_m('roas')} AS avg_roas, {_m('margin * 100')} AS avg_margin_percentage, round(spend, 4) AS category_marketing_spend, {_m('spread')} AS revenue_volatility,
    {_m('r / sum(r) OVER () * 100')} AS revenue_share_percentage, CASE WHEN roas > 3 AND margin > 0.3 THEN 'expand' WHEN roas < 1.5 OR margin < 0.1 THEN 'reduce' WHEN spread > r * 0.3 THEN 'stabilize' ELSE 'maintain' END AS portfolio_recommendation
    FROM (SELECT product_category, count(DISTINCT product_id) AS product_count, sum(total_product_revenue) AS r, avg(marketing_roas) AS roas, avg(net_profit_margin) AS margin, sum(total_marketing_spend) AS spend, stddev_samp(total_product_revenue) AS spread
      FROM perf_rates WHERE date >= {EV} - 90 GROUP BY 1)""",
    digits=4,
)
def portfolio(t: Tables) -> DataFrame:
    return op.portfolio(t.performance, EVENT_AS_OF)


@query(
    "A28_seasonal_pattern",
    f"""SELECT product_id, product_name, extract(month FROM date) AS month, extract(dow FROM date) AS day_of_week, round(avg(daily_demand_velocity), 6) AS avg_demand, round(avg(marketing_roas), 6) AS avg_roas, count(*) AS data_points
    FROM perf_rates WHERE date >= {EV} - 365 AND total_units_sold > 0 GROUP BY 1, 2, 3, 4""",
)
def seasonal(t: Tables) -> DataFrame:
    return op.seasonal_pattern(t.performance, EVENT_AS_OF)


@query(
    "A55_product_share",
    """SELECT order_id, line_number, product_id, round(CASE WHEN sum(net) OVER w > 0 THEN net / sum(net) OVER w WHEN sum(quantity) OVER w > 0 THEN quantity / sum(quantity) OVER w ELSE 0 END, 6) AS product_share
    FROM (SELECT *, price * quantity - total_discount AS net FROM line_items) WINDOW w AS (PARTITION BY order_id)""",
)
def share(t: Tables) -> DataFrame:
    return op.product_share(t.line_items)


define(
    "allocation",
    """SELECT c.date, c.product_id, c.campaign_id, coalesce(spend, 0) * a AS spend_allocated, coalesce(impressions, 0) * a AS impressions_allocated, coalesce(clicks, 0) * a AS clicks_allocated, coalesce(sent, 0) * e AS emails_sent_allocated, coalesce(opened, 0) * e AS emails_opened_allocated
    FROM (SELECT *, CASE WHEN sum(ads_credit) OVER w > 0 THEN ads_credit / sum(ads_credit) OVER w ELSE 0 END AS a, CASE WHEN sum(email_credit) OVER w > 0 THEN email_credit / sum(email_credit) OVER w ELSE 0 END AS e
      FROM (SELECT date, product_id, coalesce(ads_campaign_id, email_campaign_id) AS campaign_id, sum(ads_attributed_revenue) AS ads_credit, sum(email_attributed_revenue) AS email_credit FROM attribution
        WHERE coalesce(ads_campaign_id, email_campaign_id) IS NOT NULL GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY campaign_id, date)) c
    LEFT JOIN (SELECT campaign_id, date, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks FROM ads GROUP BY 1, 2) x ON x.campaign_id = c.campaign_id AND x.date = c.date
    LEFT JOIN (SELECT 'camp_' || (product_id % 10) AS campaign_id, date, sum(recipients) AS sent, sum(opens) AS opened FROM email GROUP BY 1, 2) y ON y.campaign_id = c.campaign_id AND y.date = c.date""",
)
_AL = "spend_allocated impressions_allocated clicks_allocated emails_sent_allocated emails_opened_allocated"


@query("J18_campaign_allocation_join", f"SELECT date, product_id, campaign_id, {_r(_AL)} FROM allocation")
def allocation(t: Tables) -> DataFrame:
    a = attr.attribution(t.conversions, t.touches)
    credits = (
        a.withColumn("campaign_id", F.coalesce("ads_campaign_id", "email_campaign_id"))
        .filter(F.col("campaign_id").isNotNull())
        .groupBy("date", "product_id", "campaign_id")
        .agg(F.sum("ads_attributed_revenue").alias("ads_credit"), F.sum("email_attributed_revenue").alias("email_credit"))
    )
    ad_totals = t.ads.groupBy("campaign_id", "date").agg(*[F.sum(c).alias(f"campaign_{c}") for c in ("spend", "impressions", "clicks")])
    mail_totals = t.email.groupBy(F.concat(F.lit("camp_"), (F.col("product_id") % 10).cast("string")).alias("campaign_id"), "date").agg(
        F.sum("recipients").alias("campaign_emails_sent"), F.sum("opens").alias("campaign_emails_opened")
    )
    return op.campaign_allocation(credits, ad_totals, mail_totals)


@query("A56_allocated_by_product", f"SELECT date, product_id, {', '.join(f'round(sum({c}), 6) AS {c}' for c in _AL.split())} FROM allocation GROUP BY 1, 2")
def allocated(t: Tables) -> DataFrame:
    return op.allocated_by_product(allocation(t))


@query(
    "A57_organic_residual",
    f"""SELECT date, product_id, round(r, 6) AS revenue, round(greatest(0, r - a - e), 6) AS organic_revenue, CAST(round(CAST(cu AS DECIMAL(18,4)), 0) AS BIGINT) AS total_attributed_units,
    CAST(round(CAST(greatest(0, u - cu) AS DECIMAL(18,4)), 0) AS BIGINT) AS organic_units FROM (SELECT date, product_id, sum(total_attributed_revenue) AS r, sum(units) AS u, sum(ads_attributed_revenue) AS a, sum(email_attributed_revenue) AS e,
      sum(units * coalesce((ads_attributed_revenue + email_attributed_revenue) / nullif(total_attributed_revenue, 0), 0)) AS cu FROM (SELECT *, 1 + order_id % 5 AS units FROM attribution) GROUP BY 1, 2)""",
)
def residual(t: Tables) -> DataFrame:
    a = attr.attribution(t.conversions, t.touches)
    return op.organic_residual(
        a.select(
            "date", "product_id", F.col("total_attributed_revenue").alias("revenue"), (1 + F.col("order_id") % 5).alias("units"),
            F.col("ads_attributed_revenue").alias("ads_credit"), F.col("email_attributed_revenue").alias("email_credit"),
        )
    )


@query(
    "W03_revenue_share",
    "SELECT product_id, round(r, 6) AS revenue, round(r / sum(r) OVER () * 100, 6) AS revenue_share FROM (SELECT product_id, sum(revenue) AS r FROM performance GROUP BY 1)",
)
def revenue_share(t: Tables) -> DataFrame:
    return op.revenue_share(t.performance)


_BD = "PARTITION BY product_id ORDER BY date"


@query("W04_units_week_ago", f"SELECT product_id, date, units_sold, lag(units_sold, 7) OVER ({_BD}) AS units_sold_7_days_ago FROM performance")
def week_ago(t: Tables) -> DataFrame:
    return op.units_week_ago(t.performance)


@query(
    "W05_trailing_demand",
    f"SELECT product_id, date, round(avg(units_sold) OVER w, 6) AS avg_daily_demand_30d, round(stddev_samp(units_sold) OVER w, 6) AS demand_volatility_30d FROM performance WINDOW w AS ({_BD} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
)
def trailing(t: Tables) -> DataFrame:
    return op.trailing_demand(t.performance)


@query(
    "W06_trailing_correlation",
    f"""SELECT product_id, date, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 4) AS marketing_demand_correlation FROM (SELECT product_id, date, corr(total_marketing_spend, units_sold) OVER w AS c
    FROM performance WINDOW w AS ({_BD} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""",
    digits=4,
)
def correlation(t: Tables) -> DataFrame:
    return op.trailing_correlation(t.performance)


@query(
    "W13_percent_change",
    f"""SELECT product_id, date, round((units_sold - lag(units_sold) OVER w) / nullif(lag(units_sold) OVER w, 0), 6) AS demand_trend, round((revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0), 6) AS revenue_trend
    FROM performance WINDOW w AS ({_BD})""",
)
def change(t: Tables) -> DataFrame:
    return op.percent_change(t.performance)


@query(
    "A60_optimisation_features",
    """SELECT product_id, p.date, CAST(sum(units_sold) AS BIGINT) AS units_sold, round(sum(revenue), 6) AS revenue, round(sum(total_marketing_spend), 6) AS marketing_spend, round(avg(total_attributed_revenue / CASE WHEN total_marketing_spend = 0 THEN 1 ELSE total_marketing_spend END), 6) AS marketing_efficiency,
    round(avg(organic_revenue / nullif(revenue, 0)), 6) AS organic_ratio, round(any_value(a), 6) AS ads_attributed, round(any_value(e), 6) AS email_attributed, round(any_value(h), 6) AS journey_duration_hours, round(any_value(n), 6) AS touchpoint_count
    FROM performance p LEFT JOIN (SELECT date, sum(ads_attributed_revenue) AS a, sum(email_attributed_revenue) AS e, avg(journey_duration_hours) AS h, avg(touchpoint_count) AS n FROM attribution GROUP BY 1) d ON d.date = p.date GROUP BY 1, 2""",
)
def features(t: Tables) -> DataFrame:
    return op.optimisation_features(t.performance, attr.attribution(t.conversions, t.touches))


@query(
    "A54_performance_kpis",
    """SELECT product_category, round(avg(marketing_roas), 4) AS marketing_roas, round(sum(total_product_revenue) / count(DISTINCT product_id), 4) AS revenue_per_product, round(avg(total_units_sold), 4) AS units_velocity, round(avg(net_profit_margin), 4) AS profit_margin,
    round(avg(ads_roas), 4) AS ads_product_roas, round(avg(revenue_per_email), 4) AS email_revenue_per_send, round(sum(organic_units) / nullif(sum(total_units_sold), 0), 4) AS organic_conversion_rate, round(avg(inventory_turnover_rate), 4) AS inventory_turnover,
    round(avg(inventory_level / nullif(daily_demand_velocity, 0)), 4) AS days_of_inventory, count(*) FILTER (inventory_level / nullif(daily_demand_velocity, 0) < 7) AS stockout_risk_rows, count(*) FILTER (inventory_level / nullif(daily_demand_velocity, 0) > 60) AS overstock_risk_rows
    FROM perf_rates GROUP BY 1""",
    digits=4,
)
def kpis(t: Tables) -> DataFrame:
    return op.performance_kpis(t.performance)


@query(
    "J13_missing_dates",
    f"SELECT DISTINCT date FROM conversions WHERE date >= {EV} - 3 AND date NOT IN (SELECT DISTINCT date FROM performance WHERE date < {EV} - 2)",
)
def missing(t: Tables) -> DataFrame:
    # the build is taken to have stopped two days before the reference date
    built = t.performance.filter(F.col("date") < F.date_sub(F.lit(EVENT_AS_OF).cast("date"), 2))
    return op.missing_dates(t.conversions, built, EVENT_AS_OF)


WEEK = [(dt.date(2024, 1, 30) - dt.timedelta(days=i)).isoformat() for i in range(6, -1, -1)]


@query(
    "A53_product_date_pivot",
    "SELECT product_id, " + ", ".join(f"round(sum(revenue) FILTER (date = DATE '{d}'), 6) AS \"{d}\"" for d in WEEK) + " FROM performance GROUP BY 1",
)
def pivot(t: Tables) -> DataFrame:
    return op.product_date_pivot(t.performance.withColumn("day", F.date_format("date", "yyyy-MM-dd")), "revenue", WEEK)
