"""The canonical tables as SQL text, for the side-by-side check of every registered query."""

from __future__ import annotations

import re

EV = "DATE '2024-01-31'"
OD = "DATE '2001-08-02'"

_LIST_ADS = """'[{"product_id":' || p || '},{"product_id":' || ((p + 1) % 100) || '}]'"""
_LIST_MAIL = """'[{"product_id":' || p || ',"featured_position":1},{"product_id":' || ((p + 7) % 100) || ',"featured_position":2}]'"""

TABLES = {
    "products": """SELECT p_partkey AS product_id, p_name AS name,
        CASE p_type WHEN 'ECONOMY' THEN 'apparel_tops' WHEN 'SMALL' THEN 'apparel_bottoms' WHEN 'PROMO' THEN 'accessories' ELSE 'other' END AS category,
        p_brand || '-' || p_partkey AS sku, p_brand AS vendor, p_retailprice * CAST(0.6 AS DOUBLE) AS unit_cost, p_retailprice AS selling_price,
        CAST(1 + p_size % 21 AS BIGINT) AS lead_time_days, CAST(365 AS BIGINT) AS shelf_life_days, CAST(1 AS BIGINT) AS min_order_quantity,
        CAST(10000 AS BIGINT) AS max_order_quantity, CASE WHEN p_size % 10 = 0 THEN 'draft' ELSE 'active' END AS status,
        CAST(p_size AS BIGINT) AS inventory_quantity FROM part""",
    "shop_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS customer_email,
        o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS order_date,
        CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN o_orderdate END AS cancelled_at,
        CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'paid' END AS financial_status,
        o_totalprice AS total_price, o_totalprice * CAST(0.02 AS DOUBLE) AS total_discounts, 1 + o_custkey % 8 AS customer_orders_count,
        o_totalprice / 300 AS customer_total_spent, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'web' END AS source_name,
        'NATION_' || (o_custkey % 25) AS shipping_country,
        CASE WHEN o_orderkey % 3 = 0 THEN '/landing/Campaign-' || (o_orderkey % 10) || '/home'
             WHEN o_orderkey % 3 = 1 THEN '/shop?utm_campaign=campaign-' || (o_custkey % 10) ELSE '/' END AS landing_site FROM orders""",
    "line_items": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey AS product_id,
        CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice * l_discount AS total_discount,
        l_shipdate AS updated_at FROM lineitem""",
    "customers": """SELECT c_custkey AS customer_id, c_name AS email, c_mktsegment AS customer_segment,
        ['new','active','at_risk','churned'][c_custkey % 4 + 1] AS lifecycle_stage, (c_custkey % 120) / CAST(100 AS DOUBLE) AS email_engagement_score,
        DATE '2001-08-02' - CAST(c_custkey % 200 AS INTEGER) AS last_email_open, 'NATION_' || c_nationkey AS country,
        coalesce(total_orders, 0) AS total_orders, coalesce(total_spent, 0) AS total_spent, first_order_date, last_order_date,
        coalesce(total_spent / total_orders, 0) AS average_order_value
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS total_orders, sum(o_totalprice) AS total_spent,
          CAST(min(o_orderdate) AS DATE) AS first_order_date, CAST(max(o_orderdate) AS DATE) AS last_order_date
          FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey""",
    "ev": """SELECT event_id, ts, CAST(ts AS DATE) AS date, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS product_id FROM events""",
    "sales": """SELECT event_id, ts, date, product_id, ['online','pos','marketplace','wholesale'][user_id % 4 + 1] AS channel,
        1 + event_id % 5 AS quantity_sold, value AS revenue, user_id AS customer_id FROM ev WHERE event_type = 'purchase'""",
    "stock": """SELECT event_id, ts, date, product_id, 'loc_' || (user_id % 5) AS location, CAST(floor(value) AS BIGINT) AS stock_level,
        event_id % 7 AS reserved_stock, event_id % 11 AS in_transit,
        CAST(floor(value) AS BIGINT) - event_id % 7 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS available_stock
        FROM ev WHERE event_type = 'view'""",
    "signals": """SELECT event_id, ts, date, product_id, ['high','medium','low','unknown'][event_id % 4 + 1] AS external_demand,
        (event_id % 25 - 12) / CAST(10 AS DOUBLE) AS market_trend, value AS competitor_price,
        ['cold','hot','normal'][user_id % 3 + 1] AS weather_factor, ['none','promotion','holiday'][event_id % 3 + 1] AS event_impact,
        (event_id % 21 - 10) / CAST(10 AS DOUBLE) AS social_sentiment FROM ev WHERE event_type = 'error'""",
    "demand": """SELECT product_id, date, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS quantity_demanded,
        CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END), 0) AS BIGINT) AS quantity_fulfilled, false AS is_forecast
        FROM ev WHERE event_type IN ('purchase', 'click') GROUP BY ALL
        UNION ALL SELECT product_id, date, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT), 0, true FROM ev WHERE event_type = 'signup' GROUP BY ALL""",
    "actions": """SELECT event_id, ts, date, product_id, CASE WHEN event_id % 4 = 0 THEN 'adjust' ELSE 'order' END AS action_type,
        1 + event_id % 50 AS quantity, value AS cost FROM ev WHERE event_type = 'signup'""",
    "parameters": """SELECT product_id, CAST(v AS BIGINT) AS version, CAST(DATE '2023-12-01' + CAST(v * 10 AS INTEGER) AS DATE) AS effective_date, lead_time_days * 10 * v AS reorder_point,
        lead_time_days * 5 AS safety_stock, 20 + product_id % 30 AS order_quantity, v = 2 AS is_active
        FROM products, (SELECT unnest([1, 2]) AS v) vs""",
    "runs": """SELECT 'run_' || event_id AS run_id, ts, date, event_id % 40 AS convergence_iterations, event_id % 9 <> 0 AS constraints_satisfied
        FROM ev WHERE event_type = 'error'""",
    "metrics": """SELECT event_id, ts, date, ['service','cost','efficiency'][event_id % 3 + 1] AS metric_category,
        CASE WHEN event_id % 3 = 1 THEN value ELSE (event_id % 100) / CAST(100 AS DOUBLE) END AS metric_value FROM ev WHERE event_type = 'click'""",
    "ads": f"""SELECT date, 'camp_' || (p % 10) AS campaign_id, 'Campaign-' || (p % 10) AS campaign_name, 'ad_' || p || '_' || audience AS ad_id,
        ['18-24','25-45','30-65'][audience + 1] AS age_range, ['all','female','male'][audience + 1] AS gender, ['GB','FR'][p % 2 + 1] AS country,
        p AS product_id, impressions, clicks, spend, reach, view_content, add_to_cart, initiate_checkout, purchases, purchase_value,
        CASE WHEN p % 25 <> 3 THEN {_LIST_ADS} END AS attributed_products
        FROM (SELECT date, product_id AS p, user_id % 3 AS audience,
          100 * count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
          CAST(0.1 AS DOUBLE) * coalesce(sum(value) FILTER (event_type = 'click'), 0) AS spend, 40 * count(*) FILTER (event_type = 'view') AS reach,
          count(*) FILTER (event_type = 'view') AS view_content, count(*) FILTER (event_type = 'click') AS add_to_cart,
          count(*) FILTER (event_type = 'signup') AS initiate_checkout, count(*) FILTER (event_type = 'purchase') AS purchases,
          coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS purchase_value
          FROM ev WHERE event_type <> 'error' GROUP BY ALL) a""",
    "email": f"""SELECT date, p AS product_id, CASE WHEN p % 2 = 0 THEN 'mail_' || (p % 10) END AS campaign_id,
        CASE WHEN p % 2 = 0 THEN 'Newsletter-' || (p % 10) END AS campaign_name, CASE WHEN p % 2 = 1 THEN 'flow_' || (p % 10) END AS flow_id,
        CASE WHEN p % 2 = 1 THEN 'Flow-' || (p % 10) END AS flow_name, CASE WHEN p % 2 = 0 THEN 'campaign' ELSE 'flow' END AS message_type,
        'Customer#' || lpad(CAST(p AS VARCHAR), 9, '0') AS segment_name, recipients, delivered, opens, unique_opens, clicks, unique_clicks, unsubscribes,
        attributed_revenue, attributed_orders,
        CASE WHEN p % 20 = 12 THEN '[]' WHEN p % 20 <> 11 THEN {_LIST_MAIL} END AS featured_products
        FROM (SELECT date, product_id AS p, 50 * count(*) FILTER (event_type = 'signup') AS recipients, 48 * count(*) FILTER (event_type = 'signup') AS delivered,
          12 * count(*) FILTER (event_type = 'view') AS opens, 10 * count(*) FILTER (event_type = 'view') AS unique_opens,
          3 * count(*) FILTER (event_type = 'click') AS clicks, 2 * count(*) FILTER (event_type = 'click') AS unique_clicks,
          count(*) FILTER (event_type = 'purchase') AS unsubscribes, coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS attributed_revenue,
          count(*) FILTER (event_type = 'purchase') AS attributed_orders
          FROM ev WHERE event_type <> 'error' GROUP BY ALL) a""",
    "conversions": """SELECT event_id AS order_id, user_id AS customer_id, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS customer_email,
        ts AS order_ts, date, product_id, value AS revenue FROM ev WHERE event_type = 'purchase'""",
    "touches": """SELECT event_id AS touch_id, user_id AS customer_id, ts AS touch_ts,
        CASE event_type WHEN 'view' THEN 'facebook' WHEN 'click' THEN 'email' ELSE 'organic' END AS channel, 'camp_' || (product_id % 10) AS campaign_id
        FROM ev WHERE event_type IN ('view', 'click', 'signup')""",
    "performance": """SELECT b.*, name AS product_name, category AS product_category, sku AS product_sku FROM (SELECT *,
          greatest(0, revenue - total_attributed_revenue) AS organic_revenue, greatest(0, units_sold - total_attributed_units) AS organic_units FROM (SELECT *,
            revenue / nullif(units_sold, 0) AS avg_selling_price, ads_spend AS total_marketing_spend,
            ads_attributed_revenue + email_attributed_revenue AS total_attributed_revenue,
            ads_attributed_units + email_attributed_units AS total_attributed_units, inventory_level * CAST(0.25 AS DOUBLE) AS inventory_cost,
            CAST(0.1 AS DOUBLE) + (product_id % 5) * CAST(0.1 AS DOUBLE) AS profit_margin FROM (SELECT date, product_id,
              CAST(coalesce(sum(1 + event_id % 5) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS units_sold,
              coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS revenue, count(*) FILTER (event_type = 'purchase') AS orders,
              CAST(0.1 AS DOUBLE) * coalesce(sum(value) FILTER (event_type = 'click'), 0) AS ads_spend, 100 * count(*) FILTER (event_type = 'view') AS ads_impressions,
              count(*) FILTER (event_type = 'click') AS ads_clicks, CAST(0.3 AS DOUBLE) * coalesce(sum(value) FILTER (event_type = 'view'), 0) AS ads_attributed_revenue,
              count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) AS ads_attributed_units, 50 * count(*) FILTER (event_type = 'signup') AS emails_sent,
              count(*) FILTER (event_type = 'view') AS emails_opened, count(*) FILTER (event_type = 'click') AS emails_clicked,
              CAST(0.2 AS DOUBLE) * coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS email_attributed_revenue,
              count(*) FILTER (event_type = 'signup' AND event_id % 2 = 0) AS email_attributed_units,
              CAST(floor(max(value) FILTER (event_type = 'view')) AS BIGINT) AS inventory_level FROM ev GROUP BY ALL) x) y) b
        LEFT JOIN products p ON p.product_id = b.product_id""",
}


NUDGE = "CAST(1.0000000000001 AS DOUBLE)"


def nudge_rounds(sql: str) -> str:
    """round(x, 4 or 6) -> round((x) * NUDGE, ..): the same treatment `rounded` gives the Spark side.

    Exact half-way values differ in their last bit between engines that add in different orders;
    the nudge of one part in 10^13 puts them on the same side.
    """
    out, i = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < i:
            continue
        depth, j, comma = 1, m.end(), None
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = j
            j += 1
        digits = sql[comma + 1 : j - 1].strip()
        inner = sql[m.end() : comma]
        if digits in ("4", "6"):
            out.append(sql[i : m.start()] + f"round(({nudge_rounds(inner)}) * {NUDGE}, {digits})")
        else:
            out.append(sql[i : m.start()] + f"round({nudge_rounds(inner)}, {digits})")
        i = j
    return "".join(out) + sql[i:]


def define(name: str, text: str) -> None:
    """Register a derived table other checks can build on."""
    TABLES[name] = text


def _needs(text: str, have: set[str]) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"'[^']*'", "", text)))
    out = []
    for name in TABLES:
        if name in words and name not in have:
            out.append(name)
    return out


def with_tables(body: str) -> str:
    """Prefix a query with the canonical tables it names (and those they name)."""
    body = nudge_rounds(body)
    order: list[str] = []

    def visit(text: str, stack: set[str]) -> None:
        for name in _needs(text, set(order) | stack):
            visit(TABLES[name], stack | {name})
            if name not in order:
                order.append(name)

    visit(body, set())
    ctes = [f"{n} AS ({nudge_rounds(TABLES[n])})" for n in order]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        recursive = rest[:10].upper() == "RECURSIVE "
        rest = rest[10:] if recursive else rest
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + ",\n".join([*ctes, rest]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
