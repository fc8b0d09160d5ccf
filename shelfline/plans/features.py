"""Features, forecasts, reorder rules and scalar building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions.stats import acceleration, trend, with_position, zscores
from ..operators import features as op
from ..operators import forecast as fc
from ..operators.performance import correlation
from ..sources.tables import EVENT_AS_OF, ORDER_AS_OF, Tables
from .registry import query
from .sqltext import EV, define

START, END = "2024-01-01", "2024-01-30"
CATEGORIES = ["apparel_tops", "apparel_bottoms", "accessories", "other"]


def _r(cols: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols.split())


def _z(pairs: dict[str, str], **defaults: str) -> str:
    """coalesce(expr, default) AS name, as double."""
    return ", ".join(f"coalesce(CAST({e} AS DOUBLE), {defaults.get(n, '0')}) AS {n}" for n, e in pairs.items())


_SLOPE = "CASE WHEN count(*) >= 3 THEN regr_slope({y}, i) ELSE 0 END"
_ACC = """CASE WHEN count(*) >= 4 THEN 2 * coalesce((count(*) * sum(u * u * {y}) - sum(u * u) * sum({y})) / nullif(count(*) * sum(u * u * u * u) - sum(u * u) * sum(u * u), 0), 0) ELSE 0 END"""
define("daily_sold", f"SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date) - 1 AS i, (row_number() OVER (PARTITION BY product_id ORDER BY date) - 1) - (count(*) OVER (PARTITION BY product_id) - 1) / 2 AS u FROM (SELECT product_id, date, CAST(sum(quantity_sold) AS DOUBLE) AS q, sum(revenue) AS r FROM sales WHERE date >= {EV} - 30 GROUP BY 1, 2)")
_VEL = {
    "avg_daily_quantity": "a", "std_daily_quantity": "s", "max_daily_quantity": "mx", "min_daily_quantity": "mn", "avg_daily_revenue": "ar", "quantity_trend": "qt", "revenue_trend": "rt", "demand_volatility": "s / greatest(a, 1)",
    "revenue_per_unit": "ar / greatest(a, 1)", "days_with_sales": "dws", "sales_frequency": "sf", "quantity_acceleration": "qa", "peak_to_trough_ratio": "mx / greatest(mn, 1)",
}
define(
    "velocity_features",
    f"""SELECT p.product_id, {_z(_VEL, peak_to_trough_ratio='1')} FROM products p LEFT JOIN (SELECT product_id, avg(q) AS a, stddev_pop(q) AS s, max(q) AS mx, min(q) AS mn, avg(r) AS ar, {_SLOPE.format(y='q')} AS qt, {_SLOPE.format(y='r')} AS rt,
    count(*) FILTER (q > 0) AS dws, avg(CASE WHEN q > 0 THEN 1.0 ELSE 0.0 END) AS sf, {_ACC.format(y='q')} AS qa FROM daily_sold GROUP BY 1) f ON f.product_id = p.product_id""",
)
_CH = {
    "channel_count": "n", "channel_diversity": "n / 4", "dominant_channel_share": "mx / greatest(t, 1)", "online_share": "c1 / greatest(t, 1)", "pos_share": "c2 / greatest(t, 1)", "marketplace_share": "c3 / greatest(t, 1)",
    "wholesale_share": "c4 / greatest(t, 1)", "channel_revenue_efficiency": "r / k",
}
define(
    "channel_features",
    f"""SELECT p.product_id, {_z(_CH)} FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, max(q) AS mx, sum(q) AS t, sum(CASE WHEN channel = 'online' THEN q ELSE 0 END) AS c1, sum(CASE WHEN channel = 'pos' THEN q ELSE 0 END) AS c2,
    sum(CASE WHEN channel = 'marketplace' THEN q ELSE 0 END) AS c3, sum(CASE WHEN channel = 'wholesale' THEN q ELSE 0 END) AS c4, sum(r) AS r, sum(k) AS k FROM (SELECT product_id, channel, sum(quantity_sold) AS q, sum(revenue) AS r, count(*) AS k FROM sales
      WHERE date >= {EV} - 30 GROUP BY 1, 2) GROUP BY 1) f ON f.product_id = p.product_id""",
)
_INV = {
    "current_stock_level": "cs", "current_available_stock": "cs - cr", "current_reserved_ratio": "cr / greatest(cs, 1)", "current_in_transit": "ct", "stock_trend": "st", "stock_volatility": "sd / greatest(av, 1)", "avg_stock_level": "av",
    "min_stock_level": "mn", "max_stock_level": "mx", "stock_range_ratio": "(mx - mn) / greatest(av, 1)", "availability_ratio": "fr / greatest(av, 1)", "stockout_risk": "CASE WHEN cs IS NULL THEN NULL WHEN cs <= cr THEN 1 ELSE 0 END",
}
define(
    "inventory_features",
    f"""SELECT p.product_id, {_z(_INV, stockout_risk='1')} FROM products p LEFT JOIN (SELECT product_id, max(stock_level) FILTER (k = 1) AS cs, max(reserved_stock) FILTER (k = 1) AS cr, max(in_transit) FILTER (k = 1) AS ct,
    CASE WHEN count(*) >= 3 THEN regr_slope(stock_level, 0 - k) ELSE 0 END AS st, stddev_pop(stock_level) AS sd, avg(stock_level) AS av, min(stock_level) AS mn, max(stock_level) AS mx, avg(stock_level - reserved_stock) AS fr
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, event_id DESC) AS k FROM stock) WHERE k <= 10 GROUP BY 1) f ON f.product_id = p.product_id""",
)
_SEN = {
    "avg_market_trend": "a", "market_trend_volatility": "b", "avg_social_sentiment": "c", "sentiment_volatility": "d", "high_demand_ratio": "e", "medium_demand_ratio": "f", "low_demand_ratio": "g", "avg_competitor_price": "h",
    "weather_diversity": "w", "event_impact_frequency": "j", "market_trend_direction": "k", "competitor_price_trend": "l",
}
define(
    "sentiment_features",
    f"""SELECT p.product_id, {_z(_SEN, medium_demand_ratio='1')} FROM products p LEFT JOIN (SELECT product_id, avg(market_trend) AS a, stddev_pop(market_trend) AS b, avg(social_sentiment) AS c, stddev_pop(social_sentiment) AS d,
    count(*) FILTER (external_demand = 'high') / count(*) AS e, count(*) FILTER (external_demand = 'medium') / count(*) AS f, count(*) FILTER (external_demand = 'low') / count(*) AS g, avg(competitor_price) AS h, count(DISTINCT weather_factor) / count(*) AS w,
    count(*) FILTER (event_impact <> 'none') / count(*) AS j, {_SLOPE.format(y='market_trend')} AS k, {_SLOPE.format(y='competitor_price')} AS l FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts, event_id) - 1 AS i FROM signals WHERE date >= {EV} - 30)
    GROUP BY 1) s ON s.product_id = p.product_id""",
)


@query("E01_velocity_features", f"SELECT product_id, {_r(' '.join(_VEL))} FROM velocity_features")
def velocity(t: Tables) -> DataFrame:
    return op.velocity_features(t.sales, t.products, EVENT_AS_OF)


@query("E02_channel_features", f"SELECT product_id, {_r(' '.join(_CH))} FROM channel_features")
def channels(t: Tables) -> DataFrame:
    return op.channel_features(t.sales, t.products, EVENT_AS_OF)


@query("E03_inventory_features", f"SELECT product_id, {_r(' '.join(_INV))} FROM inventory_features")
def inventory(t: Tables) -> DataFrame:
    return op.inventory_features(t.stock, t.products)


@query("E04_sentiment_features", f"SELECT product_id, {_r(' '.join(_SEN))} FROM sentiment_features")
def sentiment(t: Tables) -> DataFrame:
    return op.sentiment_features(t.signals, t.products, EVENT_AS_OF)


def _prefixed(alias: str, prefix: str, names: dict) -> str:
    return ", ".join(f"round({alias}.{n}, 6) AS {prefix}_{n}" for n in names)


_TEMPORAL = {
    "day_of_week": 2, "day_of_month": 31, "day_of_year": 31, "week_of_year": 5, "month": 1, "quarter": 1, "is_weekend": 0, "is_month_start": 0, "is_month_end": 1, "is_quarter_start": 0, "is_quarter_end": 0,
}
_WAVES = {"day_of_week": (2, 7), "day_of_year": (31, 365), "month": (1, 12)}


@query(
    "E05_feature_set",
    f"""SELECT p.product_id, round(unit_cost, 6) AS product_unit_cost, selling_price AS product_selling_price, round((selling_price - unit_cost) / nullif(selling_price, 0), 6) AS product_profit_margin,
    {", ".join(f"CASE WHEN category = '{c}' THEN CAST(1 AS DOUBLE) ELSE 0 END AS category_{c}" for c in CATEGORIES)},
    {_prefixed('v', 'velocity', _VEL)}, {_prefixed('c', 'channel', _CH)}, {_prefixed('i', 'inventory', _INV)}, {_prefixed('s', 'sentiment', _SEN)},
    {", ".join(f"CAST({v} AS DOUBLE) AS temporal_{k}" for k, v in _TEMPORAL.items())},
    {", ".join(f"round(sin(2 * pi() * {a} / {b}), 6) AS temporal_{k}_sin, round(cos(2 * pi() * {a} / {b}), 6) AS temporal_{k}_cos" for k, (a, b) in _WAVES.items())},
    round(avg_daily_quantity / greatest(current_stock_level, 1), 4) AS inventory_turnover_rate, round(current_stock_level / greatest(avg_daily_quantity, 1), 4) AS days_of_supply, round(current_available_stock / greatest(avg_daily_quantity, 1), 4) AS supply_demand_ratio,
    CASE WHEN avg_competitor_price > 0 THEN round(avg_competitor_price / selling_price, 4) END AS price_competitiveness, round(channel_revenue_efficiency / greatest(selling_price, 1), 4) AS channel_efficiency_ratio
    FROM products p JOIN velocity_features v ON v.product_id = p.product_id JOIN channel_features c ON c.product_id = p.product_id JOIN inventory_features i ON i.product_id = p.product_id JOIN sentiment_features s ON s.product_id = p.product_id""",
)
def feature_set(t: Tables) -> DataFrame:
    d = op.feature_set(t.products, t.sales, t.stock, t.signals, EVENT_AS_OF, categories=CATEGORIES)
    ratios = ("inventory_turnover_rate", "days_of_supply", "supply_demand_ratio", "price_competitiveness", "channel_efficiency_ratio")
    return d.withColumns({c: F.round(F.col(c) * fn.HALF_WAY_NUDGE, 4) for c in ratios})


define(
    "demand_stats",
    f"""SELECT s.*, CASE WHEN n >= 14 AND wd > 1 THEN spread ELSE 1 END AS seasonality_factor FROM (SELECT product_id, avg(quantity_demanded) AS mean_demand, stddev_pop(quantity_demanded) AS std_demand, max(quantity_demanded) AS max_demand, min(quantity_demanded) AS min_demand,
    CAST(median(quantity_demanded) AS DOUBLE) AS median_demand, stddev_pop(quantity_demanded) / greatest(avg(quantity_demanded), 1) AS cv_demand, avg(quantity_fulfilled) AS mean_fulfilled, avg(quantity_fulfilled) / greatest(avg(quantity_demanded), 1) AS fill_rate,
    CAST(sum(quantity_demanded) AS BIGINT) AS total_demand, CAST(sum(quantity_fulfilled) AS BIGINT) AS total_fulfilled, {_SLOPE.format(y='quantity_demanded')} AS demand_trend, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date) - 1 AS i FROM demand WHERE NOT is_forecast AND date >= {EV} - 90) GROUP BY 1) s
    JOIN (SELECT product_id, count(*) AS wd, stddev_pop(m) / greatest(avg(m), 1) AS spread FROM (SELECT product_id, extract(isodow FROM date) AS d, avg(quantity_demanded) AS m FROM demand WHERE NOT is_forecast AND date >= {EV} - 90 GROUP BY 1, 2) GROUP BY 1) w USING (product_id)""",
)
define(
    "stock_metrics",
    f"""SELECT x.product_id, avg_stock_level, max_stock_level, min_stock_level, stock_volatility, avg_available_stock, stockout_frequency, coalesce(total_demand, 0) / greatest(avg_stock_level, 1) AS inventory_turnover, avg_stock_level / greatest(coalesce(mean_demand, 1), 1) AS days_of_supply
    FROM (SELECT product_id, avg(stock_level) AS avg_stock_level, max(stock_level) AS max_stock_level, min(stock_level) AS min_stock_level, stddev_pop(stock_level) AS stock_volatility, avg(available_stock) AS avg_available_stock,
      avg(CASE WHEN available_stock <= 0 THEN 1.0 ELSE 0.0 END) AS stockout_frequency FROM stock WHERE date >= {EV} - 30 GROUP BY 1) x
    LEFT JOIN (SELECT product_id, avg(quantity_demanded) AS mean_demand, sum(quantity_demanded) AS total_demand FROM demand WHERE NOT is_forecast AND date >= {EV} - 30 GROUP BY 1) d ON d.product_id = x.product_id""",
)
_DS = "mean_demand std_demand median_demand cv_demand mean_fulfilled fill_rate demand_trend seasonality_factor"
_IM = "avg_stock_level stock_volatility avg_available_stock stockout_frequency inventory_turnover days_of_supply"


@query("E06_demand_statistics", f"SELECT product_id, max_demand, min_demand, total_demand, total_fulfilled, {_r(_DS)} FROM demand_stats")
def demand_stats(t: Tables) -> DataFrame:
    return op.demand_statistics(t.demand, EVENT_AS_OF)


@query("E07_inventory_metrics", f"SELECT product_id, max_stock_level, min_stock_level, {_r(_IM)} FROM stock_metrics")
def stock_metrics(t: Tables) -> DataFrame:
    return op.inventory_metrics(t.stock, t.demand, EVENT_AS_OF)


_INTS = "max_demand min_demand total_demand total_fulfilled max_stock_level min_stock_level"


@query(
    "E08_feature_matrix",
    f"""SELECT p.product_id, category, round(unit_cost, 6) AS unit_cost, selling_price, lead_time_days, shelf_life_days, min_order_quantity, max_order_quantity, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _INTS.split())}, {", ".join(f"coalesce(round({c}, 6), 0) AS {c}" for c in (_DS + " " + _IM).split())},
    CASE WHEN d.product_id IS NOT NULL AND s.product_id IS NOT NULL THEN round((selling_price - unit_cost) / selling_price, 6) ELSE 0 END AS profit_margin, coalesce(CASE WHEN s.product_id IS NOT NULL THEN round(cv_demand, 6) END, 0) AS demand_variability,
    coalesce(CASE WHEN s.product_id IS NOT NULL THEN round(fill_rate, 6) END, 0) AS service_level, coalesce(CASE WHEN d.product_id IS NOT NULL THEN round(inventory_turnover, 6) END, 0) AS inventory_efficiency
    FROM products p LEFT JOIN demand_stats d ON d.product_id = p.product_id LEFT JOIN stock_metrics s ON s.product_id = p.product_id""",
)
def matrix(t: Tables) -> DataFrame:
    return op.feature_matrix(t.products, t.demand, t.stock, EVENT_AS_OF)


define("stock_now", "SELECT product_id, arg_max(stock_level, ts) AS stock_level, arg_max(reserved_stock, ts) AS reserved_stock, arg_max(in_transit, ts) AS in_transit, max(date) AS date FROM stock GROUP BY 1")


@query(
    "E09_state_vector",
    f"""SELECT s.product_id, stock_level AS current_stock, reserved_stock, in_transit, stock_level - reserved_stock AS available_stock, round(coalesce(m, 0), 6) AS avg_demand, round(coalesce(sd, 0), 6) AS demand_volatility,
    round((stock_level - reserved_stock) / greatest(coalesce(m, 0), 1), 6) AS stock_coverage, round(greatest(0, (coalesce(m, 0) * coalesce(lead_time_days, 7) - (stock_level - reserved_stock)) / greatest(coalesce(m, 0), 1)), 6) AS stockout_risk,
    coalesce(lead_time_days, 7) AS lead_time, CAST(least(coalesce(n, 0), 7) AS BIGINT) AS recent_days FROM stock_now s LEFT JOIN (SELECT product_id, avg(quantity_demanded) AS m, stddev_pop(quantity_demanded) AS sd, count(*) AS n FROM demand
    WHERE NOT is_forecast AND date >= {EV} - 14 GROUP BY 1) d ON d.product_id = s.product_id LEFT JOIN products p ON p.product_id = s.product_id""",
)
def state(t: Tables) -> DataFrame:
    return op.state_vector(t.products, t.stock, t.demand, EVENT_AS_OF).drop("state")


define("days", f"SELECT CAST(unnest(range(DATE '{START}', DATE '{END}' + 1, INTERVAL 1 DAY)) AS DATE) AS date")


@query(
    "E10_fill_missing_sales",
    """SELECT product_id, date, CAST(floor(avg(quantity_sold)) AS BIGINT) AS quantity_sold, round(avg(revenue), 6) AS revenue, 'estimated' AS channel, true AS is_fallback FROM (SELECT g.product_id, g.date, s.quantity_sold, s.revenue,
    row_number() OVER (PARTITION BY g.product_id, g.date ORDER BY s.ts DESC, s.event_id DESC) AS k FROM (SELECT product_id, date FROM (SELECT DISTINCT product_id FROM sales) p, days EXCEPT SELECT product_id, date FROM sales) g
    JOIN sales s ON s.product_id = g.product_id AND s.date < g.date AND extract(dow FROM s.date) = extract(dow FROM g.date)) WHERE k <= 10 GROUP BY 1, 2""",
)
def fill_sales(t: Tables) -> DataFrame:
    return op.fill_missing_sales(t.sales, START, END)


define(
    "stock_by_day",
    """SELECT p.product_id, d.date, s.stock_level, s.reserved_stock, s.in_transit, s.location, s.date < d.date AS is_fallback FROM (SELECT DISTINCT product_id FROM stock) p CROSS JOIN days d
    ASOF JOIN stock s ON s.product_id = p.product_id AND d.date + INTERVAL 1 DAY > s.ts""",
)


@query("J14_last_known_stock", "SELECT * FROM stock_by_day")
def last_known(t: Tables) -> DataFrame:
    return op.last_known_stock(t.stock, START, END)


@query("E11_fill_missing_stock", "SELECT * FROM stock_by_day WHERE is_fallback")
def fill_stock(t: Tables) -> DataFrame:
    return op.last_known_stock(t.stock, START, END).filter("is_fallback")


@query("W10_latest_per_product", "SELECT product_id, stock_level, reserved_stock, in_transit FROM stock_now")
def latest(t: Tables) -> DataFrame:
    return op.latest(t.stock, ["stock_level", "reserved_stock", "in_transit"], ["ts", "event_id"])


@query(
    "W10_active_parameters",
    "SELECT product_id, version, reorder_point, safety_stock, order_quantity FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY effective_date DESC, version DESC) AS k FROM parameters WHERE is_active) WHERE k = 1",
)
def active_parameters(t: Tables) -> DataFrame:
    p = t.parameters.filter("is_active")
    return op.latest(p, ["version", "reorder_point", "safety_stock", "order_quantity"], ["effective_date", "version"])


@query(
    "W11_newest_rows",
    "SELECT product_id, event_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM stock) WHERE rank <= 10",
)
def newest(t: Tables) -> DataFrame:
    return op.newest(t.stock, 10, ["ts", "event_id"]).select("product_id", "event_id", "rank")


@query(
    "W12_period_comparison",
    f"""SELECT CAST(p AS BIGINT) AS period, CAST(sum(quantity_demanded) AS BIGINT) AS total_demand, CAST(sum(quantity_fulfilled) AS BIGINT) AS total_fulfilled, round(sum(quantity_fulfilled) / sum(quantity_demanded), 6) AS service_level
    FROM demand, (SELECT unnest([7, 14, 30, 90]) AS p) WHERE NOT is_forecast AND date >= {EV} - CAST(p AS INTEGER) GROUP BY 1""",
)
def periods(t: Tables) -> DataFrame:
    return op.period_comparison(t.demand, EVENT_AS_OF)


# -- forecasts and rules ----------------------------------------------------------------

define("recent_demand", "SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS k FROM demand WHERE NOT is_forecast")


@query(
    "R14_reorder_point_rule",
    """SELECT product_id, stock_level, point AS reorder_point, CASE WHEN stock_level <= point THEN least(greatest(CAST(floor(a * 30) AS BIGINT), min_order_quantity), max_order_quantity) ELSE 0 END AS order_quantity
    FROM (SELECT p.*, stock_level, coalesce(a, 10) AS a, CAST(floor(coalesce(a, 10) * p.lead_time_days * 1.5) AS BIGINT) AS point FROM products p JOIN stock_now s ON s.product_id = p.product_id
      LEFT JOIN (SELECT product_id, avg(quantity_demanded) AS a FROM recent_demand WHERE k <= 30 GROUP BY 1) d ON d.product_id = p.product_id)""",
)
def reorder_point(t: Tables) -> DataFrame:
    now = op.latest(t.stock, ["stock_level"], ["ts", "event_id"])
    return fc.reorder_point_rule(t.products, now, t.demand)


@query(
    "R15_economic_order_rule",
    """SELECT product_id, stock_level, point AS reorder_point, eoq AS economic_quantity, CASE WHEN stock_level <= point THEN eoq ELSE 0 END AS order_quantity
    FROM (SELECT *, CAST(floor(least(greatest(sqrt(2 * a * 365 * 50 / (unit_cost * CAST(0.25 AS DOUBLE))), min_order_quantity), max_order_quantity)) AS BIGINT) AS eoq, CAST(floor(a * lead_time_days * 1.2) AS BIGINT) AS point
      FROM (SELECT p.*, stock_level, coalesce(a, 10) AS a FROM products p JOIN stock_now s ON s.product_id = p.product_id LEFT JOIN (SELECT product_id, avg(quantity_demanded) AS a FROM recent_demand WHERE k <= 90 GROUP BY 1) d ON d.product_id = p.product_id))""",
)
def economic(t: Tables) -> DataFrame:
    now = op.latest(t.stock, ["stock_level"], ["ts", "event_id"])
    return fc.economic_order_rule(t.products, now, t.demand)


def _plan_sql() -> str:
    src = """SELECT s.product_id, CAST(stock_level - reserved_stock AS DOUBLE) AS l0, coalesce(m, 1) AS a, CASE WHEN n IS NULL THEN 10 WHEN n < 3 THEN greatest(1, m) ELSE m END AS f, lead_time_days AS lead, unit_cost, min_order_quantity AS mn, max_order_quantity AS mx,
      CAST(1.6448536269514722 AS DOUBLE) * CASE WHEN n > 1 THEN sd ELSE coalesce(m, 1) * 0.3 END * sqrt(lead_time_days) AS ss
      FROM stock_now s JOIN products p ON p.product_id = s.product_id LEFT JOIN (SELECT product_id, avg(quantity_demanded) AS m, stddev_pop(quantity_demanded) AS sd, count(*) AS n FROM recent_demand WHERE k <= 7 GROUP BY 1) d ON d.product_id = s.product_id"""
    q = f"SELECT *, a * lead + ss AS rp, l0 AS c0 FROM ({src})"
    for i in (1, 2, 3):
        want = f"greatest(0, rp + a * 7 - (c{i - 1} - f))"
        q = f"SELECT *, greatest(0, c{i - 1} + o{i} - f) AS c{i} FROM (SELECT *, CASE WHEN c{i - 1} - f <= rp AND {want} > 0 THEN least(greatest(CAST(mn AS DOUBLE), {want}), CAST(mx AS DOUBLE)) ELSE 0 END AS o{i} FROM ({q}))"
    for t in range(7):
        arrive = f"CASE WHEN {t} >= lead THEN o{t + 1} ELSE 0 END" if t < 3 else "0"
        q = f"SELECT *, greatest(0, x{t + 1}) AS l{t + 1}, greatest(0, -x{t + 1}) AS z{t + 1} FROM (SELECT *, l{t} + {arrive} - f AS x{t + 1} FROM ({q}))"
    short = " + ".join(f"z{i}" for i in range(1, 8))
    held = " + ".join(f"l{i}" for i in range(1, 8))
    placed = " + ".join(f"CASE WHEN o{i} > 0 THEN 1 ELSE 0 END" for i in (1, 2, 3))
    return f"""SELECT product_id, round(ss, 6) AS safety_stock, round(rp, 6) AS reorder_point, round(o1, 6) AS order_1, round(o2, 6) AS order_2, round(o3, 6) AS order_3, round({short}, 6) AS predicted_stockouts,
    round(({held}) * unit_cost * CAST(0.25 AS DOUBLE) / 365 + ({short}) * 10 + ({placed}) * 50, 4) AS total_cost, round(1 - ({short}) / greatest(f * 7, 1), 6) AS service_level FROM ({q})"""


@query("R16_statistical_reorder", _plan_sql())
def statistical(t: Tables) -> DataFrame:
    s = op.state_vector(t.products, t.stock, t.demand, EVENT_AS_OF)
    d = fc.statistical_reorder(s, t.products, t.demand)
    return d.withColumn("total_cost", F.round(F.col("total_cost") * fn.HALF_WAY_NUDGE, 4))


@query(
    "R17_moving_average_forecast",
    f"""SELECT product_id, CAST({EV} + i AS DATE) AS date, round(CASE WHEN n < 3 THEN greatest(1, m) ELSE greatest(0, lw + CASE WHEN n > 7 THEN lw - pw ELSE 0 END * i * CASE WHEN extract(isodow FROM {EV} + i) >= 6 THEN 1.2 ELSE 0.9 END) END, 6) AS forecast
    FROM (SELECT product_id, count(*) AS n, avg(quantity_demanded) AS m, avg(quantity_demanded) FILTER (k <= 7) AS lw, avg(quantity_demanded) FILTER (k > 7) AS pw FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS k FROM demand
      WHERE NOT is_forecast AND date >= {EV} - 14) GROUP BY 1), (SELECT CAST(unnest(range(7)) AS INTEGER) AS i)""",
)
def moving_average(t: Tables) -> DataFrame:
    return fc.moving_average_forecast(t.demand, EVENT_AS_OF)


define(
    "trend_rows",
    """SELECT product_id, CAST(d + i AS DATE) AS date, CAST(floor(round(greatest(0, m + sl * i), 6)) AS BIGINT) AS quantity_demanded, CAST(0 AS BIGINT) AS quantity_fulfilled, true AS is_forecast, CAST(0.8 AS DOUBLE) AS confidence_interval
    FROM (SELECT product_id, avg(quantity_demanded) AS m, CASE WHEN count(*) >= 2 THEN regr_slope(quantity_demanded, 0 - k) ELSE 0 END AS sl, max(date) AS d FROM recent_demand WHERE k <= 30 GROUP BY 1), (SELECT CAST(unnest(range(1, 43)) AS INTEGER) AS i)""",
)


@query("R18_trend_forecast", "SELECT * FROM trend_rows")
def trend_rows(t: Tables) -> DataFrame:
    return fc.trend_forecast(t.demand, days=42)


def campaigns(t: Tables) -> DataFrame:
    """Campaign calendar derived from the product table: tops and accessories, starting after their lead time."""
    return t.products.filter(F.col("category").isin("apparel_tops", "accessories")).select(
        "product_id",
        F.date_add(F.lit(EVENT_AS_OF).cast("date"), F.col("lead_time_days").cast("int")).alias("start_date"),
        F.lit(7).alias("duration_days"),
        (F.lit(0.01) * F.col("lead_time_days")).alias("lift"),
        (F.lit(5.0) * F.col("lead_time_days")).alias("expected_units"),
    )


define("campaigns", f"SELECT product_id, CAST({EV} + CAST(lead_time_days AS INTEGER) AS DATE) AS start_date, CAST(0.01 AS DOUBLE) * lead_time_days AS lift, CAST(5 AS DOUBLE) * lead_time_days AS expected_units FROM products WHERE category IN ('apparel_tops', 'accessories')")


@query(
    "R24_campaign_forecast",
    """SELECT f.product_id, f.date, quantity_demanded, round(coalesce(lift, 0), 6) AS campaign_lift, round(quantity_demanded * (1 + coalesce(lift, 0)), 6) AS marketing_demand FROM trend_rows f
    LEFT JOIN campaigns c ON c.product_id = f.product_id AND f.date BETWEEN start_date AND start_date + 6""",
)
def campaign_forecast(t: Tables) -> DataFrame:
    return fc.campaign_forecast(trend_rows(t).select("product_id", "date", "quantity_demanded"), campaigns(t))


@query(
    "R24_campaign_reorder_point",
    """SELECT p.product_id, reorder_point, coalesce(expected_units, 0) AS expected_units, reorder_point + coalesce(expected_units, 0) AS adjusted_reorder_point FROM (SELECT * FROM parameters WHERE is_active) p LEFT JOIN campaigns c ON c.product_id = p.product_id""",
)
def campaign_point(t: Tables) -> DataFrame:
    return fc.campaign_reorder_point(t.parameters.filter("is_active").select("product_id", "reorder_point"), campaigns(t))


GLOBAL_RULES = {"lead_time_days": 42, "service_target": 0.95, "season_factor": 1.0, "max_stock_days": 90, "min_order_quantity": 1, "order_multiple": 1}


@query(
    "R26_layered_rules",
    """SELECT p.product_id, p.category, quantity AS suggested_quantity, CAST(coalesce(o.lead, c.lead, 42) AS DOUBLE) AS lead_time_days, CAST(coalesce(c.target, 0.95) AS DOUBLE) AS service_target, CAST(coalesce(c.season, 1) AS DOUBLE) AS season_factor,
    CAST(coalesce(c.cap, 90) AS DOUBLE) AS max_stock_days, CAST(coalesce(o.moq, 1) AS DOUBLE) AS min_order_quantity, CAST(coalesce(o.multiple, 1) AS DOUBLE) AS order_multiple,
    CAST(ceil(greatest(quantity, coalesce(o.moq, 1)) / coalesce(o.multiple, 1)) * coalesce(o.multiple, 1) AS DOUBLE) AS order_quantity
    FROM (SELECT *, 1 + product_id % 200 AS quantity FROM products) p
    LEFT JOIN (SELECT product_id, 14 AS lead, 100 AS moq, 12 AS multiple FROM products WHERE status = 'draft' AND inventory_quantity > 25) o ON o.product_id = p.product_id
    LEFT JOIN (SELECT * FROM (VALUES ('apparel_tops', 28, 0.98, 1.3, 60), ('accessories', NULL, 0.85, NULL, 120)) v(category, lead, target, season, cap)) c ON c.category = p.category""",
)
def layered(t: Tables) -> DataFrame:
    p = F.col("product_id")
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("int")
    # draft products have an override; for small stocks it ended before the reference date
    own = t.products.filter(F.col("status") == "draft").select(
        "product_id", F.lit("1995-01-01").cast("date").alias("active_from"), F.when(F.col("inventory_quantity") > 25, F.lit("2099-01-01")).otherwise("1999-01-01").cast("date").alias("active_to"),
        F.lit(14).alias("lead_time_days"), none_d.alias("service_target"), none_d.alias("season_factor"), none_l.alias("max_stock_days"), F.lit(100).alias("min_order_quantity"), F.lit(12).alias("order_multiple"),
    )
    cats = t.products.select("category").distinct().filter(F.col("category").isin("apparel_tops", "accessories"))
    tops = F.col("category") == "apparel_tops"
    cats = cats.select(
        "category", F.when(tops, 28).alias("lead_time_days"), F.when(tops, 0.98).otherwise(0.85).alias("service_target"), F.when(tops, 1.3).alias("season_factor"),
        F.when(tops, 60).otherwise(120).alias("max_stock_days"), none_l.alias("min_order_quantity"), none_l.alias("order_multiple"),
    )
    products = t.products.select("product_id", "category", (1 + p % 200).alias("suggested_quantity"))
    return fc.resolve_rules(products, own, cats, GLOBAL_RULES, ORDER_AS_OF)


@query(
    "J10_forecast_vs_actual",
    f"""SELECT f.product_id, f.date, f.quantity_demanded AS forecast, a.quantity_demanded AS actual, round(CASE WHEN a.quantity_demanded > 0 THEN greatest(0, 1 - abs(f.quantity_demanded - a.quantity_demanded) / a.quantity_demanded) END, 6) AS accuracy
    FROM demand f JOIN demand a ON a.product_id = f.product_id AND a.date = f.date AND NOT a.is_forecast WHERE f.is_forecast AND f.date >= {EV} - 30""",
)
def accuracy(t: Tables) -> DataFrame:
    return fc.forecast_accuracy(t.demand, EVENT_AS_OF)


# -- scalar building blocks over whole tables ---------------------------------------------


@query(
    "F01_null_handling",
    "SELECT order_id, coalesce(source_name, 'web') AS source, nullif(financial_status, 'pending') AS settled_status, cancelled_at IS NULL AS is_open FROM shop_orders",
)
def nulls(t: Tables) -> DataFrame:
    return t.shop_orders.select(
        "order_id", F.coalesce("source_name", F.lit("web")).alias("source"), F.nullif("financial_status", F.lit("pending")).alias("settled_status"), F.col("cancelled_at").isNull().alias("is_open")
    )


@query(
    "F02_safe_arithmetic",
    "SELECT date, product_id, round(revenue / nullif(units_sold, 0), 6) AS price, round(coalesce(revenue / nullif(ads_spend, 0), 0), 6) AS per_spend, round(revenue / greatest(units_sold, 1), 6) AS floored FROM performance",
)
def safe(t: Tables) -> DataFrame:
    return t.performance.select(
        "date", "product_id", fn.ratio("revenue", "units_sold").alias("price"), fn.ratio("revenue", "ads_spend", 0.0).alias("per_spend"), fn.floor_div("revenue", "units_sold").alias("floored")
    )


@query(
    "F03_safe_cast",
    "SELECT p_partkey AS product_id, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_number, TRY_CAST(p_type AS DOUBLE) AS bad_number, TRY_CAST(p_name AS DATE) AS bad_date FROM part",
)
def safe_cast(t: Tables) -> DataFrame:
    return t.raw("part").select(
        F.col("p_partkey").alias("product_id"),
        F.regexp_replace("p_brand", "Brand#", "").try_cast("bigint").alias("brand_number"),
        F.col("p_type").try_cast("double").alias("bad_number"),
        F.col("p_name").try_cast("date").alias("bad_date"),
    )


@query(
    "F04_date_functions",
    """SELECT order_id, extract(month FROM created_at) AS month, extract(dow FROM order_date) AS dow, extract(hour FROM created_at) AS hour, extract(week FROM order_date) AS week, CAST(date_trunc('month', order_date) AS DATE) AS month_start,
    CAST(order_date - 30 AS DATE) AS month_before, datediff('day', order_date, DATE '2001-08-02') AS age_days, datesub('hour', created_at, TIMESTAMP '2001-08-02') AS age_hours, CAST(len(range(CAST(date_trunc('week', order_date) AS DATE), order_date + 1, INTERVAL 1 DAY)) AS BIGINT) AS week_days_so_far FROM shop_orders""",
)
def dates(t: Tables) -> DataFrame:
    d = F.col("order_date")
    return t.shop_orders.select(
        "order_id", F.month("created_at").cast("bigint").alias("month"), fn.dow("order_date").alias("dow"), F.hour("created_at").cast("bigint").alias("hour"), F.weekofyear(d).cast("bigint").alias("week"),
        F.trunc(d, "month").alias("month_start"), F.date_sub(d, 30).alias("month_before"), F.datediff(F.lit(ORDER_AS_OF).cast("date"), d).cast("bigint").alias("age_days"),
        F.expr(f"timestampdiff(HOUR, created_at, TIMESTAMP_NTZ '{ORDER_AS_OF} 00:00:00')").alias("age_hours"), F.size(F.sequence(F.trunc(d, "week"), d)).cast("bigint").alias("week_days_so_far"),
    )


_CAL = {
    "day_of_week": "extract(isodow FROM d) - 1", "day_of_month": "extract(day FROM d)", "day_of_year": "extract(doy FROM d)", "week_of_year": "extract(week FROM d)", "month": "extract(month FROM d)", "quarter": "extract(quarter FROM d)",
    "is_weekend": "CASE WHEN extract(isodow FROM d) >= 6 THEN 1 ELSE 0 END", "is_month_start": "CASE WHEN extract(day FROM d) <= 7 THEN 1 ELSE 0 END", "is_month_end": "CASE WHEN extract(day FROM d) >= 24 THEN 1 ELSE 0 END",
    "is_quarter_start": "CASE WHEN extract(month FROM d) IN (1, 4, 7, 10) AND extract(day FROM d) <= 7 THEN 1 ELSE 0 END", "is_quarter_end": "CASE WHEN extract(month FROM d) IN (3, 6, 9, 12) AND extract(day FROM d) >= 24 THEN 1 ELSE 0 END",
    "day_of_week_sin": "sin(2 * pi() * (extract(isodow FROM d) - 1) / 7)", "day_of_week_cos": "cos(2 * pi() * (extract(isodow FROM d) - 1) / 7)", "day_of_year_sin": "sin(2 * pi() * extract(doy FROM d) / 365)",
    "day_of_year_cos": "cos(2 * pi() * extract(doy FROM d) / 365)", "month_sin": "sin(2 * pi() * extract(month FROM d) / 12)", "month_cos": "cos(2 * pi() * extract(month FROM d) / 12)",
}


@query("F05_calendar_features", "SELECT d AS order_date, n AS orders, " + ", ".join(f"CAST(round({e}, 4) AS DOUBLE) AS {c}" for c, e in _CAL.items()) + " FROM (SELECT order_date AS d, count(*) AS n FROM shop_orders GROUP BY 1)", digits=4)
def calendar(t: Tables) -> DataFrame:
    d = t.shop_orders.groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"))
    return d.withColumns(op.calendar_features(F.col("order_date")))


@query(
    "F06_string_functions",
    """SELECT product_id, lower(name) AS lower_name, name LIKE '%ring%' AS is_ring, length(sku) AS sku_length, name || '/' || category AS label, regexp_matches(sku, '#1[0-9]-') AS teens, regexp_replace(lower(name), '[^a-z0-9_-]+', '', 'g') AS slug FROM products""",
)
def strings(t: Tables) -> DataFrame:
    return t.products.select(
        "product_id", F.lower("name").alias("lower_name"), F.col("name").like("%ring%").alias("is_ring"), F.length("sku").cast("bigint").alias("sku_length"), F.concat_ws("/", "name", "category").alias("label"),
        F.col("sku").rlike("#1[0-9]-").alias("teens"), F.regexp_replace(F.lower("name"), "[^a-z0-9_-]+", "").alias("slug"),
    )


@query(
    "F07_math_functions",
    """SELECT product_id, round(abs(selling_price - 1000), 6) AS gap, greatest(inventory_quantity, 10) AS at_least_10, least(inventory_quantity, 40) AS at_most_40, round(power(CAST(2 AS DOUBLE), -inventory_quantity), 6) AS half_lives,
    round(exp(-0.1 * inventory_quantity), 6) AS decay, round(sqrt(selling_price), 6) AS root, least(greatest(inventory_quantity, 5), 30) AS clipped FROM products""",
)
def math(t: Tables) -> DataFrame:
    q = F.col("inventory_quantity")
    return t.products.select(
        "product_id", F.abs(F.col("selling_price") - 1000).alias("gap"), F.greatest(q, F.lit(10)).alias("at_least_10"), F.least(q, F.lit(40)).alias("at_most_40"), F.pow(F.lit(2.0), -q).alias("half_lives"),
        F.exp(-0.1 * q).alias("decay"), F.sqrt("selling_price").alias("root"), F.least(F.greatest(q, F.lit(5)), F.lit(30)).alias("clipped"),
    )


@query(
    "F08_json_functions",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS as_json, CAST(json_array_length('[' || repeat('1,', CAST(event_id % 3 AS INTEGER)) || '1]') AS BIGINT) AS list_length FROM events""",
)
def json(t: Tables) -> DataFrame:
    listing = F.concat(F.lit("["), F.repeat(F.lit("1,"), (F.col("event_id") % 3).cast("int")), F.lit("1]"))
    return t.raw("events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("as_json"),
        F.json_array_length(listing).cast("bigint").alias("list_length"),
    )


@query(
    "F09_array_functions",
    "SELECT product_id, date, string_agg(channel, '>' ORDER BY channel) AS channels, CAST(len(range(1, count(*) + 1)) AS BIGINT) AS positions FROM (SELECT DISTINCT product_id, date, channel FROM sales) GROUP BY 1, 2",
)
def arrays(t: Tables) -> DataFrame:
    g = t.sales.groupBy("product_id", "date").agg(F.sort_array(F.collect_set("channel")).alias("c"))
    return g.select("product_id", "date", F.array_join("c", ">").alias("channels"), F.size(F.sequence(F.lit(1), F.size("c"))).cast("bigint").alias("positions"))


@query(
    "F10_statistics",
    """SELECT product_id, round(avg(q), 4) AS mean, round(stddev_pop(q), 4) AS pop_std, round(stddev_samp(q), 4) AS sample_std, round(median(q), 4) AS median, min(q) AS low, max(q) AS high, round(quantile_cont(q, 0.95), 4) AS p95,
    round(CASE WHEN isnan(corr(q, f)) THEN NULL ELSE corr(q, f) END, 4) AS correlation FROM (SELECT product_id, CAST(quantity_demanded AS DOUBLE) AS q, CAST(quantity_fulfilled AS DOUBLE) AS f FROM demand WHERE NOT is_forecast) GROUP BY 1""",
    digits=4,
)
def statistics(t: Tables) -> DataFrame:
    # one row per product and day, so the exact median and percentile hold at most the days of a product
    d = t.demand.filter(~F.col("is_forecast")).select("product_id", F.col("quantity_demanded").cast("double").alias("q"), F.col("quantity_fulfilled").cast("double").alias("f"))
    q = F.col("q")
    return d.groupBy("product_id").agg(
        F.avg(q).alias("mean"), F.stddev_pop(q).alias("pop_std"), F.stddev_samp(q).alias("sample_std"), F.median(q).alias("median"), F.min(q).alias("low"), F.max(q).alias("high"), F.percentile(q, 0.95).alias("p95"),
        correlation(q, F.col("f")).alias("correlation"),
    )


@query("F11_trend", f"SELECT product_id, round({_SLOPE.format(y='q')}, 6) AS trend FROM daily_sold GROUP BY 1")
def trend_q(t: Tables) -> DataFrame:
    return _daily(t).groupBy("product_id").agg(trend("q").alias("trend"))


@query("F12_acceleration", f"SELECT product_id, round({_ACC.format(y='q')}, 6) AS acceleration FROM daily_sold GROUP BY 1")
def acceleration_q(t: Tables) -> DataFrame:
    return _daily(t).groupBy("product_id").agg(acceleration("q").alias("acceleration"))


def _daily(t: Tables) -> DataFrame:
    d = t.sales.filter(fn.since("date", EVENT_AS_OF, 30)).groupBy("product_id", "date").agg(F.sum("quantity_sold").cast("double").alias("q"))
    return with_position(d, ["product_id"], ["date"])


@query("F13_one_hot", "SELECT product_id, " + ", ".join(f"CASE WHEN category = '{c}' THEN CAST(1 AS DOUBLE) ELSE 0 END AS category_{c}" for c in CATEGORIES) + " FROM products")
def one_hot(t: Tables) -> DataFrame:
    return t.products.select("product_id", *op.one_hot("category", CATEGORIES, "category"))


@query(
    "F14_zscore",
    "SELECT date, round((r - avg(r) OVER ()) / nullif(stddev_pop(r) OVER (), 0), 6) AS z FROM (SELECT date, sum(revenue) AS r FROM sales GROUP BY 1)",
)
def z(t: Tables) -> DataFrame:
    return zscores(t.sales.groupBy("date").agg(F.sum("revenue").alias("r")), {"r": "z"}).select("date", "z")
