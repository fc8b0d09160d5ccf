"""KPIs, roll-ups, alerts and business translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import since
from ..operators import features as feat
from ..operators import kpi as op
from ..sources.tables import EVENT_AS_OF, Tables
from .registry import query
from .sqltext import EV, define


def _r(cols: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols.split())


def values(t: Tables, spans: list[op.Span], names: tuple[str, ...]) -> DataFrame:
    return op.kpi_values(t.demand, t.actions, t.stock, t.products, t.runs, t.metrics, EVENT_AS_OF, spans, names)


define("spans", f"SELECT * FROM (VALUES ('7_days', {EV} - 7, {EV} + 1, 7), ('14_days', {EV} - 14, {EV} + 1, 14), ('30_days', {EV} - 30, {EV} + 1, 30), ('90_days', {EV} - 90, {EV} + 1, 90), ('baseline', {EV} - 30, {EV} - 15, 15), ('comparison', {EV} - 15, {EV} + 1, 15)) v(win, a, b, days)")
_IN = "s.date >= spans.a AND s.date < spans.b"
define(
    "kpi_rows",
    f"""SELECT win, days, unnest(['overall_service_level', 'stockout_frequency', 'avg_category_service', 'total_cost', 'avg_order_cost', 'cost_per_unit', 'daily_holding_cost', 'inventory_turnover', 'order_frequency', 'optimization_efficiency', 'forecast_accuracy', 'data_completeness', 'optimization_success_rate', 'system_uptime']) AS metric,
    unnest([coalesce(fulfilled / nullif(demanded, 0), 0), short_days / days, cat, coalesce(cost, 0), coalesce(cost, 0) / greatest(coalesce(placed, 0), 1), coalesce(cost, 0) / greatest(fulfilled, 1), holding, fulfilled / greatest(avg_stock, 1) * (365 / days), coalesce(placed, 0) / days, iterations, acc, seen / np, good / nr, least(1, activity / (days * 24))]) AS value
    FROM (SELECT win, days,
      (SELECT sum(quantity_demanded) FROM demand s WHERE NOT is_forecast AND {_IN}) AS demanded, (SELECT sum(quantity_fulfilled) FROM demand s WHERE NOT is_forecast AND {_IN}) AS fulfilled,
      (SELECT count(DISTINCT date) FROM demand s WHERE NOT is_forecast AND quantity_fulfilled < quantity_demanded AND {_IN}) AS short_days, (SELECT count(DISTINCT product_id) FROM demand s WHERE NOT is_forecast AND {_IN}) AS seen,
      (SELECT sum(x) / (SELECT count(DISTINCT category) FROM products) FROM (SELECT category, coalesce(sum(quantity_fulfilled) / nullif(sum(quantity_demanded), 0), 0) AS x FROM demand s JOIN products p ON p.product_id = s.product_id WHERE NOT is_forecast AND {_IN} GROUP BY 1)) AS cat,
      (SELECT sum(cost) FROM actions s WHERE {_IN}) AS cost, (SELECT count(*) FROM actions s WHERE action_type = 'order' AND {_IN}) AS placed,
      (SELECT coalesce(sum(stock_level * unit_cost), 0) * 0.25 / 365 FROM stock s JOIN products p ON p.product_id = s.product_id WHERE s.date >= {EV} - 1) AS holding, (SELECT avg(stock_level) FROM stock s WHERE {_IN}) AS avg_stock,
      (SELECT avg(convergence_iterations) FROM runs s WHERE {_IN}) AS iterations, (SELECT count(*) FROM runs s WHERE {_IN}) AS nr, (SELECT count(*) FROM runs s WHERE constraints_satisfied AND {_IN}) AS good, (SELECT count(*) FROM products) AS np,
      (SELECT avg(greatest(0, 1 - abs(s.quantity_demanded - q.quantity_demanded) / q.quantity_demanded)) FROM demand s JOIN demand q ON q.product_id = s.product_id AND q.date = s.date AND NOT q.is_forecast WHERE s.is_forecast AND q.quantity_demanded > 0 AND {_IN}) AS acc,
      (SELECT count(*) FROM metrics s WHERE {_IN}) AS activity FROM spans) k""",
)


def _names(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _kpi_sql(names: tuple[str, ...]) -> str:
    return f"SELECT win AS \"window\", days, metric, round(value, 4) AS value FROM kpi_rows WHERE win = '30_days' AND metric IN {_names(names)}"


@query("K01_service_kpis", _kpi_sql(op.SERVICE), digits=4)
def service(t: Tables) -> DataFrame:
    return values(t, op.trailing(EVENT_AS_OF, 30), op.SERVICE)


@query("K02_cost_kpis", _kpi_sql(op.COST), digits=4)
def cost(t: Tables) -> DataFrame:
    return values(t, op.trailing(EVENT_AS_OF, 30), op.COST)


@query("K03_efficiency_kpis", _kpi_sql(op.EFFICIENCY), digits=4)
def efficiency(t: Tables) -> DataFrame:
    return values(t, op.trailing(EVENT_AS_OF, 30), op.EFFICIENCY)


@query("K04_quality_kpis", _kpi_sql(op.QUALITY), digits=4)
def quality(t: Tables) -> DataFrame:
    return values(t, op.trailing(EVENT_AS_OF, 30), op.QUALITY)


_T = " ".join(f"WHEN '{m}' THEN '{c}'" for m, (c, _) in op.TARGETS.items())
_V = " ".join(f"WHEN '{m}' THEN {v}" for m, (_, v) in op.TARGETS.items() if v is not None)
define(
    "kpi_board",
    f"""SELECT *, CASE WHEN target IS NULL THEN 'no_target' WHEN value / target >= 1 THEN 'on_target' WHEN value / target >= 0.9 THEN 'near_target' ELSE 'below_target' END AS status, value / target AS performance_ratio
    FROM (SELECT *, CASE metric {_T} END AS category, CAST(CASE metric {_V} END AS DOUBLE) AS target FROM kpi_rows)""",
)


def board(t: Tables, days: int = 30) -> DataFrame:
    return op.dashboard(values(t, op.trailing(EVENT_AS_OF, days), tuple(op.TARGETS)))


@query("K05_kpi_status", "SELECT win AS \"window\", days, metric, category, target, status, round(value, 4) AS value, round(performance_ratio, 4) AS performance_ratio FROM kpi_board WHERE win = '30_days'", digits=4)
def kpi_status(t: Tables) -> DataFrame:
    return board(t)


@query(
    "K05_kpi_score",
    "SELECT win AS \"window\", count(*) AS total_metrics, count(*) FILTER (status = 'on_target') AS on_target, count(*) FILTER (status = 'below_target') AS needs_improvement, round(avg(least(1, performance_ratio)), 4) AS performance_score FROM kpi_board WHERE win = '30_days' GROUP BY 1",
    digits=4,
)
def kpi_score(t: Tables) -> DataFrame:
    return op.dashboard_summary(board(t))


_SCE = op.SERVICE + op.COST + op.EFFICIENCY


@query(
    "K06_kpi_trends",
    f"""SELECT metric, round(s, 4) AS slope, CASE WHEN s > 0 THEN 'improving' WHEN s < 0 THEN 'declining' ELSE 'stable' END AS direction FROM (SELECT metric, regr_slope(value, days) AS s FROM kpi_rows WHERE win LIKE '%_days' AND metric IN {_names(_SCE)} GROUP BY 1)""",
    digits=4,
)
def kpi_trends(t: Tables) -> DataFrame:
    return op.trends(values(t, op.trailing(EVENT_AS_OF, 7, 14, 30, 90), _SCE))


@query(
    "K07_period_comparison",
    f"""SELECT metric, round(b, 4) AS baseline_value, round(c, 4) AS comparison_value, round(c - b, 4) AS absolute_change, round(CASE WHEN b <> 0 THEN (c - b) / b * 100 ELSE 0 END, 4) AS percent_change, CASE WHEN b <> 0 THEN (c - b) / b > 0 ELSE false END AS improvement,
    CASE WHEN b <> 0 THEN abs((c - b) / b * 100) > 5 ELSE false END AS significant FROM (SELECT metric, max(value) FILTER (win = 'baseline') AS b, max(value) FILTER (win = 'comparison') AS c FROM kpi_rows WHERE metric IN {_names(_SCE)} GROUP BY 1)""",
    digits=4,
)
def compare(t: Tables) -> DataFrame:
    return op.comparison(values(t, op.adjacent(EVENT_AS_OF, 15, 15), _SCE))


@query(
    "K08_kpi_alerts",
    f"""SELECT CASE WHEN performance_ratio < 0.7 THEN 'CRITICAL' ELSE 'WARNING' END AS level, metric, round(value, 4) AS value FROM kpi_board WHERE win = '7_days' AND metric IN {_names(_SCE)} AND performance_ratio < 0.9
    UNION ALL SELECT 'WARNING', 'optimization_failures', n FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM runs WHERE NOT constraints_satisfied AND date >= {EV} - 1) WHERE n > 0
    UNION ALL SELECT 'WARNING', 'data_staleness', n FROM (SELECT CAST(datediff('day', max(date), {EV}) AS DOUBLE) AS n FROM demand WHERE NOT is_forecast) WHERE n > 2""",
    digits=4,
)
def alerts(t: Tables) -> DataFrame:
    week = op.dashboard(values(t, op.trailing(EVENT_AS_OF, 7), _SCE))
    return op.alerts(week, t.runs, t.demand, EVENT_AS_OF)


define(
    "daily_ops",
    """SELECT date, coalesce(total_demand, 0) AS total_demand, coalesce(total_fulfilled, 0) AS total_fulfilled, coalesce(demand_records, 0) AS demand_records, coalesce(total_actions, 0) AS total_actions, coalesce(total_quantity_ordered, 0) AS total_quantity_ordered, coalesce(total_cost, 0) AS total_cost,
    coalesce(total_fulfilled / nullif(total_demand, 0), 0) AS service_level FROM (SELECT date, CAST(sum(quantity_demanded) AS BIGINT) AS total_demand, CAST(sum(quantity_fulfilled) AS BIGINT) AS total_fulfilled, count(*) AS demand_records FROM demand WHERE NOT is_forecast GROUP BY 1) d
    FULL JOIN (SELECT date, count(*) AS total_actions, CAST(sum(quantity) AS BIGINT) AS total_quantity_ordered, sum(cost) AS total_cost FROM actions GROUP BY 1) a USING (date)""",
)


def daily(t: Tables) -> DataFrame:
    return op.daily_metrics(t.demand, t.actions)


@query("A43_daily_operations", "SELECT date, total_demand, total_fulfilled, demand_records, total_actions, total_quantity_ordered, round(total_cost, 4) AS total_cost, round(service_level, 4) AS service_level FROM daily_ops", digits=4)
def daily_operations(t: Tables) -> DataFrame:
    return daily(t)


@query(
    "A44_weekly_operations",
    """SELECT *, CAST(week_start + 7 AS DATE) AS week_end FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, CAST(sum(total_demand) AS BIGINT) AS total_demand, CAST(sum(total_fulfilled) AS BIGINT) AS total_fulfilled, CAST(sum(total_actions) AS BIGINT) AS total_actions,
    round(sum(total_cost), 4) AS total_cost, round(sum(service_level) / 7, 4) AS avg_service_level FROM daily_ops GROUP BY 1)""",
    digits=4,
)
def weekly(t: Tables) -> DataFrame:
    return op.weekly_metrics(daily(t))


define(
    "product_ops",
    f"""SELECT p.product_id, category, coalesce(td, 0) AS total_demand, coalesce(tf, 0) AS total_fulfilled, coalesce(ad, 0) AS avg_demand, coalesce(ta, 0) AS total_actions, coalesce(tq, 0) AS total_ordered, coalesce(tc, 0) AS total_cost, coalesce(cs, 0) AS current_stock, coalesce(av, 0) AS available_stock,
    coalesce(tf / nullif(td, 0), 0) AS service_level FROM products p LEFT JOIN (SELECT product_id, CAST(sum(quantity_demanded) AS BIGINT) AS td, CAST(sum(quantity_fulfilled) AS BIGINT) AS tf, avg(quantity_demanded) AS ad FROM demand WHERE NOT is_forecast AND date >= {EV} - 30 GROUP BY 1) d ON d.product_id = p.product_id
    LEFT JOIN (SELECT product_id, count(*) AS ta, CAST(sum(quantity) AS BIGINT) AS tq, sum(cost) AS tc FROM actions WHERE date >= {EV} - 30 GROUP BY 1) a ON a.product_id = p.product_id LEFT JOIN (SELECT product_id, arg_max(stock_level, ts) AS cs, arg_max(available_stock, ts) AS av FROM stock GROUP BY 1) s ON s.product_id = p.product_id""",
)


def product_ops(t: Tables) -> DataFrame:
    return op.product_performance(t.products, t.demand, t.actions, t.stock, EVENT_AS_OF)


@query("A45_product_performance", f"SELECT product_id, category, total_demand, total_fulfilled, total_actions, total_ordered, current_stock, available_stock, {_r('avg_demand total_cost service_level', 4)} FROM product_ops", digits=4)
def product_performance(t: Tables) -> DataFrame:
    return product_ops(t)


@query(
    "A46_report_summary",
    f"""SELECT CAST(sum(total_demand) AS BIGINT) AS total_demand, CAST(sum(total_fulfilled) AS BIGINT) AS total_fulfilled, round(sum(service_level) / 30, 4) AS overall_service_level, round(sum(total_cost), 4) AS total_cost, (SELECT count(*) FROM products) AS products_analyzed FROM daily_ops WHERE date > {EV} - 30 AND date <= {EV}""",
    digits=4,
)
def report(t: Tables) -> DataFrame:
    return op.report_summary(daily(t), product_ops(t), EVENT_AS_OF)


@query(
    "A46_report_extremes",
    """(SELECT 'top_performer' AS list, product_id, round(service_level, 4) AS service_level FROM product_ops ORDER BY product_ops.service_level DESC, total_demand DESC, product_id LIMIT 10) UNION ALL (SELECT 'improvement', product_id, round(service_level, 4) FROM product_ops ORDER BY product_ops.service_level, total_demand DESC, product_id LIMIT 10)""",
    digits=4,
)
def extremes(t: Tables) -> DataFrame:
    return op.report_extremes(product_ops(t))


_PERF = ", ".join(f"avg(metric_value) FILTER (metric_category = '{c}') AS avg_{c}, stddev_pop(metric_value) FILTER (metric_category = '{c}') AS std_{c}" for c in ("service", "cost", "efficiency"))
define("system_performance", f"SELECT *, avg_service - avg_cost / 10000 AS composite_score FROM (SELECT {_PERF} FROM metrics WHERE date >= {EV} - 7)")


@query("A51_system_performance", f"SELECT {_r('avg_service std_service avg_cost std_cost avg_efficiency std_efficiency composite_score')} FROM system_performance")
def system(t: Tables) -> DataFrame:
    return op.system_performance(t.metrics, EVENT_AS_OF)


@query(
    "K14_parameter_suggestions",
    """SELECT 'max_iterations' AS parameter, 50 AS old_value, 60 AS new_value, 'low_efficiency' AS reason FROM system_performance WHERE avg_efficiency < 0.7 UNION ALL SELECT 'prediction_horizon', 7, 8, 'low_service_level' FROM system_performance WHERE avg_service < 0.9
    UNION ALL SELECT 'prediction_horizon', 7, 6, 'high_service_level_potential_overstock' FROM system_performance WHERE avg_service > 0.98""",
)
def suggestions(t: Tables) -> DataFrame:
    return op.parameter_suggestions(system(t))


_CONSIST = f"""SELECT product_id, strategic_quantity, round(a, 6) AS avg_tactical_quantity, 'quantity_deviation' AS issue_type, round(abs(a - strategic_quantity) / strategic_quantity * 100, 6) AS deviation_percent FROM (SELECT p.product_id, order_quantity AS strategic_quantity, a FROM parameters p JOIN (SELECT product_id, avg(quantity) AS a
    FROM actions WHERE date >= {EV} - 7 GROUP BY 1) x ON x.product_id = p.product_id WHERE is_active)"""


@query("R22_parameter_consistency", f"SELECT * FROM ({_CONSIST}) WHERE deviation_percent > 50")
def consistency(t: Tables) -> DataFrame:
    return op.parameter_consistency(t.parameters.filter("is_active"), t.actions, EVENT_AS_OF)


@query(
    "J21_parameters_with_actions",
    f"SELECT p.product_id, order_quantity, round(a, 6) AS avg_action FROM parameters p JOIN (SELECT product_id, avg(quantity) AS a FROM actions WHERE date >= {EV} - 7 GROUP BY 1) x ON x.product_id = p.product_id WHERE is_active",
)
def parameters_actions(t: Tables) -> DataFrame:
    recent = t.actions.filter(since("date", EVENT_AS_OF, 7)).groupBy("product_id").agg(F.avg("quantity").alias("avg_action"))
    return t.parameters.filter("is_active").select("product_id", "order_quantity").join(recent, "product_id")


@query(
    "K09_financial_impact",
    """SELECT round(sl, 6) AS service_level, td AS total_demand, round(tc, 4) AS total_cost, round(tu, 6) AS inventory_turnover, round(tc * 0.2 / 52, 4) AS weekly_savings, round(rp, 4) AS revenue_protected, round(greatest(0, tc * (1 - 6 / tu) * 0.3), 4) AS cash_freed,
    round(CASE WHEN tc > 0 THEN least(500, greatest(100, (rp + tc * 0.2 / 52) * 52 / (tc * 0.05) * 100)) ELSE 200 END, 4) AS roi_percentage FROM (SELECT *, greatest(0, (sl - 0.85) * td * 0.1 * 12.5) AS rp FROM (SELECT CAST(sum(quantity_demanded) AS BIGINT) AS td, sum(quantity_fulfilled) / sum(quantity_demanded) AS sl,
      (SELECT sum(cost) FROM actions) AS tc, sum(quantity_fulfilled) / (SELECT avg(stock_level) FROM stock) AS tu FROM demand WHERE NOT is_forecast))""",
)
def impact(t: Tables) -> DataFrame:
    cost = t.actions.agg(F.sum("cost")).scalar()
    stock = t.stock.agg(F.avg("stock_level")).scalar()
    row = t.demand.filter(~F.col("is_forecast")).agg(F.sum("quantity_demanded").alias("total_demand"), F.sum("quantity_fulfilled").alias("f"))
    row = row.select((F.col("f") / F.col("total_demand")).alias("service_level"), "total_demand", cost.alias("total_cost"), (F.col("f") / stock).alias("inventory_turnover"))
    d = op.financial_impact(row)
    return d.withColumns({c: F.round(F.col(c) * 1.0000000000001, 4) for c in ("total_cost", "weekly_savings", "revenue_protected", "cash_freed", "roi_percentage")})


define(
    "stock_state",
    """SELECT p.product_id, s.stock_level AS current_stock, r.reorder_point, coalesce(a, 0) AS daily_demand, selling_price FROM products p JOIN (SELECT product_id, arg_max(stock_level, ts) AS stock_level FROM stock GROUP BY 1) s ON s.product_id = p.product_id
    JOIN (SELECT * FROM parameters WHERE is_active) r ON r.product_id = p.product_id LEFT JOIN (SELECT product_id, avg(quantity_demanded) AS a FROM demand WHERE NOT is_forecast AND date >= DATE '2024-01-31' - 30 GROUP BY 1) d ON d.product_id = p.product_id""",
)


def stock_state(t: Tables) -> DataFrame:
    """Current stock, reorder point, daily demand and price per stocked product."""
    now = feat.latest(t.stock, ["stock_level"], ["ts", "event_id"]).withColumnRenamed("stock_level", "current_stock")
    pace = t.demand.filter(~F.col("is_forecast") & since("date", EVENT_AS_OF, 30)).groupBy("product_id").agg(F.avg("quantity_demanded").alias("daily_demand"))
    d = t.products.select("product_id", "selling_price").join(now, "product_id").join(t.parameters.filter("is_active").select("product_id", "reorder_point"), "product_id")
    return d.join(pace, "product_id", "left").withColumn("daily_demand", F.coalesce("daily_demand", F.lit(0.0)))


@query(
    "K10_stock_alerts",
    """SELECT product_id, CASE WHEN days_left <= 2 THEN 'urgent' ELSE 'opportunity' END AS alert_type, days_left, reorder_point * 2 AS order_units, round(risk, 6) AS revenue_risk FROM (SELECT *, daily_demand * days_left * selling_price AS risk FROM (SELECT *, greatest(1, CAST(floor(current_stock / greatest(daily_demand, 1)) AS BIGINT)) AS days_left
    FROM stock_state WHERE current_stock <= reorder_point)) ORDER BY days_left, risk DESC, product_id LIMIT 5""",
)
def stock_alerts(t: Tables) -> DataFrame:
    return op.stock_alerts(stock_state(t))


@query(
    "K11_urgent_actions",
    """SELECT product_id, round(d, 6) AS days_left, CASE WHEN d <= 2 THEN 'Reorder today' ELSE 'Schedule reorder' END AS action, CASE WHEN d <= 2 THEN 'URGENT' ELSE 'TODAY' END AS priority, round(i, 6) AS impact FROM (SELECT *, daily_demand * CASE WHEN d <= 2 THEN 7 ELSE 3 END * selling_price AS i FROM (SELECT *, current_stock / greatest(daily_demand, 1) AS d FROM stock_state)
    WHERE d <= 5) ORDER BY d, i DESC, product_id LIMIT 3""",
)
def urgent(t: Tables) -> DataFrame:
    return op.urgent_actions(stock_state(t))


@query(
    "K12_category_advice",
    f"""SELECT product_category, round(m, 6) AS margin, round(g, 6) AS growth, CASE WHEN m > 0.35 AND g > 0.15 THEN 'Expand premium lines' WHEN m > 0.3 AND g > 0.05 THEN 'Optimize shelf space' WHEN m < 0.2 AND g < 0 THEN 'Review pricing strategy' WHEN g > 0.2 THEN 'Capture growth opportunity' ELSE 'Monitor performance' END AS recommendation
    FROM (SELECT product_category, m, (n - b) / b AS g FROM (SELECT product_category, avg(profit_margin) AS m, sum(revenue) FILTER (date >= {EV} - 15) AS n, sum(revenue) FILTER (date < {EV} - 15) AS b FROM performance WHERE date >= {EV} - 30 GROUP BY 1))""",
)
def advice(t: Tables) -> DataFrame:
    return op.category_advice(t.performance, EVENT_AS_OF)


@query(
    "K13_trending_products",
    f"""SELECT product_id, round(c, 6) AS change, CASE WHEN c > 0.5 THEN 'Increase stock' WHEN c > 0 THEN 'Monitor closely' WHEN c < -0.4 THEN 'Clear inventory' ELSE 'Reduce orders' END AS action, round(CASE WHEN c > 0 THEN n * c * 10 ELSE abs(n * c * 15) END, 6) AS impact
    FROM (SELECT product_id, n, (n - b) / nullif(b, 0) AS c FROM (SELECT product_id, sum(quantity_demanded) FILTER (date >= {EV} - 15) AS n, sum(quantity_demanded) FILTER (date < {EV} - 15) AS b FROM demand WHERE NOT is_forecast AND date >= {EV} - 30 GROUP BY 1)) WHERE c > 0.3 OR c < -0.2 ORDER BY abs(c) DESC, product_id LIMIT 5""",
)
def trending(t: Tables) -> DataFrame:
    return op.trending_products(t.demand, EVENT_AS_OF)
