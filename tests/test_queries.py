"""Registered queries against their SQL twins, and their plans.

By default a cross-section is run at the smallest scale; set SHELFLINE_ALL=1 for every query
(`python tools/check.py` does the same at any scale and prints timings).
"""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import norm  # noqa: E402
from plans import SUSPECT, plan_text  # noqa: E402

from shelfline.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "A01_daily_sales", "A02_customer_value", "A03_ad_product_performance", "A05_mail_product_performance", "A07_touch_revenue_by_product", "A23_rfm_segments", "A26_demand_profile", "A30_daily_sales_export",
    "A32_customer_lifecycle", "A35_journey_patterns", "A36_model_comparison", "A46_report_summary", "A53_product_date_pivot", "A55_product_share", "A56_allocated_by_product", "E01_velocity_features",
    "E04_sentiment_features", "E08_feature_matrix", "E10_fill_missing_sales", "J03_full_outer_daily", "J05_either_key_join", "J06_campaign_url_join", "J14_last_known_stock", "K05_kpi_status", "K06_kpi_trends",
    "M01_touch_sequences", "M04_time_decay", "M05_recency_decay", "M08_attribution_windows", "Q04_inventory_anomalies", "Q08_quality_trends", "R01_current_inventory", "R03_unified_marketing_inventory", "R05_six_week_reorder",
    "R16_statistical_reorder", "R21_unified_recommendations", "R26_layered_rules", "Q13_retention_drop", "S07_ads_load", "S09_keyed_upsert", "S09_bucketed_upsert", "S10_load_all_sources", "S15_recommendation_export", "S17_incremental_summary", "T02_stream_validate", "T03_stream_dedup", "T04_stream_daily_totals", "T09_daily_job",
    "V11_issue_totals", "V16_pre_export_check", "V28_guarded_publish", "V30_attribution_alerts", "W01_revenue_percent_rank", "W02_daily_rankings", "W06_trailing_correlation",
]
NAMES = sorted(QUERIES) if os.environ.get("SHELFLINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_every_query_has_a_twin():
    names = set(registry.all_queries())
    assert names == set(registry.all_sql()) and names <= set(QUERIES) and len(names) > 290


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())


PLANNED = ["A01_daily_sales", "J05_either_key_join", "J06_campaign_url_join", "M05_recency_decay", "M08_attribution_windows", "R03_unified_marketing_inventory", "W01_revenue_percent_rank", "W02_daily_rankings", "K06_kpi_trends"]


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops_or_python_rows(spark, name):
    text = plan_text(QUERIES[name](spark, SF))
    assert not [s for s in SUSPECT if s in text]


def test_scan_reads_only_needed_columns_and_filters_are_pushed(spark):
    text = plan_text(QUERIES["A42_recent_sales"](spark, SF))
    assert "l_extendedprice" in text and "l_shipdate" not in text and "o_totalprice" not in text
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "recommended_order_quantity" in df.columns
