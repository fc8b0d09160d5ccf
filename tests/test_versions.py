"""Versioned tables: publication, crashes, rollback, upserts, summaries, retention, exports, campaign keys in URLs."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfline.operators import attribution, performance
from shelfline.sources import feeds, sinks
from shelfline.sources.versions import Versions
from shelfline.streaming import jobs

SCHEMA = "date date, product_id bigint, revenue double, total_attributed_revenue double"


def day(i):
    return dt.date(2024, 1, i)


def rows(spark, days, revenue, bad=()):
    return spark.createDataFrame([(day(d), p, -1.0 if d in bad and p == 1 else revenue, 0.0) for d in days for p in range(3)], SCHEMA)


def sums(table, like, **kw):
    return {r["date"].day: r["s"] for r in table.read(like, **kw).groupBy("date").agg(F.sum("revenue").alias("s")).collect()}


def test_a_bad_day_is_staged_and_not_seen(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "date")
    attr = spark.createDataFrame([(day(d),) for d in (1, 2, 3, 4)], "date date")
    like = rows(spark, [], 0.0)
    assert table.read(like).count() == 0 and table.latest() == 0
    got = {r["date"].day: r["decision"] for r in jobs.guarded_publish(table, rows(spark, [1, 2, 5], 10.0), attr).collect()}
    assert got == {1: "publish", 2: "publish", 5: "abort"} and sums(table, like) == {1: 30.0, 2: 30.0}
    got = {r["date"].day: r["decision"] for r in jobs.guarded_publish(table, rows(spark, [2, 3, 4], 20.0, bad=[2, 4]), attr).collect()}
    assert got == {2: "hold", 3: "publish", 4: "hold"}
    assert sums(table, like) == {1: 30.0, 2: 30.0, 3: 60.0}
    # every day held: a version without a change
    jobs.guarded_publish(table, rows(spark, [1], 99.0, bad=[1]), attr)
    assert sums(table, like) == {1: 30.0, 2: 30.0, 3: 60.0} and sums(table, like, version=1) == {1: 30.0, 2: 30.0}


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table, like = Versions(spark, str(tmp_path / "t"), "date"), rows(spark, [], 0.0)
    table.publish(table.stage(rows(spark, [1, 2], 10.0)), "a")
    staged = table.stage(rows(spark, [1, 2], 50.0))
    assert sums(table, like) == {1: 30.0, 2: 30.0} and table.tag() == "a"
    # a manifest whose writer died: its folder is there, its mark is not
    os.makedirs(tmp_path / "t" / "manifests" / "version=2" / "_temporary")
    assert table.latest() == 1 and sums(table, like) == {1: 30.0, 2: 30.0}
    assert table.publish(staged, "b") == 3 and sums(table, like) == {1: 150.0, 2: 150.0}
    # the same tag again does nothing
    assert table.publish(table.stage(rows(spark, [1], 70.0)), "b") == 3 and sums(table, like) == {1: 150.0, 2: 150.0}
    files = sum(len(f) for _, _, f in os.walk(tmp_path / "t" / "builds"))
    assert table.rollback(1) == 4 and sums(table, like) == {1: 30.0, 2: 30.0}
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "t" / "builds")) == files


def test_vacuum_deletes_what_no_kept_version_names(spark, tmp_path):
    table, like = Versions(spark, str(tmp_path / "t"), "date"), rows(spark, [], 0.0)
    for i, days in enumerate(([1, 2], [2], [2, 3])):
        table.publish(table.stage(rows(spark, days, float(i))))
    under_way = table.stage(rows(spark, [1], 9.0))
    assert table.vacuum(keep=1) == 2 and sums(table, like) == {1: 0.0, 2: 6.0, 3: 6.0}
    table.publish(under_way)
    assert sums(table, like) == {1: 27.0, 2: 6.0, 3: 6.0}


def test_rows_without_a_partition_value_are_kept(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "date")
    odd = spark.createDataFrame([(None, 1, 5.0, 0.0), (day(1), 2, 6.0, 0.0)], SCHEMA)
    table.publish(table.stage(odd))
    assert sorted((str(r["date"]), r["revenue"]) for r in table.read(odd).collect()) == [("2024-01-01", 6.0), ("None", 5.0)]
    assert [r["revenue"] for r in table.read(odd, [None]).collect()] == [5.0]


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "bucket")
    line = "order_id bigint, line int, price double, at int"
    old = spark.range(10_000).select(F.col("id").alias("order_id"), F.lit(1).alias("line"), F.lit(1.0).alias("price"), F.lit(1).alias("at"))
    bucket = F.expr("order_id div 100")
    feeds.upsert_into(table, old, ["order_id", "line"], ["at"], bucket)
    before = table.builds()
    new = spark.createDataFrame([(i, 1, 2.0, 2) for i in range(9950, 10_050)] + [(9960, 1, 9.0, 0)], line)
    feeds.upsert_into(table, new, ["order_id", "line"], ["at"], bucket, "b1")
    after = table.builds()
    assert len(before) == 100 and sorted(b for b in after if after[b] != before.get(b)) == ["100", "99"]
    got = table.read(old)
    assert got.count() == 10_050 and got.filter("price = 2").count() == 100 and got.filter("price = 9").count() == 0
    want = feeds.upsert(old, new, ["order_id", "line"], ["at"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_summary_builds_changed_days_only(spark, tmp_path):
    source, summary = Versions(spark, str(tmp_path / "s"), "date"), Versions(spark, str(tmp_path / "m"), "date")
    like = rows(spark, [], 0.0).withColumns({"units_sold": F.lit(1).cast("bigint"), "total_marketing_spend": F.lit(0.0)})
    add = lambda d: d.withColumns({"units_sold": F.lit(1).cast("bigint"), "total_marketing_spend": F.lit(0.0)})
    source.publish(source.stage(add(rows(spark, range(1, 8), 10.0))))
    assert jobs.refresh(source, summary, like, performance.day_summary) == ([f"2024-01-0{i}" for i in range(1, 8)], [])
    source.publish(source.stage(add(rows(spark, [3, 8], 20.0))), drop=["2024-01-01"])
    assert jobs.refresh(source, summary, like, performance.day_summary) == (["2024-01-03", "2024-01-08"], ["2024-01-01"])
    assert jobs.refresh(source, summary, like, performance.day_summary) == ([], [])
    assert sums(summary, performance.day_summary(like)) == {2: 30.0, 3: 60.0, 4: 30.0, 5: 30.0, 6: 30.0, 7: 30.0, 8: 60.0}


def test_retention_drops_partitions_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_dates(rows(spark, range(1, 6), 1.0).union(spark.createDataFrame([(None, 1, 1.0, 0.0)], SCHEMA)), path)
    times = {p: os.stat(tmp_path / "t" / p).st_mtime_ns for p in os.listdir(path) if p >= "date=2024-01-03"}
    figures = sinks.drop_before(spark, path, "2024-01-03").collect()
    assert sorted(f["value"] for f in figures if f["dropped"]) == ["2024-01-01", "2024-01-02"] and all(f["bytes"] > 0 for f in figures)
    assert {p: os.stat(tmp_path / "t" / p).st_mtime_ns for p in times} == times
    assert spark.read.parquet(path).count() == 10
    assert sinks.drop_before(spark, str(tmp_path / "none"), "2024-01-03").count() == 0


def test_exports_have_their_declared_names(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 'say "x", y', None), (2, "z", 1.5)], "id int, text string, v double")
    assert sinks.write_export(df.coalesce(1), folder, "rec_2024-01-31.csv") == ["rec_2024-01-31.csv"]
    assert sinks.write_export(df.repartition(2, "id"), folder, "rec_2024-02-01.csv")[-1].startswith("rec_2024-02-01")
    names = sinks.write_export(df.filter("id = 2").coalesce(1), folder, "rec_2024-02-01.csv")
    visible = sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))
    assert names == ["rec_2024-02-01.csv"] and visible == ["rec_2024-01-31.csv", "rec_2024-02-01.csv"]
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(f"{folder}/rec_2024-01-31.csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sinks.write_export(df.limit(0), folder, "none.csv") == ["none.csv"]


@pytest.mark.parametrize("seed", [1, 2])
def test_campaigns_in_urls_equal_a_search_of_all(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab%_x ") for _ in range(n))
    names = ["", "a", "Sale", "Summer Sale 2024", "summer", None, *(word(rng.randrange(1, 12)) for _ in range(60))]
    urls = [None, "", "/", "/Summer Sale 2024", "/x?utm_campaign=summersale2024&y", *("/" + word(rng.randrange(1, 40)) for _ in range(150))]
    orders = spark.createDataFrame(list(enumerate(urls)), "order_id bigint, landing_site string")
    campaigns = spark.createDataFrame(list(enumerate(names)), "campaign_id bigint, campaign_name string")
    got = sorted((r["order_id"], r["campaign_id"]) for r in attribution.campaign_url_matches(orders, campaigns).collect())
    want = set()
    for c, name in enumerate(names):
        if name is None:
            continue
        low = name.lower()
        keys = [low, "utm_campaign=" + "".join(x for x in low if x in "abcdefghijklmnopqrstuvwxyz0123456789_-")]
        want |= {(o, c) for o, url in enumerate(urls) if url and len(url) > 1 and any(k in url.lower() for k in keys)}
    assert got == sorted(want) and len(want) > 100
