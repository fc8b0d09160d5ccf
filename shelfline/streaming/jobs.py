"""Batch drivers: rebuild of missing dates, week-by-week back-fill, the daily job."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, performance, quality, validate
from ..session import cut
from ..sources import sinks
from ..sources.versions import Versions
from . import ingest


def rebuild_missing(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, as_of: str, days: int = 3) -> None:
    """Build only the recent dates the target lacks; touches only those date partitions."""
    try:
        built = source.sparkSession.read.parquet(path).select("date")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # nothing built yet
        built = source.select("date").where("false")
    todo = performance.missing_dates(source, built, as_of, days)
    sinks.overwrite_dates(build(source.join(todo, "date", "left_semi")), path)


def weeks(start: str, end: str) -> list[tuple[str, str]]:
    """Seven-day spans covering a range, both ends included."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    out = []
    while a <= b:
        out.append((a.isoformat(), min(a + timedelta(days=6), b).isoformat()))
        a += timedelta(days=7)
    return out


def backfill(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, start: str, end: str) -> None:
    """Week-by-week back-fill; each week is one job over its own date partitions."""
    for a, b in weeks(start, end):
        sinks.overwrite_dates(build(source.filter(F.col("date").between(a, b))), path)


def guarded_publish(table: Versions, rows: DataFrame, attr: DataFrame, tag: str | None = None) -> DataFrame:
    """Stages a build, decides every day on the staged rows and publishes the days that pass, all at once. Days that are
    held or aborted keep the version they had. Returns date, bad_rows, rows, source_rows, decision."""
    staged = table.stage(rows)
    verdict = cut(validate.gate_days(attr, table.staged_rows(staged, rows)), "verdict")
    passed = verdict.filter("decision = 'publish'").select(F.col("date").cast("string").alias("value"))
    table.publish(staged.join(passed, "value", "left_semi"), tag)
    return verdict


def refresh(source: Versions, summary: Versions, like: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[list[str], list[str]]:
    """Brings a summary up to its source's newest version: partitions that a comparison of the manifests finds changed
    are read and built anew, those gone are dropped. Returns both."""
    now = source.latest()
    changed, gone = source.changed(int(summary.tag() or 0), now)
    summary.publish(summary.stage(build(source.read(like, changed, now))), str(now), gone)
    return changed, gone


class Steps:
    """Named steps of a run, each done once: a mark is written when a step has ended, and a run that is started again
    goes on with the first step without one. Steps replace what they write, so one that died half-way can be repeated."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def do(self, name: str, step: Callable[[], object]) -> bool:
        """True if the step ran now."""
        if "_SUCCESS" in sinks.listed(self.spark, f"{self.root}/{name}"):
            return False
        step()
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}")
        return True


#: Feeds and the live tables that their rows are.
LIVE = {"sales": "sales", "inventory": "stock", "demand": "signals"}


def live_rows(spark: SparkSession, path: str, products: DataFrame) -> DataFrame | None:
    """The valid rows ingested of a feed, in the columns of its live table; None before the first batch."""
    if not sinks.listed(spark, f"{path}/valid"):
        return None
    rows = spark.read.parquet(f"{path}/valid")
    kind = products.schema["product_id"].dataType
    return rows.withColumns(
        {"event_id": F.xxhash64(*rows.columns), "ts": F.col("date"), "date": F.col("date").cast("date"), "product_id": F.col("product_id").try_cast(kind)}
    )


def daily_job(spark: SparkSession, streams: dict[str, DataFrame], root: str, tables: dict[str, DataFrame], as_of: str, day: str, retention_days: int = 90) -> DataFrame:
    """Ingest the feed streams, check and build features from the rows ingested, apply retention, report.

    tables: products, and the live tables (sales, stock, signals) of feeds without a stream. The steps after ingestion
    belong to the batches they saw: new batches start them anew, a run that failed goes on where it stopped."""
    for feed, stream in streams.items():
        ingest.validated(stream, feed, f"{root}/{feed}", f"{root}/_checkpoints/{feed}")
    live = {LIVE[f]: live_rows(spark, f"{root}/{f}", tables["products"]) for f in streams}
    live = {**tables, **{name: rows for name, rows in live.items() if rows is not None}}
    seen = "-".join(f"{f}{max((int(n[6:]) for n in sinks.listed(spark, f'{root}/{f}/valid') if n.startswith('batch=')), default=-1)}" for f in sorted(streams))
    steps = Steps(spark, f"{root}/_steps/{as_of}/{seen}")

    def checks() -> None:
        found = quality.comprehensive(live["sales"], live["stock"], live["signals"], live["products"], as_of, day)
        sinks.overwrite_dates(quality.metric_rows(found, as_of), f"{root}/metrics")

    def build() -> None:
        found = features.feature_set(live["products"], live["sales"], live["stock"], live["signals"], as_of)
        found.write.mode("overwrite").parquet(f"{root}/features")

    def retention() -> None:
        limit = (date.fromisoformat(as_of) - timedelta(days=retention_days)).isoformat()
        sinks.drop_before(spark, f"{root}/metrics", limit).write.mode("overwrite").parquet(f"{root}/retention/{as_of}")

    def report() -> None:
        log = spark.read.parquet(*[f"{root}/{f}/log" for f in streams])
        today = spark.read.parquet(f"{root}/metrics").filter(F.col("date") == F.lit(as_of).cast("date"))
        sinks.write_report(quality.workflow_summary(log, today, as_of), f"{root}/reports/{as_of}")

    for name, step in (("checks", checks), ("features", build), ("retention", retention), ("report", report)):
        steps.do(name, step)
    schema = "date date, files_processed bigint, records_processed bigint, success_rate double, quality_score double"
    return spark.read.schema(schema).json(f"{root}/reports/{as_of}")
