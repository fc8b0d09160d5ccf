"""Feeds as file streams: ingestion, validation, dedup, running totals, alerts, freshness.

Each job reads new files once (checkpointed), runs until the files present are consumed, and
writes plain tables. Batch outputs are keyed by batch number, so a retried batch replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..session import cut
from ..sources import feeds, sinks
from ..sources.versions import Versions


def files(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, fmt: str = "csv", per_trigger: int | None = None) -> DataFrame:
    """Stream over the files of a folder."""
    r = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("escape", '"')
    if glob:
        r = r.option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path)


def feed_files(spark: SparkSession, path: str, feed: str, per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """Paths of the files of one feed kind, found by name, each once. Their contents are read by `validated`, which
    looks up each file's own header."""
    schema = T.StructType.fromDDL("path string, modificationTime timestamp, length bigint, content binary")
    return files(spark, path, schema, glob or f"*{feed}*.csv", "binaryFile", per_trigger).select("path")


def run_to_end(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Consume everything present, one callback per batch, then stop."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    return q


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Rows appended as they arrive, each file once, through the checkpointed file sink."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def validated(stream: DataFrame, feed: str, root: str, checkpoint: str) -> None:
    """Per batch of files (see feed_files): read by header, cast, split by the feed's error rules, write valid rows,
    quarantine (with the raw text of each row) and a log row per file. Rows of a file that lacks a required column
    are quarantined."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        paths = [r.path for r in df.collect()]
        if not paths:
            return
        good, bad = validate.split(feeds.read_feed(spark, paths, feed), feed)
        _put(feeds.with_defaults(good.drop("raw", "malformed"), feed), f"{root}/valid", batch_id)
        _put(bad.drop("malformed"), f"{root}/quarantine", batch_id)
        sides = [
            spark.read.parquet(f"{root}/{side}/batch={batch_id}").select("file_name", F.lit(feed).alias("file_type"), F.lit(ok).alias("is_valid"))
            for side, ok in (("valid", True), ("quarantine", False))
        ]
        _put(sinks.ingestion_log(sides[0].unionByName(sides[1])), f"{root}/log", batch_id)

    if stream.columns != ["path"]:
        raise ValueError(f"a stream of file paths is wanted; this one lacks declared columns or has others: {stream.columns}")
    run_to_end(stream, checkpoint, batch)


def _since(ts: str, latest: Column | None, delay: str) -> Column:
    """True for rows older than the newest time of earlier batches less the delay."""
    return F.lit(False) if latest is None else F.coalesce(F.col(ts) < latest - F.expr(f"INTERVAL {delay}"), F.lit(False))


def deduplicated(stream: DataFrame, key: list[str], ts: str, delay: str, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Each key's first row, whenever it arrives: nothing is dropped for being late. Rows older than the delay are
    marked `late` and counted (see arrivals). A batch is compared with the keys stored in the buckets it touches,
    buckets being a hash of the key; a batch that is tried again replaces its own rows."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rest = [ts, *[c for c in df.columns if c not in key and c != ts]]
        first = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("x")).select(*key, "x.*").select(*df.columns)
        rows = cut(first.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "batch")
        before = _earlier(spark, f"{path}/arrivals", batch_id)
        latest = None if before is None else before.agg(F.max("latest")).scalar()
        stored = _earlier(spark, f"{path}/rows", batch_id, rows.withColumn("late", F.lit(False)))
        fresh = rows.withColumn("late", _since(ts, latest, delay))
        if stored is not None:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
            known = stored.filter(F.col("bucket").isin(touched)).select(*[F.col(k).alias(f"_{k}") for k in key])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
            fresh = fresh.join(known, reduce(Column.__and__, same), "left_anti")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch_id}")
        kept = spark.read.schema(fresh.schema).parquet(f"{path}/rows/batch={batch_id}")
        figures = kept.agg(F.count(F.lit(1)).alias("kept"), F.count_if("late").alias("late"))
        _put(rows.agg(F.max(ts).alias("latest"), F.count(F.lit(1)).alias("rows")).crossJoin(figures), f"{path}/arrivals", batch_id)

    run_to_end(stream, checkpoint, batch)


def _earlier(spark: SparkSession, path: str, batch_id: int, like: DataFrame | None = None) -> DataFrame | None:
    """What batches before this one wrote; None before the first."""
    if not any(name.startswith("batch=") and int(name[6:]) < batch_id for name in sinks.listed(spark, path)):
        return None
    r = spark.read if like is None else spark.read.schema(T.StructType([*like.schema, T.StructField("batch", T.LongType())]))
    return r.parquet(path).filter(F.col("batch") < batch_id)


def first_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows kept so far, with `late`."""
    schema = T.StructType([*like.schema, T.StructField("late", T.BooleanType())])
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Per batch: newest time, keys, keys that were new, and how many of these were late."""
    return spark.read.parquet(f"{path}/arrivals")


TOTALS = "date date, product_id bigint, total_quantity bigint, total_revenue double, transactions bigint, late_transactions bigint"


def daily_totals(stream: DataFrame, path: str, checkpoint: str, delay: str = "2 days") -> None:
    """Daily product sales kept current. A batch is added to the stored totals of the days it touches, however old;
    only these days are read and written, and all of them become visible together. Sales older than the delay count
    and are also counted as late. A batch that was published is not added again."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        table = Versions(spark, path, "date")
        done = json.loads(table.tag() or "{}")
        if done.get("batch", -1) >= batch_id:
            return
        before = F.lit(done["latest"]).cast(df.schema["ts"].dataType) if done.get("latest") else None
        part = df.groupBy(F.col("ts").cast("date").alias("date"), "product_id").agg(
            F.sum("quantity_sold").alias("total_quantity"), F.sum("revenue").alias("total_revenue"), F.count(F.lit(1)).alias("transactions"),
            F.count_if(_since("ts", before, delay)).alias("late_transactions"), F.max("ts").alias("latest"),
        )
        part = cut(part, "part")
        newest = part.agg(F.max("latest").cast("string")).first()[0]
        touched = [r[0] for r in part.select(F.col("date").cast("string")).distinct().collect()]
        old = table.read(spark.createDataFrame([], TOTALS), touched)
        every = old.unionByName(part.drop("latest")).repartition("date").groupBy("date", "product_id")
        sums = every.agg(*[F.sum(c).alias(c) for c in ("total_quantity", "total_revenue", "transactions", "late_transactions")])
        table.publish(table.stage(sums), json.dumps({"batch": batch_id, "latest": max(filter(None, (newest, done.get("latest"))), default=None)}))

    run_to_end(stream, checkpoint, batch)


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of each day and product over all batches."""
    return Versions(spark, path, "date").read(spark.createDataFrame([], TOTALS))


def stock_alerts(stream: DataFrame, rules: DataFrame, path: str, checkpoint: str) -> None:
    """Stock updates joined to the reorder rules; per batch the latest update of each product with its alert, "none"
    where the level is above the point, so that a recovered product closes its alert (see current_alerts)."""
    joined = stream.join(rules.select("product_id", "reorder_point"), "product_id")

    def batch(df: DataFrame, batch_id: int) -> None:
        cols = ["stock_level", "reserved_stock", "reorder_point", "ts", "event_id"]
        last = df.groupBy("product_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("x")).select("product_id", "x.*")
        level = F.when(F.col("stock_level") <= F.col("reserved_stock"), "stockout").when(F.col("stock_level") <= F.col("reorder_point"), "reorder")
        _put(last.withColumn("alert", level.otherwise("none")), path, batch_id)

    run_to_end(joined, checkpoint, batch)


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts that stand: each product's newest update over all batches, also where an older one arrived later."""
    t = spark.read.parquet(path)
    cols = [c for c in t.columns if c not in ("product_id", "batch")]
    last = t.groupBy("product_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("x")).select("product_id", "x.*")
    return last.filter("alert <> 'none'")


def freshness(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Newest time and row count per source, carried across batches."""
    g = stream.groupBy("source").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("rows"))
    run_to_end(g, checkpoint, lambda df, i: _put(df, path, i), mode="complete")


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last batch (for outputs that repeat their whole result)."""
    t = spark.read.parquet(path)
    return t.filter(F.col("batch") == t.agg(F.max("batch")).scalar()).drop("batch")
