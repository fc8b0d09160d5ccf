"""Writers: partitioned tables, CSV exports, JSON reports, ingestion log."""

from __future__ import annotations

import re
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cases, count_if, money


def _store(spark: SparkSession, path: str):
    """The file system behind a path, and the path, as Spark itself sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is absent."""
    store, p = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a text file, of which no more is read than a few kilobytes; None of an empty file."""
    store, p = _store(spark, path)
    stream, head = store.open(p), b""
    try:
        while not re.search(rb"[\r\n]", head):
            more = bytes(stream.readNBytes(1 << 16))
            if not more:
                break
            head += more
    finally:
        stream.close()
    return re.split(r"[\r\n]", head.decode("utf-8", "replace"), maxsplit=1)[0] if head else None


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files and folders with all they hold."""
    for path in paths:
        store, p = _store(spark, path)
        store.delete(p, True)


def drop_before(spark: SparkSession, path: str, before: str, by: str = "date") -> DataFrame:
    """Deletes the partitions of days before a date, by their names: no row is read and no other partition's files are
    touched. Returns a row per partition: value, dropped, files, bytes. Rows without a date stay."""
    figures, old = [], []
    for name in listed(spark, path):
        if not (m := re.fullmatch(rf"{re.escape(by)}=(.+)", name)):
            continue
        store, p = _store(spark, f"{path}/{name}")
        size = store.getContentSummary(p)
        # ISO dates are in the order of their texts.
        gone = bool(re.fullmatch(r"\d{4}-\d\d-\d\d", m[1])) and m[1] < before
        figures.append((m[1], gone, size.getFileCount(), size.getLength()))
        old += [f"{path}/{name}"] if gone else []
    removed(spark, old)
    return spark.createDataFrame(figures, "value string, dropped boolean, files bigint, bytes bigint")


def append_by_date(df: DataFrame, path: str) -> None:
    """Append rows under their date; rows of one date meet in a bounded number of files."""
    df.write.mode("append").partitionBy("date").parquet(path)


def overwrite_dates(df: DataFrame, path: str, by: str = "date") -> None:
    """Replace only the dates present in the rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def ingestion_log(rows: DataFrame) -> DataFrame:
    """One log row per file from rows with file name, kind and validity."""
    g = rows.groupBy("file_name", "file_type").agg(F.count(F.lit(1)).alias("records_processed"), count_if(F.col("is_valid")).alias("records_successful"))
    ok, n = F.col("records_successful"), F.col("records_processed")
    return g.withColumns({"records_failed": n - ok, "status": cases([(ok == n, "success"), (ok > 0, "partial")], "failed")})


def export_ready(df: DataFrame, money_cols: tuple[str, ...] = (), rate_cols: tuple[str, ...] = ()) -> DataFrame:
    """Export conventions: 2 decimals for money, 4 for rates, ISO dates, lower-case booleans."""

    def fmt(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in money_cols:
            return money(c).alias(f.name)
        if f.name in rate_cols:
            return F.round(c, 4).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[fmt(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(path)
    )


def write_export(df: DataFrame, folder: str, name: str) -> list[str]:
    """An export under its declared name, or, of several files, under that name with a number before its ending. All
    files are written in a staging folder first and then renamed; an export of the same name is replaced. A job that
    dies while writing leaves the old export. Returns the names."""
    spark, stage = df.sparkSession, f"{folder}/_staged-{uuid.uuid4().hex}"
    write_csv(df, stage)
    stem, ending = name.rsplit(".", 1)
    parts = [p for p in listed(spark, stage) if p.startswith("part-")]
    names = [name] if len(parts) == 1 else [f"{stem}-{i:05d}.{ending}" for i in range(1, len(parts) + 1)]
    removed(spark, [f"{folder}/{old}" for old in listed(spark, folder) if re.fullmatch(rf"{re.escape(stem)}(-\d{{5}})?\.{ending}", old)])
    for part, new in zip(parts, names, strict=True):
        store, source = _store(spark, f"{stage}/{part}")
        if not store.rename(source, _store(spark, f"{folder}/{new}")[1]):
            raise OSError(f"{part} could not be renamed to {new}")
    removed(spark, [stage])
    return names


def export_name(kind: str, day: date, grain: str = "daily") -> str:
    """{kind}_{date}, {kind}_weekly_{year-week} or {kind}_monthly_{year-month}."""
    if grain == "weekly":
        year, week, _ = day.isocalendar()
        return f"{kind}_weekly_{year}-{week:02d}.csv"
    if grain == "monthly":
        return f"{kind}_monthly_{day:%Y-%m}.csv"
    return f"{kind}_{day:%Y-%m-%d}.csv"


def export_stamp(kind: str, day: Column, grain: str = "daily") -> Column:
    """The same names as a column, for rows of many days."""
    if grain == "weekly":
        # the year a week belongs to is the year of its Thursday
        thursday = F.date_add(F.trunc(day, "week"), 3)
        stamp = F.concat(F.lit("weekly_"), F.year(thursday).cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    elif grain == "monthly":
        stamp = F.concat(F.lit("monthly_"), F.date_format(day, "yyyy-MM"))
    else:
        stamp = F.date_format(day, "yyyy-MM-dd")
    return F.concat(F.lit(kind + "_"), stamp, F.lit(".csv"))


def write_report(df: DataFrame, path: str) -> None:
    """A summary as a JSON document of one line per row."""
    df.coalesce(1).write.mode("overwrite").json(path)
