"""Feed files: declared schemas, CSV scans, routing, defaults."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import product_list
from ..session import cut
from . import sinks
from .versions import Versions

# The declared columns of each feed (required first) with types, and fill-in defaults.
FEEDS = {
    "sales": {
        "required": {"date": "timestamp_ntz", "product_id": "string", "channel": "string", "quantity_sold": "bigint", "revenue": "double"},
        "optional": {"customer_segment": "string", "promotion_code": "string", "fulfillment_method": "string"},
        "defaults": {"customer_segment": "regular", "fulfillment_method": "warehouse"},
    },
    "inventory": {
        "required": {"date": "timestamp_ntz", "product_id": "string", "location": "string", "stock_level": "bigint"},
        "optional": {"reserved_stock": "bigint", "in_transit": "bigint", "supplier_id": "string", "last_reorder_date": "timestamp_ntz"},
        "defaults": {"reserved_stock": 0, "in_transit": 0},
    },
    "demand": {
        "required": {"date": "timestamp_ntz", "product_id": "string", "external_demand": "string"},
        "optional": {"market_trend": "double", "competitor_price": "double", "weather_factor": "string", "event_impact": "string", "social_sentiment": "double"},
        "defaults": {"market_trend": 0.0, "weather_factor": "normal", "event_impact": "none", "social_sentiment": 0.0},
    },
}

ORDER_TIMES = {"created_at": True, "updated_at": True, "processed_at": False, "cancelled_at": False}
ORDER_DEFAULTS = {"customer_orders_count": 1, "customer_total_spent": 0.0, "total_tax": 0.0, "total_discounts": 0.0, "shipping_cost": 0.0, "source_name": "web"}
LINE_DEFAULTS = {"total_discount": 0.0, "requires_shipping": True, "taxable": True, "fulfillment_service": "manual"}
AD_NUMBERS = ("impressions", "clicks", "spend", "reach", "purchases", "purchase_value", "add_to_cart", "view_content", "initiate_checkout", "ctr", "cpc", "cpm", "roas")
MAIL_NUMBERS = ("recipients", "delivered", "opens", "unique_opens", "clicks", "unique_clicks", "unsubscribes", "bounces", "attributed_revenue", "attributed_orders", "open_rate", "click_rate")


def declared(feed: str) -> dict[str, str]:
    spec = FEEDS[feed]
    return {**spec["required"], **spec["optional"]}


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


#: Columns beside those of the files: the name of the file, and the whole line where it doesn't fit its header.
FILE, BAD = "_file_name", "_bad_line"


#: Files whose first line is read by opening them; endings of files that have to be unpacked for it.
OPENED, PACKED = 1000, (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their header line, in order. A byte-order mark and blanks around names are
    dropped; a name that occurs again gets a number; files without any line are left out. Of up to OPENED plain files only
    the first bytes are read; the headers of more, or of compressed ones, come from a pass over the text, which sends one
    row per different header line, with its file names, to the driver."""
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").limit(OPENED + 1).collect()]
    if len(files) <= OPENED and not any(f.lower().endswith(PACKED) for f in files):
        heads = [(head, [f]) for f in files if (head := sinks.first_line(spark, f)) is not None]
    else:
        lines = spark.read.text(path).filter("_metadata.file_block_start = 0")
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
        first = lines.groupBy("file").agg(F.min_by("value", "row").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
        heads = [(r.head, list(map(unquote, r.files))) for r in first.collect()]
    found: dict[tuple[str, ...], list[str]] = {}
    for head, same in heads:
        names: list[str] = []
        for name in next(csv.reader([head.lstrip("\ufeff")]), []):
            name = name.strip()
            names.append(name if name not in names else f"{name}_{len(names) + 1}")
        found.setdefault(tuple(names), []).extend(same)
    return found


def by_header(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """CSV files as text columns, found by name: files with different column orders are read apart and united, and
    a column that a file lacks is null there. Lines with too many or too few fields carry their text in BAD.
    multi_line: fields may hold line breaks; without them large files can be split between tasks."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", multi_line)
    parts = []
    for names, files in sorted(layouts(spark, path).items()):
        d = reader.schema(text_schema([*names, BAD])).option("columnNameOfCorruptRecord", BAD).csv(files)
        parts.append(d.select("*", F.col("_metadata.file_name").alias(FILE)))
    if not parts:
        return spark.createDataFrame([], text_schema([BAD, FILE]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str | list[str], columns=None) -> DataFrame:
    """CSV files with headers as text columns (those named, or all), by name."""
    d = by_header(spark, path).drop(BAD, FILE)
    return d.select(*[F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in columns]) if columns else d


def typed(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to their declared types; a value that does not fit becomes null."""
    return raw.select(*[F.col(c).try_cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])


def read_feed(spark: SparkSession, path: str | list[str], feed: str) -> DataFrame:
    """Typed feed scan, columns found by name; absent ones are null. Beside them: file_name, raw (the fields as
    JSON before any cast, or the whole line where it doesn't fit its header) and malformed (it doesn't fit)."""
    d = by_header(spark, path)
    fields = [F.col(f"`{c}`") for c in d.columns if c not in (BAD, FILE)]
    raw = F.coalesce(F.col(BAD), F.to_json(F.struct(*fields))) if fields else F.col(BAD)
    return d.select(*typed_columns(d, feed), F.col(FILE).alias("file_name"), raw.alias("raw"), F.col(BAD).isNotNull().alias("malformed"))


def typed_columns(df: DataFrame, feed: str) -> list[Column]:
    return [F.col(c).try_cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in declared(feed).items()]


def with_defaults(df: DataFrame, feed: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in FEEDS[feed]["defaults"].items()})


def route(name: str | Column) -> Column:
    """Feed kind from a file name; null where no kind matches (such files are skipped)."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    out = None
    for kind in FEEDS:
        out = F.when(n.contains(kind), kind) if out is None else out.when(n.contains(kind), kind)
    return out


def newest_file(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of the most recently written CSV of a directory, of equally new ones the last by name; only that
    file is read."""
    newest = _written(spark, directory).agg(F.max(F.struct("modificationTime", "path")).alias("x")).select("x.path").first()
    return by_header(spark, [newest.path]).drop(BAD).withColumnRenamed(FILE, "file_name")


def _written(spark: SparkSession, directory: str) -> DataFrame:
    """Path and time of each CSV of a directory; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory).select("path", "modificationTime")


def newest_write(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Rows of the directory whose files were written last, of equally new ones the last in the list, for snapshots
    that span many files; only that directory's files are read."""
    times = [_written(spark, d).agg(F.max("modificationTime").alias("t")).select("t", F.lit(i).alias("i")) for i, d in enumerate(directories)]
    newest = reduce(DataFrame.union, times).filter("t is not null").agg(F.max(F.struct("t", "i")).alias("x")).select("x.i").first()
    return read_csv(spark, directories[newest.i])


def _fill(raw: DataFrame, defaults: dict) -> dict[str, Column]:
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    out = {}
    for c, v in defaults.items():
        value = F.lit(v).cast(kinds[type(v)])
        out[c] = F.coalesce(F.col(c).try_cast(kinds[type(v)]), value) if c in raw.columns else value
    return out


def orders_csv(raw: DataFrame) -> DataFrame:
    """Orders text to types: two timestamps must parse, two become null when they do not."""

    def time(c: str, strict: bool) -> Column:
        t = F.col(c).try_cast("timestamp").cast("timestamp_ntz")
        return F.when(F.col(c).isNotNull() & t.isNull(), F.raise_error(F.concat(F.lit(f"bad {c}: "), F.col(c)))).otherwise(t) if strict else t

    d = raw.withColumns({c: time(c, strict) for c, strict in ORDER_TIMES.items()})
    return d.withColumns({"total_price": F.col("total_price").try_cast("double"), "subtotal_price": F.col("subtotal_price").try_cast("double"), **_fill(raw, ORDER_DEFAULTS)})


def line_items_csv(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"quantity": F.col("quantity").try_cast("bigint"), "price": F.col("price").try_cast("double"), **_fill(raw, LINE_DEFAULTS)})


def _numbers(raw: DataFrame, names) -> dict[str, Column]:
    return {c: F.col(c).try_cast("double") for c in names if c in raw.columns}


def ads_csv(raw: DataFrame) -> DataFrame:
    """Ad rows with the attributed products as an array; bad JSON becomes null and is flagged."""
    items = product_list("attributed_products")
    return raw.withColumns({"date": F.to_date("date"), **_numbers(raw, AD_NUMBERS), "products": items, "bad_products": items.isNull() & F.col("attributed_products").isNotNull()})


def mail_csv(raw: DataFrame) -> DataFrame:
    items = product_list("featured_products")
    return raw.withColumns({"date": F.to_date("date"), **_numbers(raw, MAIL_NUMBERS), "products": items, "bad_products": items.isNull() & F.col("featured_products").isNotNull()})


LOADERS = {"orders": orders_csv, "line_items": line_items_csv, "ads": ads_csv, "email": mail_csv}


def load_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Every named source through its loader: orders, line_items, ads, email."""
    return {name: LOADERS[name](read_csv(spark, path)) for name, path in paths.items()}


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per business key, ties decided by the other columns; one foldable aggregate, no window."""
    rest = [c for c in df.columns if c not in key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("x")
    return df.groupBy(*key).agg(last).select(*key, "x.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stored rows with the new batch merged in: the last row per business key wins."""
    return last_per_key(old.unionByName(new), key, order)


def upsert_into(table: Versions, new: DataFrame, key: list[str], order: list[str], bucket: Column, tag: str | None = None) -> int:
    """Merges a batch into a stored table: the last row per business key wins. Only buckets that the batch's keys fall
    into are read and written anew; the table's other files stay as they are. bucket: an expression on the key, such as
    a range of order numbers, chosen so that a bucket is a task's worth of rows and that a day's batch meets few of them."""
    batch = cut(new.withColumn(table.by, bucket), "batch")
    touched = [r[0] for r in batch.select(F.col(table.by).cast("string")).distinct().collect()]
    # One shuffle, by bucket: the keys of a bucket are then in one task.
    rows = table.read(batch, touched).unionByName(batch).repartition(table.by)
    return table.publish(table.stage(last_per_key(rows, [table.by, *key], order)), tag)
