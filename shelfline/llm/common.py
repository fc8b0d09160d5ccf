"""Shared helpers: Arrow batches in and out, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

U64 = np.uint64
# Fixed odd multipliers of a 64-bit finaliser.
MIX_1, MIX_2, STEP = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

#: Rows and bytes that a Python worker holds as lists at a time (one row may be larger).
SLICE, SLICE_BYTES = 1000, 16 << 20
#: Rows in an Arrow batch.
BATCH = 1000
#: Rows of a few numbers each up to which a side of a join is broadcast; larger ones are left to the optimizer.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of SLICE rows and, where rows are long, of about SLICE_BYTES."""
    rows = min(SLICE, max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
    if rows == SLICE or batch.num_rows <= 1:
        yield from (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))
        return
    # Long rows: halves until they fit, so that a few giants among short rows don't make all slices small.
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from pieces(part) if part.nbytes > SLICE_BYTES or part.num_rows > SLICE else [part]


def map_lists(
    df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, keep: list[str] = (), read: list[str] | None = None, as_lists: bool = True
) -> DataFrame:
    """Batch map on Arrow: fn gets the `read` columns (by default those outside `keep`) as lists, or as Arrow arrays,
    and returns the new columns as lists or Arrow arrays of the same length; the `keep` columns pass through
    untouched. schema: of the new columns. Batches are worked off in slices of bounded rows and bytes."""
    keep = list(keep)
    given = [c for c in df.columns if c not in keep] if read is None else read
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)
    out = StructType([df.schema[c] for c in keep] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            new = fn(*[batch.column(c).to_pylist() if as_lists else batch.column(c) for c in given])
            arrays = [batch.column(c) for c in keep]
            arrays += [x if isinstance(x := new[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])
        give_back()

    return small_batches(df).select(*keep, *[c for c in given if c not in keep]).mapInArrow(run, out)


def give_back() -> None:
    """Freed memory goes back to the system at the end of a task; a worker is kept for the next one and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """Batches of BATCH rows on their way to Python and back, so that texts in transit stay small on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table as the side of a join: broadcast if it has few rows (by default: of a few numbers each)."""
    return F.broadcast(df) if df.count() <= rows else df


def numbered(df: DataFrame) -> DataFrame:
    """The columns renamed to _0, _1, ... so that columns added beside them clash with none."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns _0, _1, ... under their names again; all others go."""
    return df.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case. bytes.lower() changes ASCII letters only and bytes.split()
    cuts at ASCII white space only, so a word is a run of [^\\x20\\x09-\\x0D]."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def spread(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n permutations of the 32-bit numbers."""
    x = mixed((np.arange(1, 2 * n + 1, dtype=U64) + U64(seed) * U64(2 * n)) * STEP)
    return (x[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> U64(32)).astype(np.uint32)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """Smallest a*v+b (mod 2^32) over all values, for each permutation; blocks stay in the CPU's cache."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(values), block):
        np.minimum(low, (a[:, None] * values[None, i : i + block] + b[:, None]).min(axis=1), out=low)
    return low


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_part(column: str, parts: int) -> Column:
    """crc32 of a column's text, modulo parts; null counts as the empty text."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % parts
