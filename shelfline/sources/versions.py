"""Tables of versions: partitions are staged, then published together by a small manifest.

A table has one partition column (a date, a key range or a hash bucket). A build writes some partitions under
`builds/build=<name>/`, where no reader looks. `publish` then writes the next manifest: one row per partition with the
build that holds it. Readers open the newest complete manifest, so all partitions of a publication appear together; a
job that dies between staging and publishing leaves the old version, and going back is one more manifest.

A manifest is a single Parquet file that Spark's committer renames into place, and it counts once its _SUCCESS mark is
there; it has as many rows as the table has partitions. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import listed, removed

#: Spark's name for the partition of rows without a value.
NULL = "__HIVE_DEFAULT_PARTITION__"
MANIFEST = "value string, build string, rows bigint"


class Versions:
    def __init__(self, spark: SparkSession, root: str, by: str):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by

    # -- metadata

    def _numbers(self, complete: bool = True) -> list[int]:
        """Numbers of the manifests, ascending."""
        found = [int(m[1]) for name in listed(self.spark, f"{self.root}/manifests") if (m := re.fullmatch(r"version=(\d+)", name))]
        return sorted(n for n in found if not complete or "_SUCCESS" in listed(self.spark, f"{self.root}/manifests/version={n}"))

    def latest(self) -> int:
        """Number of the version that readers see, 0 before the first."""
        for n in reversed(self._numbers(complete=False)):
            if "_SUCCESS" in listed(self.spark, f"{self.root}/manifests/version={n}"):
                return n
        return 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """value, build, rows of every partition of a version (by default the newest), and `tag`."""
        n = self.latest() if version is None else version
        if not n:
            return self.spark.createDataFrame([], MANIFEST + ", tag string")
        return self.spark.read.schema(MANIFEST + ", tag string").parquet(f"{self.root}/manifests/version={n}")

    def tag(self) -> str | None:
        """What the newest version was published for."""
        row = self.manifest().filter("value is null and build is null").first()
        return row.tag if row else None

    def builds(self, version: int | None = None) -> dict[str, str]:
        """Partition value to build; as many entries as the table has partitions."""
        return {r.value: r.build for r in self.manifest(version).filter("build is not null").collect()}

    # -- rows

    def _open(self, where: dict[str, str]) -> DataFrame | None:
        if not where:
            return None
        paths = [f"{self.root}/builds/build={b}/{self.by}={v}" for v, b in where.items()]
        return self.spark.read.option("basePath", f"{self.root}/builds").parquet(*paths).drop("build")

    def read(self, like: DataFrame, values: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its partitions only; no other partition's files are opened. like: a
        frame of the table's columns, for the types and for a table without rows."""
        where = self.builds(version)
        if values is not None:
            where = {v: where[v] for v in {NULL if v is None else v for v in values} & set(where)}
        return self._shaped(self._open(where), like)

    def _shaped(self, rows: DataFrame | None, like: DataFrame) -> DataFrame:
        if rows is None:
            return self.spark.createDataFrame([], like.schema)
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in like.schema])

    def stage(self, rows: DataFrame) -> DataFrame:
        """Writes the rows as a build that no reader sees; returns a row per partition: value, build, rows."""
        build = uuid.uuid4().hex
        rows.write.partitionBy(self.by).parquet(f"{self.root}/builds/build={build}")
        return self.staged(build)

    def staged(self, build: str) -> DataFrame:
        path = f"{self.root}/builds/build={build}"
        if not any(name.startswith(f"{self.by}=") for name in listed(self.spark, path)):
            return self.spark.createDataFrame([], MANIFEST)
        # Counts come from the files' footers: no column is read.
        found = self.spark.read.parquet(path).groupBy(self.by).agg(F.count(F.lit(1)).alias("rows"))
        return found.select(F.coalesce(F.col(self.by).cast("string"), F.lit(NULL)).alias("value"), F.lit(build).alias("build"), "rows")

    def staged_rows(self, staged: DataFrame, like: DataFrame) -> DataFrame:
        """The rows behind entries of `stage`, for checks before they are published."""
        return self._shaped(self._open({r.value: r.build for r in staged.collect()}), like)

    # -- publication

    def publish(self, staged: DataFrame, tag: str | None = None, drop: Iterable[str] = ()) -> int:
        """Makes staged partitions visible in place of older ones of the same value, and drops others. Returns the
        number of the new version; a tag that was published last is not published again."""
        if tag is not None and tag == self.tag():
            return self.latest()
        old = self.manifest().filter("build is not null").select("value", "build", "rows")
        kept = old.join(staged.select("value"), "value", "left_anti")
        gone = list(drop)
        if gone:
            kept = kept.filter(~F.col("value").isin(gone))
        return self._write(kept.unionByName(staged.select("value", "build", "rows")), tag)

    def rollback(self, version: int, tag: str | None = None) -> int:
        """Publishes an older version again: a manifest is written, no row is moved."""
        return self._write(self.manifest(version).filter("build is not null").select("value", "build", "rows"), tag)

    def _write(self, entries: DataFrame, tag: str | None) -> int:
        n = max(self._numbers(complete=False), default=0) + 1
        note = self.spark.createDataFrame([(None, None, 0, tag)], MANIFEST + ", tag string")
        every = entries.withColumn("tag", F.lit(None).cast("string")).unionByName(note)
        every.coalesce(1).write.parquet(f"{self.root}/manifests/version={n}")
        return n

    def changed(self, since: int, version: int | None = None) -> tuple[list[str], list[str]]:
        """Partitions that differ between two versions: those new or built anew, and those gone."""
        before, now = (self.builds(since) if since in self._numbers() else {}), self.builds(version)
        return sorted(v for v, b in now.items() if before.get(v) != b), sorted(set(before) - set(now))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the files of partitions that only versions before the last `keep` name; returns how many. Builds
        that no manifest ever named may be under way and stay."""
        numbers = self._numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        live = {(v, b) for n in kept for v, b in self.builds(n).items()}
        dead = {(v, b) for n in old for v, b in self.builds(n).items()} - live
        removed(self.spark, [f"{self.root}/builds/build={b}/{self.by}={v}" for v, b in dead])
        removed(self.spark, [f"{self.root}/manifests/version={n}" for n in old])
        return len(dead)
