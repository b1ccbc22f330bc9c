"""Tables that streams keep in parts, so that a batch reads and writes what it touches.

`Slots` replaces: rows lie in hash partitions of their keys, and a version writes anew the partitions that it touches.
`Tiers` adds: a version is a segment of its own, and segments of like size are merged, so a row is written again once per
tier; partitions by level and keys are read apart. Versions follow the batches of one stream from 0 on. A batch that is run
again writes the same version from the same one before it, so a failed batch leaves no trace.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Slots:
    """A table in `slots` partitions by a hash of `keys`. Which version's files hold a partition is written with each
    version, a row a partition, so the driver's part is bounded by that number whatever the table holds."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], slots: int = 64):
        self.spark, self.path, self.schema, self.keys, self.slots = spark, path.rstrip("/"), schema, keys, slots
        self.known: dict[int, dict[int, int]] = {-1: {}}  # what the last versions hold, as it is written

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.slots)).cast("int")

    def touched(self, df: DataFrame) -> set[int]:
        return {r[0] for r in df.select(self.slot()).distinct().collect()}

    def held(self, version: int) -> dict[int, int]:
        """The version that last wrote each partition that holds rows."""
        if version not in self.known:
            self.known[version] = {r[0]: r[1] for r in self.spark.read.schema("slot int, version int").parquet(f"{self.path}/held/v={version}").collect()}
        return self.known[version]

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, version: int, slots: Iterable[int] | None = None) -> DataFrame:
        """The table after a version, or these partitions of it."""
        held = self.held(version)
        paths = [f"{self.path}/rows/v={v}/slot={s}" for s, v in sorted(held.items()) if slots is None or s in set(slots)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.none()

    def put(self, df: DataFrame, version: int, touched: Iterable[int]) -> None:
        """df has all rows of the touched partitions, which replace what was there; the others stay."""
        touched, at = set(touched), f"{self.path}/rows/v={version}"
        df.withColumn("slot", self.slot()).where(F.col("slot").isin(*touched) if touched else F.lit(False)).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(at)
        files = self.spark.read.schema(f"{self.schema}, slot int").parquet(at).inputFiles()
        full = {int(found[1]) for f in files if (found := re.search(r"/slot=(\d+)/", f))}
        held = {s: v for s, v in self.held(version - 1).items() if s not in touched} | dict.fromkeys(full, version)
        self.spark.createDataFrame(sorted(held.items()), "slot int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/v={version}")
        self.known = {-1: {}, version - 1: self.held(version - 1), version: held}


class Tiers:
    """A table of additive rows with a column `level`, as sorted segments by (level, slot of `keys`). Of each tier at most
    `every` - 1 segments are left: the next one makes them a segment of the tier above, with rows of one key summed."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], summed: Callable[[DataFrame], DataFrame], every: int = 4, slots: int = 16):
        self.spark, self.path, self.schema, self.keys, self.summed, self.every, self.slots = spark, path.rstrip("/"), schema, keys, summed, every, slots

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.slots)).cast("int")

    def live(self, version: int) -> list[str]:
        """The segments that make up a version: one for each unit of its digits in base `every`."""
        out, at, left, size = [], 0, version + 1, 1
        while size * self.every <= left:
            size *= self.every
        while left > 0:
            while left >= size:
                out.append(f"{at}-{at + size}")
                at, left = at + size, left - size
            size //= self.every
        return out

    def rows(self, segments: list[str], parts: set[tuple[int, int]] | None = None) -> DataFrame:
        """Rows of these segments, not summed; of these (level, slot) alone, whose files are the only ones to be read."""
        if not segments or (parts is not None and not parts):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(f"{self.schema}, seg string, slot int").option("basePath", self.path).parquet(*(f"{self.path}/seg={s}" for s in segments))
        if parts is not None:
            found = found.where(F.concat_ws("/", "level", "slot").isin(*(f"{level}/{slot}" for level, slot in parts)))
        return found.drop("seg", "slot")

    def read(self, version: int, parts: set[tuple[int, int]] | None = None) -> DataFrame:
        return self.summed(self.rows(self.live(version), parts))

    def parts_of(self, df: DataFrame) -> set[tuple[int, int]]:
        """Where rows of df (keys, level) lie: at most as many as there are levels and slots."""
        return {(r[0], r[1]) for r in df.select("level", self.slot()).distinct().collect()}

    def write(self, df: DataFrame, segment: str) -> None:
        df.withColumn("slot", self.slot()).repartition("level", "slot").sortWithinPartitions(*self.keys).write.mode("overwrite").partitionBy("level", "slot").parquet(f"{self.path}/seg={segment}")

    def put(self, df: DataFrame, version: int) -> None:
        """Adds a version, and merges the tiers that are full with it."""
        self.write(df, f"{version}-{version + 1}")
        size = self.every
        while (version + 1) % size == 0:
            step = size // self.every
            self.write(self.summed(self.rows([f"{at}-{at + step}" for at in range(version + 1 - size, version + 1, step)])), f"{version + 1 - size}-{version + 1}")
            size *= self.every
