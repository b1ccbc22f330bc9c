"""Written tables that cut lineage; ranks and scans in row order that no single task has to hold."""

from __future__ import annotations

import functools
import operator
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`. Where that is unset, a local session gets
    one of its own; on a cluster it is an error, as no machine's own folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task groups at once: some hundred bytes each in a table of its own for every aggregate of a stage.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its number of rows asks for, so what a task holds doesn't grow with the input.
    An aggregate on these keys and others needs no further shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joins on group columns of the same names, null to null; the left's stay."""
    named = right.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = functools.reduce(operator.and_, (F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.lit(True))
    return left.join(named, same, how).drop(*(f"_by{i}" for i in range(len(by))))


def in_order(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """df sorted by group and order over all tasks, written, with each row's task `_part` and place in it `_at`.

    A group of any size is spread over as many tasks as it fills. Only the first group of a task can begin in an earlier
    one, so what a scan carries from task to task is one row a task at most."""
    keys = [*(F.col(f"`{c}`") for c in by), *order]
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    return placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def carried(placed: DataFrame, by: list[str], end: Column, fold: Callable[[str], Column]) -> DataFrame:
    """Adds `_carried`: `end`, an aggregate of a group's rows in one task, folded over the group's earlier tasks."""
    quoted = [F.col(f"`{c}`") for c in by]
    tasks = Window.partitionBy(*quoted).orderBy("_part")
    parts = placed.groupBy("_part", *quoted).agg(end.alias("_end"))
    parts = parts.select("_part", *quoted, fold("_end").over(tasks.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.row_number().over(tasks).alias("_nth")).where("_nth > 1").drop("_nth")
    return join_groups(placed, F.broadcast(parts), ["_part", *by], "left")  # one row a task at most


def within(by: list[str]) -> WindowSpec:
    return Window.partitionBy("_part", *(F.col(f"`{c}`") for c in by)).orderBy("_at")


def previous(placed: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Adds `_prev`: these columns of the row before in the group, null for its first row."""
    row = F.struct(*columns)
    return carried(placed, by, F.max_by(row, "_at"), F.last).withColumn("_prev", F.coalesce(F.lag(row).over(within(by)), "_carried")).drop("_carried")


def latest(placed: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Adds `_latest`: the last value that isn't null in the group's rows up to and with this one."""
    last = functools.partial(F.last, ignorenulls=True)
    seen = placed.withColumn("_value", value)
    out = carried(seen, by, F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))), last)
    return out.withColumn("_latest", F.coalesce(last("_value").over(within(by).rowsBetween(Window.unboundedPreceding, 0)), "_carried")).drop("_value", "_carried")


def running(placed: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Adds `_sum`: the sum of a number that is never null over the group's rows up to and with this one."""
    seen = placed.withColumn("_value", value)
    here = F.sum("_value").over(within(by).rowsBetween(Window.unboundedPreceding, 0))
    return carried(seen, by, F.sum("_value"), F.sum).withColumn("_sum", here + F.coalesce("_carried", F.lit(0))).drop("_value", "_carried")


def ranks(df: DataFrame, by: list[str], *order: Column | str, of_groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with `rn`, the row's number from 1 within its group in that order, and the group's size `n`. `of_groups` may add
    columns to the table of groups (by, n), which the rows then get too.

    Rows are sorted by range over all tasks, so a group of any size is spread; a row's number is its place in its task
    plus what lies before that task, less what lies before its group."""
    by = list(by)
    quoted = [F.col(f"`{c}`") for c in by]
    placed = in_order(df, by, *order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a task
    placed = placed.join(F.broadcast(before), "_part").withColumn("_row", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
    of_groups = of_groups or (lambda groups: groups)
    if not by:
        whole = of_groups(sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")))  # one row
        return placed.withColumn("rn", F.col("_row") + 1).crossJoin(F.broadcast(whole)).drop("_row")
    groups = placed.groupBy(*quoted).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
    return join_groups(placed, of_groups(groups), by).withColumn("rn", F.col("_row") - F.col("_first") + 1).drop("_row", "_first")
