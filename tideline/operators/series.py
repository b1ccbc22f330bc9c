"""Metric points as series: reductions, smoothing, thinning, decimation, as-of values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from tideline.functions.values import finite, log_x, smooth_scale
from tideline.plans.shared import dealt, in_order, join_groups, latest, previous, ranks, running, written

SERIES = ["run_id", "key"]


def last_values(points: DataFrame) -> DataFrame:
    """Each metric's value in the last row that has it, finite or not."""
    return points.groupBy(*SERIES).agg(F.max_by("value", "seq").alias("value"))


def key_stats(points: DataFrame) -> DataFrame:
    """Per run and metric: points, first_step, last_step, last."""
    return points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("points"), F.min_by("step", "seq").alias("first_step"), F.max_by("step", "seq").alias("last_step"), F.max_by("value", "seq").alias("last"))


def summaries(rows: DataFrame, points: DataFrame, user: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """Per run: the last values as a map, the last row's step and runtime, and the user's own summary entries, which a
    logged metric of the same name covers. count: the number of rows, which are counted if it isn't told; runs are dealt to
    as many tasks as it asks for."""
    count = rows.count() if count is None else count
    last = dealt(last_values(points), count, "run_id").groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("summary"))
    ends = rows.groupBy("run_id").agg(F.max_by(F.struct("step", "t"), "seq").alias("_l"), (F.max("seq") + 1).alias("rows"))
    out = dealt(ends, count, "run_id").select("run_id", F.col("_l.step").alias("_step"), F.col("_l.t").alias("_runtime"), "rows").join(last, "run_id", "left")
    if user is not None:
        out = out.join(user.select("run_id", F.col("summary").alias("_user")), "run_id", "left").withColumn("summary", F.map_concat(F.map_filter(F.coalesce("_user", F.create_map().cast("map<string,double>")), lambda k, v: ~F.coalesce(F.map_contains_key("summary", k), F.lit(False))), F.coalesce("summary", F.create_map().cast("map<string,double>")))).drop("_user")
    return out


def reduce_series(points: DataFrame, how: str = "last", at: float | None = None, x: str = "step") -> DataFrame:
    """One number from each series' finite points: last, first, max, min or mean; with `at`, the value at the last point
    whose x is at most that. Null where there is none."""
    ok = finite("value") & ((F.col(x) <= at) if at is not None else F.lit(True))
    v, s = F.when(ok, F.col("value")), F.when(ok, F.col("seq"))
    how = "last" if at is not None else how
    made = {"last": F.max_by("value", s), "first": F.min_by("value", s), "max": F.max(v), "min": F.min(v), "mean": F.avg(v)}[how]
    return points.groupBy(*SERIES).agg(made.alias("value"))


def extents(points: DataFrame, x: str = "step") -> DataFrame:
    """Per series: min, max and smallest positive x, and whether x never falls in row order."""
    step = previous(in_order(points.select(*SERIES, "seq", x), SERIES, "seq"), SERIES, x).withColumn("_p", F.col(f"_prev.{x}"))
    return step.groupBy(*SERIES).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(F.when(F.col(x) > 0, F.col(x))).alias("x_positive"), F.every(F.col("_p").isNull() | (F.col(x) >= F.col("_p"))).alias("rises"))


# ---- smoothing: an associative scan in row order ----


def fold(x: np.ndarray, y: np.ndarray, first: np.ndarray, alpha: float, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums and weights of finite points of many series, one after the other, and each point's distance from the
    first of its series, all in units of scale. first: where a series begins.

    A point's state (a, d, D) is put after another's as (a1 * alpha^D2 + a2, d1 * alpha^D2 + d2, D1 + D2); doubling
    steps, each of them for the points that still have others that far before them in their series, give all prefixes."""
    step = np.where(first, 0.0, np.maximum(x - np.roll(x, 1), 0.0))
    span = np.divide(step, scale, out=np.zeros(len(x)), where=step > 0)
    place = np.arange(len(x))
    place -= np.maximum.accumulate(np.where(first, place, 0))
    a, d, k = y.astype(float), np.ones(len(y)), 1
    while len(at := np.flatnonzero(place >= k)):
        w = alpha ** span[at]
        a[at], d[at], span[at] = a[at - k] * w + a[at], d[at - k] * w + d[at], span[at - k] + span[at]
        k *= 2
    return a, d, span


def folded_batches(batches: Iterator[pa.RecordBatch], alpha: float, x: str, block: int) -> Iterator[pa.RecordBatch]:
    """The sorted rows of one task with the states of their series so far in it, `block` rows at a time: sum _a and weight
    _d up to each finite point, its distance _span from the task's first one of that series at _x0; `_last` marks the
    task's last row, which gets the state of its series' last finite point (at _x1). Rows without a finite point get no
    sum."""
    part, held, before = TaskContext.get().partitionId(), None, None  # before: key, a, d, span, x0, x1
    for whole in batches:
        for at in range(0, whole.num_rows, block):
            b = whole.slice(at, block)
            n = b.num_rows
            code = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (b.column("run_id"), b.column("key"))]
            new = np.append(True, (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1]))
            key = lambda i, b=b: (b.column("run_id")[i].as_py(), b.column("key")[i].as_py())
            series = np.cumsum(new) - 1
            xs, ys, scale = (b.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in (x, "value", "_scale"))
            ok = np.flatnonzero(np.isfinite(xs) & np.isfinite(ys))
            own = series[ok]
            first = np.append(True, own[1:] != own[:-1])[: len(ok)]
            a, d, span = fold(xs[ok], ys[ok], first, alpha, scale[ok])
            x0 = xs[ok][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(ok) else np.zeros(0)
            if before is not None and before[0] == key(0):
                if len(more := np.flatnonzero(own == 0)):
                    gap = max(xs[ok[0]] - before[5], 0.0)
                    span[more] += before[3] + (gap / scale[ok[0]] if gap > 0 else 0.0)
                    w = alpha ** (span[more] - before[3])
                    a[more], d[more], x0[more] = a[more] + before[1] * w, d[more] + before[2] * w, before[4]
            else:
                before = None
            if len(ok) and own[-1] == series[-1]:
                before = (key(n - 1), a[-1], d[-1], span[-1], x0[-1], xs[ok[-1]])
            elif series[-1] > 0:
                before = None
            made = {c: np.full(n, np.nan) for c in ("_a", "_d", "_span", "_x0", "_x1")}
            for c, v in zip(made, (a, d, span, x0, xs[ok]), strict=True):
                made[c][ok] = v
            if held is not None:
                yield held
            last = np.zeros(n, bool)
            held = pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), *(pa.array(v) for v in made.values()), pa.array(last)], [*b.schema.names, "_part", *made, "_last"])
    if held is not None:
        n = held.num_rows
        end = dict(zip(("_a", "_d", "_span", "_x0", "_x1"), before[1:] if before else [float("nan")] * 5, strict=True))
        yield held
        # One more row a task tells the next ones where its last series stands.
        tail = [held.column(c).slice(n - 1, 1) if c not in end and c != "_last" else pa.array([end.get(c, True)]) for c in held.schema.names]
        yield pa.RecordBatch.from_arrays(tail, held.schema.names)


def carry(frames: Iterator[pd.DataFrame], alpha: float) -> Iterator[pd.DataFrame]:
    """For each task in order, the state that the series it may go on with has reached before it. A row a task."""
    rows, state = [], None  # state: run_id, key, a, d, x1
    for f in frames:
        for r in f.itertuples(index=False):
            run, key, scale, part, a, d, span, x0, x1 = r
            if state is not None and state[2] is not None:
                rows.append((part, *state))
            if state is None or (run, key) != state[:2]:
                state = (run, key, None, None, None)
            if a == a:
                if state[2] is not None:
                    w = alpha ** (span + (max(x0 - state[4], 0.0) / scale if x0 > state[4] else 0.0))
                    a, d = a + state[2] * w, d + state[3] * w
                state = (run, key, a, d, x1)
    yield pd.DataFrame(rows, columns=["_part", "run_id", "key", "_ca", "_cd", "_cx"])


def twema(points: DataFrame, alpha: float, scale: Column | str | float | None = None, x: str = "step", block: int = 65536) -> DataFrame:
    """Adds `smoothed`: the time-weighted, debiased moving average of each series in row order. Non-finite values, and
    points without an x, pass through and don't move x. scale: one for each row's series; by default that of its whole
    span.

    Rows are sorted by series and order over all tasks, each task folds its rows `block` at a time, however many series
    they are of, and one row a task tells how far its last series has come; so a series of any length is spread."""
    if scale is None:
        scales = points.groupBy(*SERIES).agg(smooth_scale(F.max(x) - F.min(x)).alias("_scale"))
        scaled = join_groups(points, scales, SERIES)
    else:
        scaled = points.withColumn("_scale", F.lit(float(scale)) if isinstance(scale, (int, float)) else F.col(scale) if isinstance(scale, str) else scale)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    state = ["_a", "_d", "_span", "_x0", "_x1"]
    schema = StructType([*scaled.schema.fields, StructField("_part", IntegerType()), *(StructField(c, DoubleType()) for c in state), StructField("_last", BooleanType())])
    keys = [*SERIES, "seq"]
    placed = scaled.repartitionByRange(*keys).sortWithinPartitions(*keys)
    folded = written(placed.mapInArrow(lambda batches: folded_batches(batches, alpha, x, block), schema), "folded")
    ends = folded.where("_last").select(*SERIES, "_scale", "_part", *state).repartition(1).sortWithinPartitions("_part")  # a row a task
    carried = ends.mapInPandas(lambda frames: carry(frames, alpha), f"_part int, run_id {kinds['run_id']}, key {kinds['key']}, _ca double, _cd double, _cx double")
    met = join_groups(folded.where("NOT _last"), F.broadcast(carried), ["_part", *SERIES], "left")
    gap = F.greatest(F.col("_x0") - F.col("_cx"), F.lit(0.0))
    w = F.pow(F.lit(alpha), F.col("_span") + F.when(gap > 0, gap / F.col("_scale")).otherwise(0.0))
    mean = F.when(F.col("_ca").isNull(), F.col("_a") / F.col("_d")).otherwise((F.col("_a") + F.col("_ca") * w) / (F.col("_d") + F.col("_cd") * w))
    return met.withColumn("smoothed", F.when(F.isnan("_a"), F.col("value")).otherwise(mean)).select(*points.columns, "smoothed")


def thin(points: DataFrame, last: int | None = None, every: int | None = None, n: int | None = None) -> DataFrame:
    """The last `last` points of each series, of these every `every`-th and the final one, of these n evenly spaced.
    A point's place after each step follows from the one before, so rows are ranked once."""
    if not (last or n or every and every > 1):
        return points
    out = ranks(points, SERIES, "seq").withColumnsRenamed({"rn": "_rn", "n": "_n"})
    if last:
        out = out.where(F.col("_rn") > F.col("_n") - last)
        out = out.withColumns({"_rn": F.col("_rn") - F.greatest(F.col("_n") - last, F.lit(0)), "_n": F.least("_n", F.lit(last))})
    if every and every > 1:
        out = out.where(((F.col("_rn") - 1) % every == 0) | (F.col("_rn") == F.col("_n")))
        out = out.withColumns({c: F.ceil((F.col(c) - 1) / every) + 1 for c in ("_rn", "_n")})
    if n:
        step = (F.col("_n") - 1) / (n - 1) if n > 1 else F.col("_n").cast("double")
        i = F.rint((F.col("_rn") - 1) / step)  # the only index that can round to this place
        near = F.array(*(F.greatest(F.least(i + k, F.lit(n - 1)), F.lit(0)) for k in (-1, 0, 1)))
        hit = F.exists(near, lambda j: F.rint(j * step) == F.col("_rn") - 1)
        out = out.where((F.col("_n") <= n) | hit)
    return out.drop("_rn", "_n")


def series_report(points: DataFrame, keys: Column, x: str = "step", since: float | None = None, until: float | None = None, last: int | None = None, every: int | None = None, n: int | None = None, smooth: float | None = None) -> DataFrame:
    """The long table run_id, key, x, value (and smoothed, over the filtered points at the whole series' scale), thinned."""
    whole = points.where(keys)
    scales = whole.groupBy(*SERIES).agg(smooth_scale(F.max(x) - F.min(x)).alias("_scale"))
    cut = whole.join(scales, SERIES).where((F.col(x) >= since if since is not None else F.lit(True)) & (F.col(x) <= until if until is not None else F.lit(True)))
    if smooth:
        cut = twema(cut, smooth, "_scale", x)
    return thin(cut, last, every, n).select(*SERIES, "seq", x, "value", *(["smoothed"] if smooth else []))


def decimate(points: DataFrame, x0: float, x1: float, width: int, x: str = "step", log_y: bool = False, log_axis: bool = False) -> DataFrame:
    """At most four points of each series for each pixel column: first, least, greatest, last; and one row without a
    value for each island of points that can't be drawn. In row order; points that can't be drawn split a column."""
    px = log_x(x) if log_axis else F.col(x)
    ok = F.coalesce(finite("value") & (F.col("value") > 0 if log_y else F.lit(True)) & finite(px), F.lit(False))
    marked = points.select(*SERIES, "seq", x, "value", ok.alias("_ok"), F.when(ok, F.floor((px - x0) * (width / (x1 - x0)))).alias("_px"))
    marked = previous(in_order(marked, SERIES, "seq"), SERIES, "_ok", "_px")
    new = (F.col("_ok") != F.coalesce("_prev._ok", F.lit(False))) | ~F.col("_px").eqNullSafe(F.col("_prev._px"))
    v = F.struct("seq", F.col(x).alias("x"), "value")
    per = running(marked, SERIES, new.cast("long")).withColumnRenamed("_sum", "_piece").groupBy(*SERIES, "_piece", "_ok").agg(F.min_by(v, "seq").alias("f"), F.min_by(v, F.struct("value", "seq")).alias("lo"), F.min_by(v, F.struct(-F.col("value"), "seq")).alias("hi"), F.max_by(v, "seq").alias("l"))
    gap = F.struct(F.col("f.seq").alias("seq"), F.col("f.x").alias("x"), F.lit(float("nan")).alias("value"))
    drawn = per.where(F.col("_ok") | (F.col("_piece") > 0)).select(*SERIES, F.explode(F.array_distinct(F.when(F.col("_ok"), F.array("f", "lo", "hi", "l")).otherwise(F.array(gap)))).alias("p"))
    return drawn.select(*SERIES, "p.*")


def visible(points: DataFrame, x0: float, x1: float, x: str = "step") -> DataFrame:
    """Points in [x0, x1] and one neighbour on either side; x must not fall in row order. A neighbour is the last point
    before x0 of a series that goes on to it, and the first one after x1 of a series that begins by it."""
    c = F.col(x)
    edges = points.groupBy(*SERIES).agg(F.max(F.when(c < x0, F.col("seq"))).alias("_before"), F.min(F.when(c > x1, F.col("seq"))).alias("_after"), (F.max(x) >= x0).alias("_reaches"), (F.min(x) <= x1).alias("_begins"))
    crosses = ((F.col("seq") == F.col("_before")) & F.col("_reaches")) | ((F.col("seq") == F.col("_after")) & F.col("_begins"))
    return points.join(edges, SERIES).where(c.between(x0, x1) | F.coalesce(crosses, F.lit(False))).select(points.columns)


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each run."""
    ends = rows.groupBy("run_id").agg(F.max("seq").alias("_end"))
    return rows.join(ends, "run_id").where(F.col("seq") > F.col("_end") - n).drop("_end")


# ---- as-of values ----


def asof_join(probes: DataFrame, points: DataFrame, x: str = "step") -> DataFrame:
    """For each probe (run_id, x) the value of the last finite point at or before it, null where there is none.

    Points and distinct probes are sorted together over all tasks, and each task hands on its last point. Points without
    an x are left out; equal probes get equal rows."""
    p = points.where(finite("value") & F.col(x).isNotNull()).select("run_id", F.col(x).alias("x"), "seq", F.struct(F.col(x).alias("at"), "value").alias("_v"), F.lit(0).alias("_probe"))
    asked = probes.select("run_id", "x")
    q = asked.distinct().select("run_id", "x", F.lit(None).cast("long").alias("seq"), F.lit(None).cast(p.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_probe"))
    found = latest(in_order(p.unionByName(q), ["run_id"], "x", "_probe", "seq"), ["run_id"], F.col("_v")).where("_probe = 1")
    return join_groups(asked, found.select("run_id", "x", F.col("_latest.at").alias("at"), F.col("_latest.value").alias("value")), ["run_id", "x"])


def nearest(points: DataFrame, x0: float, x: str = "step") -> DataFrame:
    """Each series' point nearest to x0; equal distances go left; of points sharing the left x the last, of those sharing
    the right x the first."""
    c = F.col(x)
    order = F.struct(F.abs(c - x0), (c >= x0).cast("int"), F.when(c < x0, -F.col("seq")).otherwise(F.col("seq")))
    return points.groupBy(*SERIES).agg(F.min_by(F.struct("seq", F.col(x).alias("x"), "value"), order).alias("p")).select(*SERIES, "p.*")
