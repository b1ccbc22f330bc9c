"""Buckets over step at power-of-two levels. A bucket is an additive state, so all roll-ups are sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.values import BLOCK, bucket_of, finite, level_for
from tideline.operators.series import twema
from tideline.operators.stats import robust_stats
from tideline.plans.shared import written

STATE = ["n_fin", "sum_v", "sum_s", "sum_t", "n_pos", "n_neg", "sum_s_inf", "sum_t_inf"]
SERIES = ["run_id", "key"]


def state() -> list[Column]:
    """The state of points (step, t, value): sums over finite values, and over infinite ones apart. NaN is no value."""
    fin, inf = finite("value"), F.abs("value") == math.inf
    total = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0))
    return [
        F.count_if(fin).alias("n_fin"), total("value", fin).alias("sum_v"), total("step", fin).alias("sum_s"), total("t", fin).alias("sum_t"),
        F.count_if(F.col("value") == math.inf).alias("n_pos"), F.count_if(F.col("value") == -math.inf).alias("n_neg"), total("step", inf).alias("sum_s_inf"), total("t", inf).alias("sum_t_inf"),
    ]


def summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in STATE]


def finished(buckets: DataFrame) -> DataFrame:
    """Adds n, mean, step and tmean: of the finite values, else of the infinite ones."""
    fin = F.col("n_fin") > 0
    inf = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), math.nan).when(F.col("n_pos") > 0, math.inf).otherwise(-math.inf)
    n = F.when(fin, F.col("n_fin")).otherwise(F.col("n_pos") + F.col("n_neg"))
    return buckets.withColumns({"n": n, "mean": F.when(fin, F.col("sum_v") / F.col("n_fin")).otherwise(inf), "step": F.when(fin, F.col("sum_s")).otherwise(F.col("sum_s_inf")) / n, "tmean": F.when(fin, F.col("sum_t")).otherwise(F.col("sum_t_inf")) / n})


def bucketize(points: DataFrame, level: Column | int) -> DataFrame:
    """Buckets of points at one level (or each row's own): run_id, key, level, bucket and the state."""
    level = F.lit(level) if isinstance(level, int) else level
    kept = points.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.withColumn("level", level.cast("int")).withColumn("bucket", bucket_of("step", F.col("level"))).groupBy(*SERIES, "level", "bucket").agg(*state())


def merge(buckets: DataFrame, up: Column | int) -> DataFrame:
    """Buckets `up` levels coarser; a negative number is an error. Arithmetic shifts round down, as floor does."""
    if isinstance(up, int) and up < 0:
        raise ValueError("buckets can only be merged upwards; use refine for a finer level")
    up = F.lit(up) if isinstance(up, int) else up
    checked = F.when(up < 0, F.raise_error(F.lit("buckets can only be merged upwards; use refine for a finer level")).cast("int")).otherwise(up.cast("int"))
    lifted = buckets.withColumn("_up", checked).withColumns({"level": F.col("level") + F.col("_up"), "bucket": F.call_function("shiftright", F.col("bucket"), F.col("_up"))})
    return lifted.groupBy(*SERIES, "level", "bucket").agg(*summed())


def at_level(buckets: DataFrame, level: int) -> DataFrame:
    """Many series' buckets, each at a level of its own, brought to one coarser level."""
    return merge(buckets, F.lit(level) - F.col("level"))


def refine(buckets: DataFrame, finer: int) -> DataFrame:
    """Buckets at a finer level than stored: each whole, where its mean step lies."""
    return finished(buckets).withColumns({"bucket": bucket_of("step", finer), "level": F.lit(finer)}).groupBy(*SERIES, "level", "bucket").agg(*summed())


def cut(buckets: DataFrame, lo: int, hi: int, runs: DataFrame | None = None) -> DataFrame:
    kept = buckets.where((F.col("bucket") >= lo) & (F.col("bucket") < hi))
    return kept.join(runs.select("run_id"), "run_id", "left_semi") if runs is not None else kept


def by_block(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("block", F.floor(F.col("bucket") / BLOCK))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two bucket sets as one; buckets that both hold are merged."""
    return a.unionByName(b).groupBy(*SERIES, "level", "bucket").agg(*summed())


def gap_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted steps of one task the gaps between a series' neighbours, counted by level (_level, _c, _lo, _hi), and
    the first and last step of the task's first and last series (_part, _first, _last), where gaps lie between tasks."""
    part, names = TaskContext.get().partitionId(), ["run_id", "key", "_level", "_c", "_lo", "_hi", "_part", "_first", "_last"]
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
    ends, held = [], None  # (run, key, first, last) of the first series and of the latest one

    def made(series: list, columns: list) -> pa.RecordBatch:
        n = len(series[0])
        return pa.RecordBatch.from_arrays([*series, *(pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    for b in batches:
        if not b.num_rows:
            continue
        run, key = b.column("run_id"), b.column("key")
        step = b.column("step").cast(pa.float64()).to_numpy(zero_copy_only=False)
        codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (run, key)]
        new = np.append(True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]))
        before = np.append(np.nan, step[:-1])
        first, last = (run[0], key[0]), (run[-1], key[-1])
        goes_on = held is not None and held[:2] == first
        before[new] = np.nan
        if goes_on:
            before[0] = held[3]
        else:
            ends.append((*first, step[0], step[0])) if not ends else None
        begin = np.flatnonzero(new)
        close = step[np.append(begin[1:], len(step)) - 1]
        if ends and (ends[0][:2] == first):
            ends[0] = (*ends[0][:3], close[0])
        held = (*last, held[2] if goes_on and len(begin) == 1 else step[begin[-1]], step[-1])
        gap = step - before
        own = np.flatnonzero(gap > 0)
        if len(own):
            gap, level, series = gap[own], np.frexp(gap[own])[1] - 1, np.cumsum(new)[own] - 1
            order = np.lexsort((level, series))
            gap, level, series = gap[order], level[order], series[order]
            at = np.flatnonzero(np.append(True, (series[1:] != series[:-1]) | (level[1:] != level[:-1])))
            row = pa.array(begin[series[at]])
            yield made([run.take(row), key.take(row)], [level[at], np.diff(np.append(at, len(gap))), np.minimum.reduceat(gap, at), np.maximum.reduceat(gap, at), None, None, None])
    if held is not None:
        ends += [held] if held[:2] != ends[0][:2] else []
        series = [pa.array([e[k].as_py() for e in ends], b.schema.field(name).type) for k, name in enumerate(SERIES)]
        yield made(series, [None] * 4 + [[part] * len(ends), [e[2] for e in ends], [e[3] for e in ends]])


def finest(points: DataFrame) -> DataFrame:
    """Per series the level of the median gap between its distinct steps, -20 at least; null for a single step.

    Steps are sorted over all tasks, and what leaves a task is its gaps counted by their own level, with the ends of two
    series. The two middle gaps are of the same level, or the greatest of one level and the least of the next, so counts,
    least and greatest gaps by level give the median's level."""
    keys = [*SERIES, "step"]
    kinds = dict(points.dtypes)
    placed = points.where("step IS NOT NULL").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    counted = written(placed.mapInArrow(gap_levels, f"run_id {kinds['run_id']}, key {kinds['key']}, _level int, _c long, _lo double, _hi double, _part int, _first double, _last double"), "gap-levels")
    edges = counted.where("_part IS NOT NULL").withColumn("gap", F.col("_first") - F.lag("_last").over(Window.partitionBy(*SERIES).orderBy("_part")))  # two rows a task
    level = lambda c: F.floor(F.log2(c)).cast("int")
    between = edges.where("gap > 0").select(*SERIES, level(F.col("gap")).alias("_level"), F.lit(1).cast("long").alias("_c"), F.col("gap").alias("_lo"), F.col("gap").alias("_hi"))
    levels = counted.where("_level IS NOT NULL").select(between.columns).unionByName(between).groupBy(*SERIES, "_level").agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*SERIES)  # a row a level, about 2,000 at most
    seen = levels.withColumns({"_to": F.sum("_c").over(w.orderBy("_level")), "_n": F.sum("_c").over(w)}).withColumn("_from", F.col("_to") - F.col("_c") + 1)
    holds = lambda rank: F.floor(rank).between(F.col("_from"), F.col("_to"))
    low, high = (F.col("_n") + 1) / 2, F.col("_n") / 2 + 1  # ranks of the middle gaps, one if _n is odd
    middle = seen.groupBy(*SERIES).agg(F.max(F.when(holds(low), F.col("_level"))).alias("_a"), F.max(F.when(holds(high), F.col("_level"))).alias("_b"), F.max(F.when(holds(low), F.col("_hi"))).alias("_l"), F.max(F.when(holds(high), F.col("_lo"))).alias("_h"))
    return middle.select(*SERIES, F.greatest(F.lit(-20), F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(level(F.col("_l") * 0.5 + F.col("_h") * 0.5))).alias("fine"))


def spans(points: DataFrame) -> DataFrame:
    """Per series fine, top, lo, hi: the levels that are kept and the range of steps."""
    out = points.where(~F.isnan("value")).groupBy(*SERIES).agg(F.min("step").alias("lo"), F.max("step").alias("hi")).withColumn("top", level_for(F.col("hi") - F.col("lo")))
    return out.join(finest(points), SERIES, "left").withColumn("fine", F.least(F.coalesce("fine", "top"), F.col("top"))).select(*SERIES, "fine", "top", "lo", "hi")


def build_pyramid(points: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All levels from fine to top of every series: points are summed once at the finest, then rolled up by one sum."""
    known = spans(points) if known is None else known
    base = bucketize(points.join(known.select(*SERIES, "fine", "top"), SERIES), F.col("fine"))
    return roll_up(base, known)


def roll_up(base: DataFrame, known: DataFrame) -> DataFrame:
    lifted = base.join(known.select(*SERIES, "top"), SERIES).withColumn("_to", F.explode(F.sequence(F.col("level"), F.greatest("level", "top"))))
    lifted = lifted.withColumns({"bucket": F.call_function("shiftright", F.col("bucket"), F.col("_to") - F.col("level")), "level": F.col("_to")})
    return lifted.groupBy(*SERIES, "level", "bucket").agg(*summed())


def growth(pyramid: DataFrame | Callable[[DataFrame], DataFrame], known: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What more points, late ones too, add to a pyramid, and the spans after them. Only the new points are summed and
    rolled up; where the top rises, the old top is lifted. Nothing else of the pyramid is read: it may be given as a
    function that reads the buckets of some series and levels. fine stays."""
    new = spans(more).select(*SERIES, F.col("fine").alias("_fine"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    grown = known.join(new, SERIES, "full").select(*SERIES, F.col("top").alias("_old"), F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"), F.coalesce("fine", "_fine").alias("fine"))
    grown = written(grown.withColumn("top", F.greatest(F.coalesce("_old", "fine"), level_for(F.col("hi") - F.col("lo")))), "spans")
    delta = roll_up(bucketize(more.join(grown.select(*SERIES, "fine"), SERIES), F.col("fine")), grown)
    rises = grown.where("top > _old").select(*SERIES, F.col("_old").alias("level"))
    risen = (pyramid(rises) if callable(pyramid) else pyramid).join(rises, [*SERIES, "level"])
    lifted = roll_up(risen, grown).join(known.select(*SERIES, F.col("top").alias("_old")), SERIES).where("level > _old").drop("_old")
    return lifted.unionByName(delta), grown.select(*SERIES, "fine", "top", "lo", "hi")


def grow(pyramid: DataFrame, known: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole pyramid and spans with more points. What is added is written, so growing again and again doesn't compute
    it anew. A store that is kept up adds the growth alone."""
    added, grown = growth(pyramid, known, more)
    return combine(pyramid, written(added, "growth")), grown


def compile_due(points: DataFrame, compiled: DataFrame, least: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Points of runs that are built anew (fewer than `least` rows compiled, so that fine follows the steps), and the new
    points of those that grow. compiled: run_id, compiled."""
    held = points.join(compiled, "run_id", "left").withColumn("compiled", F.coalesce("compiled", F.lit(0)))
    return held.where(F.col("compiled") < least).drop("compiled"), held.where((F.col("compiled") >= least) & (F.col("seq") >= F.col("compiled"))).drop("compiled")


def read_blocks(pyramid: DataFrame, known: DataFrame, asks: DataFrame) -> DataFrame:
    """Blocks asked for as (key, level, block), of all series: coarser than the top from the top, within the kept levels
    as stored, finer than those from the finest at mean steps."""
    return asked_of(pyramid, known.join(asks.select("key", F.col("level").alias("_level"), F.col("block").alias("_block")), "key"))


def asked_of(pyramid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks (_level, _block) of each of the series in wanted."""
    wanted = wanted.withColumn("_from", F.greatest(F.least("_level", "top"), "fine"))
    held = pyramid.join(wanted, SERIES).where(F.col("level") == F.col("_from"))
    place = F.when(F.col("_level") >= F.col("level"), F.call_function("shiftright", F.col("bucket"), F.greatest(F.col("_level") - F.col("level"), F.lit(0)))).otherwise(bucket_of("step", F.col("_level")))
    put = finished(held).withColumns({"bucket": place, "level": F.col("_level")}).where(F.floor(F.col("bucket") / BLOCK) == F.col("_block"))
    return put.groupBy(*SERIES, "level", F.col("_block").alias("block"), "bucket").agg(*summed())


def view_buckets(pyramid: DataFrame, known: DataFrame, width: int, px: int, zoom: tuple[float, float] | None = None) -> DataFrame:
    """What a chart `width` wide with `px` a bucket shows of all series: the layers' blocks, the finer ones over the
    coarser. The levels follow from one row; the blocks are a dozen at most."""
    blocks = [(level, block) for level, (lo, hi) in layers(known, width, px, zoom) for block in range(math.floor(lo / (BLOCK * 2.0**level)), math.floor(hi / (BLOCK * 2.0**level)) + 1)]
    if not blocks:
        return pyramid.limit(0)
    asks = F.array(*(F.struct(F.lit(level).cast("int").alias("_level"), F.lit(block).cast("long").alias("_block")) for level, block in blocks))
    read = asked_of(pyramid, known.withColumn("_ask", F.explode(asks)).select("*", "_ask.*").drop("_ask"))
    asked = known.sparkSession.range(1).select(F.explode(asks).alias("a")).select(F.col("a._level").alias("level"), F.col("a._block").alias("block"))
    return overlay(read.drop("block"), asked)


def keep_top_levels(pyramid: DataFrame, known: DataFrame, below: int = 2) -> DataFrame:
    return pyramid.join(known.select(*SERIES, "top"), SERIES).where(F.col("level") >= F.col("top") - below).drop("top")


def layers(known: DataFrame, width: int, px: int, zoom: tuple[float, float] | None = None, most: float = 1.5e6) -> list[tuple[int, tuple[float, float]]]:
    """(level, range) to read for a chart: one over all steps, and a finer one over the zoom of at most 8 blocks. The
    spans are reduced to one row before they reach the driver."""
    r = known.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if r["n"] == 0:
        return []
    buckets = max(1.0, min(width / px, most / r["n"]))
    level = lambda span: max(-20, min(62, math.ceil(math.log2(span / buckets)))) if span > 0 else 0
    out = [(level(r["hi"] - r["lo"]), (r["lo"], r["hi"]))]
    if zoom:
        fine = level(zoom[1] - zoom[0])
        while math.floor(zoom[1] / (BLOCK * 2.0**fine)) - math.floor(zoom[0] / (BLOCK * 2.0**fine)) >= 8:
            fine += 1
        if fine < out[0][0]:
            out.append((fine, zoom))
    return out


def overlay(buckets: DataFrame, asked: DataFrame) -> DataFrame:
    """The finest buckets where their blocks were asked for; coarser ones only where their mean step lies in no asked
    block of a finer level. asked: (level, block)."""
    steps = finished(buckets)
    levels = asked.select(F.col("level").alias("_finer")).distinct()
    tries = steps.join(F.broadcast(levels), F.col("_finer") < F.col("level"))  # at most 83 levels
    tries = tries.withColumn("_block", F.floor(F.col("step") / (F.pow(F.lit(2.0), F.col("_finer").cast("double")) * BLOCK)))
    covered = tries.join(asked.select(F.col("level").alias("_finer"), F.col("block").alias("_block")), ["_finer", "_block"], "left_semi").select(*SERIES, "level", "bucket").distinct()
    return buckets.join(covered, [*SERIES, "level", "bucket"], "left_anti")


def with_tail(buckets: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """Buckets with the points that came after them. held: per series and level, `seq` up to which buckets go."""
    late = rows.join(held, SERIES).where(F.col("seq") >= F.col("held_seq"))
    return combine(buckets, bucketize(late, F.col("level")))


# ---- x-bins ----


def bin_grid(x0: float, x1: float, most: int, least: float = 0.0) -> dict[str, float]:
    """Bins of a power-of-two width at whole multiples of it: first edge, width, number."""
    width = max(least, 2.0 ** math.ceil(math.log2((x1 - x0) / most)))
    first = math.floor(x0 / width)
    return {"g0": first * width, "dx": width, "bins": max(1, math.floor(x1 / width) + 1 - first)}


def bin_rows(points: DataFrame, x0: float, x1: float, bins: int, x: str = "step", log_axis: bool = False, weight: str | None = None) -> DataFrame:
    """Each series' mean per x-bin (the last bin takes x1), weighted by the rows a point stands for; of its finite
    values, else infinite. Empty bins between full ones are interpolated."""
    c = F.when(F.col(x) > 0, F.log10(x)) if log_axis else F.col(x)
    w = F.col(weight) if weight else F.lit(1)
    fin, v = finite("value"), F.col("value")
    inside = points.where(c.between(x0, x1) & ~F.isnan("value")).withColumn("bin", F.least(F.lit(bins - 1), F.floor((c - x0) * (bins / (x1 - x0)))).cast("int"))
    sums = inside.groupBy(*SERIES, "bin").agg((F.sum(F.when(fin, v * w)) / F.sum(F.when(fin, w))).alias("_m"), F.max(v == math.inf).alias("_p"), F.max(v == -math.inf).alias("_q"))
    mean = F.coalesce("_m", F.when(F.col("_p") & F.col("_q"), math.nan).when(F.col("_p"), math.inf).otherwise(-math.inf))
    return fill_gaps(sums.select(*SERIES, "bin", mean.alias("value")))


def fill_gaps(bins: DataFrame) -> DataFrame:
    """Straight lines across the empty bins between a series' full ones; nothing beyond its ends. A series has a row a
    bin here, as many as the grid's."""
    w = Window.partitionBy(*SERIES).orderBy("bin")
    ends = bins.withColumns({"_b": F.lead("bin").over(w), "_v": F.lead("value").over(w)})
    spread = ends.withColumn("_k", F.explode(F.sequence(F.col("bin"), F.coalesce(F.col("_b") - 1, F.col("bin")))))
    part = (F.col("_k") - F.col("bin")) / (F.col("_b") - F.col("bin"))
    return spread.select(*SERIES, F.col("_k").alias("bin"), F.when(F.col("_k") == F.col("bin"), F.col("value")).otherwise(F.col("value") * (1 - part) + F.col("_v") * part).alias("value"))


def agg_bins(binned: DataFrame, groups: DataFrame, center: str = "median") -> DataFrame:
    """Statistics of each group's series in every bin. groups: run_id, group."""
    return robust_stats(binned.join(groups, "run_id"), ["group", "bin"], "value", center, ("run_id", "key"))


def smoothed_bins(points: DataFrame, x0: float, x1: float, bins: int, alpha: float | None, x: str = "step", weight: str | None = None) -> DataFrame:
    """bin_rows of each run's smoothed series (raw if alpha is none), weighted by the rows that a point stands for."""
    if alpha:
        points = twema(points, alpha, x=x).drop("value").withColumnRenamed("smoothed", "value")
    return bin_rows(points, x0, x1, bins, x, weight=weight)


def density(binned: DataFrame, y0: float, y1: float, ny: int) -> DataFrame:
    """Series counted per x-bin and y-cell, with the colour log(1 + d) / log(1 + max)."""
    cells = binned.where(finite("value") & F.col("value").between(y0, y1)).withColumn("cell", F.least(F.lit(ny - 1), F.floor((F.col("value") - y0) * (ny / (y1 - y0)))).cast("int")).groupBy("bin", "cell").agg(F.count(F.lit(1)).alias("d"))
    top = cells.agg(F.max("d").alias("_top"))  # one row
    return cells.join(F.broadcast(top)).withColumn("shade", F.log1p("d") / F.log1p("_top")).drop("_top")


def line_density(binned: DataFrame, y0: float, y1: float, ny: int) -> DataFrame:
    """Series counted in every y-cell of an x-bin that their line crosses, with the colour log(1 + d) / log(1 + max).

    A line joins a series' neighbouring bins at their centres, so in a bin it takes the cells from its value there to
    half way to either neighbour, all of them once. What a line adds to a bin is two rows of a difference array, where it
    comes in and where it has gone, however steep it is; sums over the cells in order give the counts. Values that aren't
    finite break a line; what lies beyond y0 and y1 is cut off. A series in one bin alone counts in its cell."""
    w = Window.partitionBy(*SERIES).orderBy("bin")  # a row a bin, as many as the grid's
    beside = lambda near, step: F.when((near("bin").over(w) == F.col("bin") + step) & finite(near("value").over(w)), (F.col("value") + near("value").over(w)) / 2)
    ends = fill_gaps(binned).withColumns({"_a": beside(F.lag, -1), "_b": beside(F.lead, 1)}).where(finite("value"))
    spans = ends.select("bin", F.least("value", F.coalesce("_a", "value"), F.coalesce("_b", "value")).alias("lo"), F.greatest("value", F.coalesce("_a", "value"), F.coalesce("_b", "value")).alias("hi")).where((F.col("hi") >= y0) & (F.col("lo") <= y1))
    cell = lambda c: F.least(F.lit(ny - 1), F.greatest(F.lit(0), F.floor((F.col(c) - y0) * (ny / (y1 - y0))))).cast("int")
    sides = F.array(F.struct(cell("lo").alias("cell"), F.lit(1).alias("c")), F.struct((cell("hi") + 1).alias("cell"), F.lit(-1).alias("c")))
    steps = spans.select("bin", F.explode(sides).alias("s")).groupBy("bin", "s.cell").agg(F.sum("s.c").alias("c"))
    column = Window.partitionBy("bin").orderBy("cell")  # at most ny + 1 rows
    runs = steps.select("bin", "cell", F.sum("c").over(column).alias("d"), F.lead("cell").over(column).alias("_to")).where("d > 0")
    cells = runs.select("bin", F.explode(F.sequence("cell", F.col("_to") - 1)).alias("cell"), "d")
    top = cells.agg(F.max("d").alias("_top"))  # one row
    return cells.join(F.broadcast(top)).withColumn("shade", F.log1p("d") / F.log1p("_top")).drop("_top")
