"""Quality rules: base rules and robust multivariate outliers.

Every text becomes a vector of four transformed statistics. For each language and source, a minimum-covariance-
determinant estimate (the mean and covariance of the tightest half of its rows) says what is usual there; rows at a large
Mahalanobis distance are rejected. The half is the usual (rows + components + 1) / 2, so junk of any shape must be nearly
half of a group before it can be taken for usual.

The half is sought from three starts: coordinate-wise medians and deviations, all rows, and the directions of rows from
the medians. A concentration step takes the rows closest to an estimate and estimates anew from them; steps go on for as
long as the determinant falls, and the least determinant of all starts is a group's estimate. Rows within its 97.5 %
ellipsoid are then counted once more. All this is done for languages first; a language's estimate counts as some rows more
in each of its sources, and is a start there, so a source of few rows leans on it and one of many doesn't.

The vectors are whole numbers on a grid, so medians come from exact histograms, and sums are exact whatever the order
of partitions. A concentration step is one aggregation by group and distance bin: the bins that hold the closest part
are summed, so no group is ever gathered, however many rows it has. Of the bin at the edge only the share still wanted
counts, so copies of one vector can't enter together beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import aside, back, chunks, join_spread, written
from tideline.llm.text_stats import quality_stats

P = 4  # components of a vector; even, so that the chi-square distribution has a closed form
GRID = 1024
#: What the components' standard deviations are at least, from the noise of a text of some fifty words alone. Order: log
#: letters a word (a word's own deviation of a third, over the root of 50), and the roots of the shares of symbols,
#: capitals and punctuation (1 / (2 root of n) whatever the share: 0.03 for 300 letters, 0.02 for 600).
FLOORS = (0.05, 0.02, 0.03, 0.02)
#: Most groups whose estimates are broadcast (under 200 bytes each). Beyond it they are joined by key, spread over tasks;
#: both joins give the same rows.
BROADCAST_GROUPS = 50_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
GROUP = ["lang_key", "source_key"]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in PAIRS)]
ESTIMATE = [*(f"m{i}" for i in range(P)), *(f"v{i}{j}" for i, j in PAIRS)]
COVARIANCE = [f"c{i}{j}" for i, j in PAIRS]
KEYS = "lang_key string, source_key string"
DOUBLES = ", ".join(f"{c} double" for c in ESTIMATE)


def vectors(s: dict[str, np.ndarray]) -> list[np.ndarray]:
    chars, words = np.maximum(s["word_chars"], 1), np.maximum(s["n_words"], 1)
    parts = (np.log(chars / words), np.sqrt(s["n_symbols"] / chars), np.sqrt(s["n_upper"] / chars), np.sqrt(s["n_punct"] / chars))
    return [np.rint(GRID * x).astype(np.int64) for x in parts]


def measure(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in chunks(whole, "text"):
            s = quality_stats(b.column("text"))
            made = [*(s[k] for k in STATS), *vectors(s)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(x, pa.int64()) for x in made], [*keep, *STATS, *X])


def text_statistics(docs: DataFrame, keep_text: bool) -> DataFrame:
    """docs as `row` (and `text`) with the base statistics, base_failed, the vector and the group keys; a null language or
    source is a group."""
    work, keep = aside(docs, "text"), ["row", "text"] if keep_text else ["row"]
    schema = T.StructType([work.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in (*STATS, *X)])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col("row").getField(c).cast("string")), F.lit("")) if c in docs.columns else F.lit("")
    return work.mapInArrow(lambda batches: measure(batches, keep), schema).withColumns({"base_failed": failed, "lang_key": key("lang"), "source_key": key("source")})


def chi_square(x: float, dof: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    term, total = 1.0, 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dof) < q else (low, mid)
    return high


@lru_cache(maxsize=65536)
def consistency(share: float) -> float:
    """What the covariance of the closest `share` of a normal sample is multiplied with to estimate the whole one's."""
    return share / chi_square(chi_quantile(share, P), P + 2)


def covariance(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances from the moments of a batch of groups."""
    n = np.maximum(f["n"].to_numpy(float), 1e-9)
    mean = np.stack([f[f"s{i}"].to_numpy(float) / n for i in range(P)], 1)
    cov = np.zeros((len(f), P, P))
    for i, j in PAIRS:
        cov[:, i, j] = cov[:, j, i] = f[f"s{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
    return mean, cov


def estimates(f: pd.DataFrame, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """f with the mean m, the covariance c, its inverse v with the floors, and log_det, its determinant's logarithm."""
    made = {f"c{i}{j}": cov[:, i, j] for i, j in PAIRS}
    cov = cov + np.diag((np.array(FLOORS) * GRID) ** 2)
    inverse = np.linalg.inv(cov)
    made |= {f"m{i}": mean[:, i] for i in range(P)} | {f"v{i}{j}": inverse[:, i, j] * (1 if i == j else 2) for i, j in PAIRS}
    return f.assign(**made, log_det=np.linalg.slogdet(cov)[1])


def prior(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The language's mean and covariance (l_m, l_c) for each row of f."""
    mean, cov = f[[f"l_m{i}" for i in range(P)]].to_numpy(float), np.zeros((len(f), P, P))
    for i, j in PAIRS:
        cov[:, i, j] = cov[:, j, i] = f[f"l_c{i}{j}"].to_numpy(float)
    return mean, cov


def leaned(f: pd.DataFrame, factor: np.ndarray, lean: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances (times `factor`) from the moments in f, with the language's as `lean` rows more."""
    mean, cov = covariance(f)
    cov *= factor[:, None, None]
    if "l_m0" not in f:
        return mean, cov
    wide_mean, wide_cov = prior(f)
    own = (f["n"] / (f["n"] + lean)).to_numpy(float)[:, None]
    apart = mean - wide_mean
    cov = own[..., None] * cov + (1 - own[..., None]) * wide_cov + (own * (1 - own))[..., None] * apart[:, :, None] * apart[:, None, :]
    return own * mean + (1 - own) * wide_mean, cov


def begun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The starts of each group: medians and deviations, all rows, directions from the medians, and the language's."""
    for f in frames:
        middle, sd = (f[[f"{c}{i}" for i in range(P)]].to_numpy(float) for c in ("med", "sd"))
        turn = np.zeros((len(f), P, P))
        for i, j in PAIRS:
            turn[:, i, j] = turn[:, j, i] = f[f"t{i}{j}"].to_numpy(float) / np.maximum(f["n"].to_numpy(float), 1) * P
        turn *= sd[:, :, None] * sd[:, None, :]
        starts = [(middle, np.eye(P) * (sd**2)[:, None]), covariance(f), (middle, turn), *([prior(f)] if "l_m0" in f else [])]
        for start, (m, c) in enumerate(starts):
            yield estimates(f[[*GROUP, "rows"]].assign(start=start), m, c)[[*GROUP, "start", "rows", *ESTIMATE]]


def stepped(frames: Iterator[pd.DataFrame], lean: float) -> Iterator[pd.DataFrame]:
    """Estimates from the moments of the closest rows."""
    for f in frames:
        factor = np.array([consistency(n / rows) for n, rows in zip(f["n"], f["rows"], strict=True)])
        yield estimates(f[[*GROUP, "start", "rows", "before"]], *leaned(f, factor, lean))[[*GROUP, "start", "rows", "before", *ESTIMATE, "log_det"]]


def settled(frames: Iterator[pd.DataFrame], lean: float) -> Iterator[pd.DataFrame]:
    """Final estimates from the moments of the rows within each group's ellipsoid."""
    for f in frames:
        yield estimates(f[[*GROUP]], *leaned(f, np.full(len(f), consistency(0.975)), lean))[[*GROUP, *ESTIMATE, *COVARIANCE]]


def distance() -> Column:
    """Squared Mahalanobis distance."""
    d = [F.col(X[i]) - F.col(f"m{i}") for i in range(P)]
    return reduce(lambda a, b: a + b, [F.col(f"v{i}{j}") * d[i] * d[j] for i, j in PAIRS])


def met(points: DataFrame, known: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """points with what is known of their groups (and `rows`, the group's number)."""
    if groups <= BROADCAST_GROUPS:
        return points.join(F.broadcast(known), GROUP, how)
    return join_spread(points, known.withColumn("group_rows", F.col("rows")), GROUP, X, how).withColumnRenamed("group_rows", "rows")


def fit(stats: DataFrame, lean: float = 20.0, least_fall: float = 1e-2) -> tuple[DataFrame, int]:
    """Estimates by language and source from all rows that pass the base rules, and how many groups there are. lean: how
    many rows of a source a language's estimate counts for. Steps end when no start's log determinant falls by
    `least_fall` or more."""
    points = stats.where(~F.col("base_failed")).select(*GROUP, *X)
    wide, _ = tightest(points.withColumn("source_key", F.lit("")), None, lean, least_fall)
    final, groups = tightest(points, wide.select("lang_key", *(F.col(c).alias(f"l_{c}") for c in (*(f"m{i}" for i in range(P)), *COVARIANCE))), lean, least_fall)
    sizes = stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows"))
    return written(sizes.join(final.drop(*COVARIANCE), GROUP, "left"), "chosen-estimates"), groups


def tightest(points: DataFrame, languages: DataFrame | None, lean: float, least_fall: float) -> tuple[DataFrame, int]:
    """The estimates of all groups of points, and how many groups there are."""
    with_language = lambda df: df if languages is None else df.join(languages, "lang_key")  # noqa: E731  # a row a group or start
    cells = written(points.select(*GROUP, F.posexplode(F.array(*X)).alias("k", "x")).groupBy(*GROUP, "k", "x").count(), "cells")

    def middle(table: DataFrame, value: str, name: str) -> DataFrame:
        """The lower median of value, weighted by count."""
        by = Window.partitionBy(*GROUP, "k")
        seen = table.withColumns({"_c": F.sum("count").over(by.orderBy(value)), "_n": F.sum("count").over(by)})
        return seen.where(2 * F.col("_c") >= F.col("_n")).groupBy(*GROUP, "k").agg(F.min(value).alias(name), F.first("_n").alias("rows"))

    centre = middle(cells, "x", "med")
    spread = middle(cells.join(centre.drop("rows"), [*GROUP, "k"]).withColumn("_d", F.abs(F.col("x") - F.col("med"))).groupBy(*GROUP, "k", "_d").agg(F.sum("count").alias("count")), "_d", "mad").drop("rows")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).cast("double")
    sd = lambda k: F.sqrt(F.pow(1.4826 * at("mad", k), 2) + (FLOORS[k] * GRID) ** 2)
    known = written(centre.join(spread, [*GROUP, "k"]).groupBy(*GROUP).agg(F.max("rows").alias("rows"), *(at("med", k).alias(f"med{k}") for k in range(P)), *(sd(k).alias(f"sd{k}") for k in range(P))), "centres")
    groups = known.count()
    moments = [F.count(F.lit(1)).alias("n"), *(F.sum(X[i]).alias(f"s{i}") for i in range(P)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS)]
    z = [(F.col(X[k]) - F.col(f"med{k}")) / F.col(f"sd{k}") for k in range(P)]
    square = reduce(lambda a, b: a + b, [x * x for x in z])
    turns = [F.coalesce(F.sum(F.when(square > 0, z[i] * z[j] / square)), F.lit(0.0)).alias(f"t{i}{j}") for i, j in PAIRS]
    first = met(points, known, groups).groupBy(*GROUP, *(c for c in known.columns if c not in GROUP)).agg(*moments, *turns)
    active = with_language(first).mapInPandas(begun, f"{KEYS}, start int, rows long, {DOUBLES}").withColumn("before", F.lit(math.inf))
    active, steps = written(active, "starts"), []
    while True:
        bins = met(points, active, groups).withColumn("_bin", F.floor(32 * F.log2(1 + distance()))).groupBy(*GROUP, "start", "rows", "before", "_bin").agg(*moments)
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*GROUP, "start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = F.least("rows", F.floor((F.col("rows") + P + 1) / 2)) - F.col("_earlier")
        closest = bins.withColumn("_earlier", earlier).withColumn("_wanted", wanted).where("_wanted > 0")
        edge = F.col("n") > F.col("_wanted")  # one bin a group at most; the others' sums stay exact
        part = lambda c: F.coalesce(F.sum(F.when(~edge, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(edge, F.col(c) * (F.col("_wanted") / F.col("n")))), F.lit(0.0))
        summed = closest.groupBy(*GROUP, "start", "rows", "before").agg(F.sum(F.least("n", "_wanted")).alias("n"), *(part(c).alias(c) for c in MOMENTS[1:]))
        steps.append(written(with_language(summed).mapInPandas(lambda f: stepped(f, lean), f"{KEYS}, start int, rows long, before double, {DOUBLES}, log_det double"), "estimates"))
        active = steps[-1].where(F.col("log_det") < F.col("before") - least_fall)
        if not active.limit(1).count():
            break
        active = active.withColumn("before", F.col("log_det")).drop("log_det")
    best = reduce(DataFrame.unionByName, steps).groupBy(*GROUP, "rows").agg(F.min_by(F.struct(*ESTIMATE), F.struct("log_det", "start")).alias("e")).select(*GROUP, "rows", "e.*")
    near = met(points, best, groups).where(distance() <= chi_quantile(0.975, P)).groupBy(*GROUP).agg(*moments)
    near = best.select(*GROUP).join(near, GROUP, "left").na.fill(0)  # a group of outliers alone has its language's estimate
    made = ", ".join(f"{c} double" for c in (*ESTIMATE, *COVARIANCE))
    return written(with_language(near).mapInPandas(lambda f: settled(f, lean), f"{KEYS}, {made}"), "final-estimates"), groups


def judge(stats: DataFrame, found: DataFrame, groups: int, cutoff: float = 1 - 1e-9) -> DataFrame:
    """Adds `distance` and `kept`: passes the base rules and lies within the chi-square quantile `cutoff`, which one usual
    row in a billion exceeds, so that clean rows stay whatever the corpus' size."""
    joined = met(stats, found, groups, "left")
    inside = F.coalesce(distance() <= chi_quantile(cutoff, P), F.lit(True))  # no estimate: no passing row to learn from
    return joined.withColumns({"distance": distance(), "kept": ~F.col("base_failed") & inside})


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its columns but the text, the base statistics, base_failed, distance and kept.

    A null or empty text has no words and fails the base rules; so does one of under 50 words. Null languages or sources
    form groups of their own. Repeated rows count as often as they occur and get the same verdict; columns with the names
    of added ones are replaced; an empty table gives an empty result. Ties can't arise: equal vectors of one group are
    judged alike.
    """
    added = [*STATS, "base_failed", "distance", "kept"]
    stats = written(text_statistics(docs.drop(*added), keep_text=False), "text-statistics")
    judged = judge(stats, *fit(stats))
    return judged.select(*back(judged, [c for c in docs.columns if c not in ("text", *added)]), *added)


def reject_outliers(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with docs' columns; none of an empty table. Statistics are taken twice
    rather than shuffling texts."""
    stats = written(text_statistics(docs.select([c for c in docs.columns if c in ("text", "lang", "source")]), keep_text=False), "text-statistics")
    kept = judge(text_statistics(docs, keep_text=True), *fit(stats)).where("kept")
    return kept.select(*back(kept, docs.columns, "text"))
