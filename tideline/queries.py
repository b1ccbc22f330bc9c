"""Registered queries of the operators over the supplied tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import predicates as Q
from tideline.functions import values as V
from tideline.operators import pyramid as B
from tideline.operators import runs as R
from tideline.operators import series as S
from tideline.operators import stats as A
from tideline.plans import model as M
from tideline.plans.shared import written
from tideline.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, places: int) -> Column:
    """A double to so many places as the SQL's round() does it: times a power of ten, to the nearest whole number, halves
    away from zero, and back. Spark's own round() takes the shortest decimal text instead, and beside a tie the two differ."""
    x = F.col(c) if isinstance(c, str) else c
    tens = x * 10.0**places
    return F.when(F.abs(tens) < math.inf, F.round(tens) / 10.0**places).otherwise(x)


def shown(df: DataFrame, *plain: str, **doubles: str) -> DataFrame:
    """Columns, and doubles to six places with their markers where they aren't finite."""
    out = [F.col(c) for c in plain]
    for name, c in doubles.items():
        out += [F.when(V.finite(c), rounded(c, 6)).alias(name), V.to_marker(c).alias(f"{name}_mark")]
    return df.select(*out)


def mark(name: str, expr: str | None = None) -> str:
    e = expr or name
    return f"CASE WHEN isfinite({e}) THEN round({e}, 6) END AS {name}, CASE WHEN isnan({e}) THEN 'nan' WHEN isinf({e}) AND {e} > 0 THEN 'inf' WHEN isinf({e}) THEN '-inf' END AS {name}_mark"


def marks(*names: str) -> str:
    return ", ".join(mark(n) for n in names)


# ---- reductions and statistics ----

for how, expr in {"last": "arg_max(value, seq)", "first": "arg_min(value, seq)", "max": "max(value)", "min": "min(value)", "mean": "avg(value)"}.items():
    query(f"WITH {M.POINTS} SELECT run_id, key, round({expr} FILTER (WHERE isfinite(value)), 6) AS value FROM p GROUP BY run_id, key", f"A4_reduce_{how}")(
        lambda spark, d, how=how: S.reduce_series(M.points(spark, d), how).withColumn("value", rounded("value", 6))
    )


@query(f"WITH {M.POINTS} SELECT run_id, key, {mark('value', 'arg_max(value, seq)')} FROM p GROUP BY run_id, key")
def A1_last_values(spark, d):
    return shown(S.last_values(M.points(spark, d)), "run_id", "key", value="value")


@query(f"WITH {M.LINES}, s AS (SELECT run_id, max(seq) + 1 AS rows, arg_max(step, seq) AS _step, arg_max(t, seq) AS _runtime FROM l GROUP BY run_id), v AS (SELECT run_id, arg_max(quantity, seq) AS quantity, arg_max(discount, seq) AS discount FROM w GROUP BY run_id) SELECT s.run_id, rows, _step, _runtime, quantity, discount FROM s JOIN v USING (run_id)")
def A2_summaries(spark, d):
    rows = M.line_rows(spark, d)
    return S.summaries(rows, T.rows_to_points(rows), count=M.table(spark, d, "lineitem").count()).select("run_id", "rows", "_step", "_runtime", F.col("summary.quantity").alias("quantity"), F.col("summary.discount").alias("discount"))


@query(f"WITH {M.POINTS} SELECT run_id, key, count(*) AS points, round(arg_min(step, seq), 6) AS first_step, round(arg_max(step, seq), 6) AS last_step, {mark('last', 'arg_max(value, seq)')} FROM p GROUP BY run_id, key")
def A3_key_stats(spark, d):
    k = S.key_stats(M.points(spark, d)).withColumns({"first_step": rounded("first_step", 6), "last_step": rounded("last_step", 6)})
    return shown(k, "run_id", "key", "points", "first_step", "last_step", last="last")


@query(f"WITH {M.RUNS} SELECT segment, state, count(*) AS runs FROM r GROUP BY segment, state")
def A5_group_runs(spark, d):
    return R.group_runs(M.runs(spark, d), ["config.segment", "state"]).withColumnRenamed("config.segment", "segment")


#: Rank and chance of the median's interval for each group size in ns, by cumulated binomial chances.
RANKS = "ks AS (SELECT n, greatest(1, count(*) FILTER (WHERE 1 - 2 * cum >= 0.95)) AS k FROM (SELECT n, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))) OVER (PARTITION BY n ORDER BY j) AS cum FROM (SELECT n, unnest(range(greatest(n // 2, 1))) AS j FROM (SELECT DISTINCT n FROM g))) GROUP BY n)"
STATS = """, g AS (SELECT {by}, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS min, max(v) AS max, median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, list(v ORDER BY v) AS xs FROM x GROUP BY {by}),
{ranks}, h AS (SELECT g.*, k, n - 2 * (n // 4) AS kept, n // 4 AS c FROM g JOIN ks USING (n)),
i AS (SELECT *, list_avg(xs[c + 1:n - c]) AS iqm, list_var_pop(list_transform(xs, lambda z: greatest(least(z, xs[n - c]), xs[c + 1]))) * n AS w2, xs[k] AS medlo, xs[n - k + 1] AS medhi FROM h)"""
T_VALUE = "CASE WHEN {df} <= 30 THEN [" + ", ".join(map(str, A.T95)) + "][{df}] ELSE 1.96 END"
PRICES = "x AS (SELECT o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS v FROM orders)" + STATS.format(by="p, s", ranks=RANKS)


def prices(spark, d):
    return M.table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("value"), "o_orderkey")


@query(f"WITH {PRICES} SELECT p, s, n, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median, round(iqm, 4) AS iqm, min, max, round(q25, 4) AS q25, round(q75, 4) AS q75 FROM i")
def A6_robust_stats(spark, d):
    r = A.robust_stats(prices(spark, d), ["p", "s"], tie=("o_orderkey",))
    return r.select("p", "s", "n", *(rounded(c, 4).alias(c) for c in ("mean", "std", "median", "iqm")), "min", "max", rounded("q25", 4).alias("q25"), rounded("q75", 4).alias("q75"))


@query(f"WITH {PRICES} SELECT p, s, n, medlo AS ci_lo, medhi AS ci_hi FROM i")
def A7_median_ci(spark, d):
    return A.robust_stats(prices(spark, d), ["p", "s"], tie=("o_orderkey",)).select("p", "s", "n", "ci_lo", "ci_hi")


@query(f"WITH x AS (SELECT o_custkey AS p, o_totalprice AS v FROM orders), g AS (SELECT p, count(*) AS n FROM x GROUP BY p), {RANKS} SELECT n, k, round(1 - 2 * list_sum(list_transform(range(k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2)))), 9) AS coverage FROM ks")
def A8_coverage(spark, d):
    sizes = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return A.median_ranks(sizes).withColumn("coverage", rounded("coverage", 9))


@query(f"WITH {PRICES} SELECT p, s, round(mean - {T_VALUE.format(df='(n - 1)')} * std / sqrt(n), 4) AS ci_lo, round(mean + {T_VALUE.format(df='(n - 1)')} * std / sqrt(n), 4) AS ci_hi FROM i")
def A9_mean_ci(spark, d):
    return A.robust_stats(prices(spark, d), ["p", "s"], center="mean", tie=("o_orderkey",)).select("p", "s", rounded("ci_lo", 4).alias("ci_lo"), rounded("ci_hi", 4).alias("ci_hi"))


@query(f"WITH {PRICES} SELECT p, s, kept AS iqmh, round(iqm, 4) AS iqm, round(iqm - {T_VALUE.format(df='(kept - 1)')} * sqrt(w2 / (kept * (kept - 1))), 4) AS ci_lo, round(iqm + {T_VALUE.format(df='(kept - 1)')} * sqrt(w2 / (kept * (kept - 1))), 4) AS ci_hi FROM i")
def A10_iqm_ci(spark, d):
    return A.robust_stats(prices(spark, d), ["p", "s"], center="iqm", tie=("o_orderkey",)).select("p", "s", "iqmh", *(rounded(c, 4).alias(c) for c in ("iqm", "ci_lo", "ci_hi")))


GROUPS_SQL = f"WITH {M.POINTS}, u AS (SELECT run_id, arg_max(value, seq) FILTER (WHERE isfinite(value) {{at}}) AS v FROM p WHERE key = 'purchase' GROUP BY run_id), q AS (SELECT DISTINCT run_id, CAST(run_id AS INT) % 7 AS team FROM p), x AS (SELECT team, v FROM q JOIN u USING (run_id) WHERE v IS NOT NULL), t AS (SELECT team, count(*) AS runs FROM q GROUP BY team)" + STATS.format(by="team", ranks=RANKS) + " SELECT CAST(team AS VARCHAR) AS team, runs, coalesce(n, 0) AS n, median, medlo AS ci_lo, medhi AS ci_hi, min, max FROM t LEFT JOIN i USING (team)"


def event_runs(points: DataFrame) -> DataFrame:
    """Runs of the event points, in teams."""
    return points.select("run_id").distinct().select("run_id", F.concat_ws("/", (F.col("run_id").cast("int") % 7).cast("string"), "run_id").alias("path"))


def groups_report(spark, d, at=None):
    p = M.points(spark, d)
    g = R.groups(event_runs(p), p, ["run~1"], "purchase", at=at)
    return g.select(F.col("run~1").alias("team"), "runs", F.coalesce("n", F.lit(0)).alias("n"), "median", "ci_lo", "ci_hi", "min", "max")


query(GROUPS_SQL.format(at=""), "A11_groups")(groups_report)
query(GROUPS_SQL.format(at="AND step <= 1000000"), "A11_groups_at")(lambda spark, d: groups_report(spark, d, at=1e6))


@query(f"WITH {M.POINTS}, v AS (SELECT key, run_id, arg_max(value, seq) AS value FROM p GROUP BY ALL), {M.MEDIA} SELECT key, 'metric' AS kind, count(DISTINCT run_id) AS runs, NULL AS items, min(value) FILTER (WHERE isfinite(value)) AS min, round(median(value) FILTER (WHERE isfinite(value)), 6) AS median, max(value) FILTER (WHERE isfinite(value)) AS max FROM v GROUP BY key UNION ALL SELECT key, 'media', count(DISTINCT run_id), count(*), NULL, NULL, NULL FROM m WHERE run_id IN (SELECT run_id FROM p) GROUP BY key")
def A12_keys_report(spark, d):
    p = M.points(spark, d)
    return R.keys_report(event_runs(p), S.last_values(p), M.media(spark, d)).withColumn("median", rounded("median", 6))


@query(f"WITH {M.RUNS}, e AS (SELECT unnest(['', r_name, r_name || '/' || n_name]) AS path, state FROM r) SELECT path, count(*) AS runs, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'crashed') AS crashed, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'finished') AS finished FROM e GROUP BY path")
def A13_tree(spark, d):
    return R.tree(M.runs(spark, d))


@query(f"WITH {M.RUNS} SELECT n_name AS entry, count(*) AS runs, 0 AS is_run FROM r WHERE r_name = 'ASIA' GROUP BY n_name")
def A14_children(spark, d):
    return R.children(M.runs(spark, d), "ASIA")


@query(f"WITH {M.RUNS}, s AS (SELECT r_name, segment, count(*) AS runs, grouping(r_name) AS a, grouping(segment) AS b FROM r GROUP BY ROLLUP (r_name, segment)) SELECT 2 - a - b AS depth, r_name AS region, segment, runs FROM s")
def A15_group_tree(spark, d):
    g = R.group_tree(M.runs(spark, d), ["run~2", "config.segment", "config.missing"])
    return g.select("depth", F.col("`run~2`").alias("region"), F.col("`config.segment`").alias("segment"), "runs")


@query("SELECT o_orderpriority AS p, quantile_disc(o_totalprice, 0.5) AS sort_value FROM orders GROUP BY p")
def A16_group_sort_value(spark, d):
    return R.group_sort_value(prices(spark, d), ["p"], "value")


@query(f"WITH {M.RUNS} SELECT n_name AS nation, CASE min(CASE state WHEN 'running' THEN 1 WHEN 'crashed' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END) WHEN 1 THEN 'running' WHEN 2 THEN 'crashed' WHEN 3 THEN 'failed' ELSE 'finished' END AS state FROM r WHERE id % 8 <> 0 OR id % 3 = 0 GROUP BY n_name")
def A17_group_state(spark, d):
    return R.group_state(M.runs(spark, d).where("id % 8 <> 0 OR id % 3 = 0").withColumn("nation", V.leaf("parent")), ["nation"])


@query(f"WITH {M.RUNS}, f AS (SELECT 'segment' AS key, '\"' || segment || '\"' AS json FROM r UNION ALL SELECT 'nation', CAST(nation AS VARCHAR) FROM r UNION ALL SELECT 'opt.name', '\"adam\"' FROM r UNION ALL SELECT 'lr', coalesce(CAST(lr AS VARCHAR), 'null') FROM r), c AS (SELECT key, json, count(*) AS runs FROM f GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY key) > 1 AS varies, row_number() OVER (PARTITION BY key ORDER BY TRY_CAST(json AS DOUBLE) IS NULL, TRY_CAST(json AS DOUBLE), json) AS rn FROM c) SELECT key, json, runs, varies, rn FROM n WHERE rn <= 8")
def A18_config_spread(spark, d):
    r = M.runs(spark, d)
    return R.config_spread(configs(r), r).select("key", "json", "runs", "varies", F.col("rn").cast("long").alias("rn"))


def configs(r: DataFrame) -> DataFrame:
    return R.flatten_fields(r.select("run_id", F.parse_json(F.to_json("config")).alias("config")))


@query(f"WITH {M.RUNS} SELECT unnest(['run', 'run~1', 'run~2', 'state', 'segment', 'lr']) AS field, unnest([count(DISTINCT run_id), count(DISTINCT r_name || '/' || n_name), count(DISTINCT r_name), count(DISTINCT state), count(DISTINCT segment), count(DISTINCT coalesce(CAST(lr AS VARCHAR), '∅'))]) AS values FROM r")
def A19_group_candidates(spark, d):
    return R.group_candidates(M.runs(spark, d), ["run", "run~1", "run~2", "state", "segment", "lr"])


@query(f"WITH {M.POINTS}, o AS (SELECT *, lag(step) OVER (PARTITION BY run_id, key ORDER BY seq) AS b FROM p) SELECT run_id, key, round(min(step), 6) AS x_min, round(max(step), 6) AS x_max, round(min(step) FILTER (WHERE step > 0), 6) AS x_positive, bool_and(b IS NULL OR step >= b) AS rises FROM o GROUP BY run_id, key")
def A20_extents(spark, d):
    return S.extents(M.points(spark, d)).select("run_id", "key", *(rounded(c, 6).alias(c) for c in ("x_min", "x_max", "x_positive")), "rises")


@query(f"WITH {M.POINTS}, f AS (SELECT list(value ORDER BY value) AS xs, count(*) AS n FROM p WHERE isfinite(value) AND step BETWEEN 100000 AND 2000000) SELECT xs[CAST(floor(0.05 * (n - 1) + 0.5) AS INT) + 1] AS lo, xs[CAST(floor(0.95 * (n - 1) + 0.5) AS INT) + 1] AS hi FROM f")
def A21_value_range(spark, d):
    return A.value_range(M.points(spark, d), 1e5, 2e6, 0.05, 0.95)


BINS = 40
BINNED = f"""{M.POINTS}, c AS (SELECT run_id, key, least({BINS - 1}, floor(step * ({BINS} / 2592000.0)))::INT AS bin, avg(value) FILTER (WHERE isfinite(value)) AS m, bool_or(value = 'inf'::DOUBLE) AS a, bool_or(value = '-inf'::DOUBLE) AS b FROM p WHERE NOT isnan(value) AND step BETWEEN 0 AND 2592000 GROUP BY ALL),
e AS (SELECT run_id, key, bin, coalesce(m, CASE WHEN a AND b THEN 'nan'::DOUBLE WHEN a THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) AS v FROM c),
n AS (SELECT *, lead(bin) OVER w AS nb, lead(v) OVER w AS nv FROM e WINDOW w AS (PARTITION BY run_id, key ORDER BY bin)),
y AS (SELECT run_id, key, k AS bin, CASE WHEN k = bin THEN v ELSE v * (1 - (k - bin) / (nb - bin)) + nv * ((k - bin) / (nb - bin)) END AS v FROM (SELECT *, unnest(range(bin, coalesce(nb, bin + 1))) AS k FROM n))"""


def binned(spark, d):
    return B.bin_rows(M.points(spark, d), 0.0, 2592000.0, BINS)


@query(f"WITH {BINNED} SELECT run_id, key, CAST(bin AS INT) AS bin, {mark('value', 'v')} FROM y")
def B15_bin_rows(spark, d):
    return shown(binned(spark, d), "run_id", "key", "bin", value="value")


@query(f"WITH {BINNED}, x AS (SELECT key, bin, v FROM y WHERE NOT isnan(v))" + STATS.format(by="key, bin", ranks=RANKS).replace("avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, ", "").replace("quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, ", "").replace("median(v) AS median, ", "").split(",\ni AS")[0] + f" SELECT key AS \"group\", CAST(bin AS INT) AS bin, n, {mark('medlo', 'xs[k]')}, {mark('medhi', 'xs[n - k + 1]')}, {mark('min')}, {mark('max')} FROM h")
def A23_agg_bins(spark, d):
    b = binned(spark, d).withColumn("run_id", F.concat_ws("/", "key", "run_id"))
    g = b.select("run_id", F.col("key").alias("group")).distinct()
    return shown(B.agg_bins(b, g), "group", "bin", "n", medlo="medlo", medhi="medhi", min="min", max="max")


@query(f"WITH {PRICES} SELECT p, s, round(q25, 4) AS lo, round(q75, 4) AS hi FROM i")
def A24_bands(spark, d):
    return A.bands(A.robust_stats(prices(spark, d), ["p", "s"], tie=("o_orderkey",)), "median", "iqr").select("p", "s", rounded("lo", 4).alias("lo"), rounded("hi", 4).alias("hi"))


@query(f"WITH {M.POINTS} SELECT key, count(*) AS n, {mark('mean', 'avg(value)')}, {mark('min', 'min(value)')}, {mark('max', 'max(value)')} FROM p WHERE NOT isnan(value) GROUP BY key")
def A25_infinities(spark, d):
    r = A.robust_stats(M.points(spark, d), ["key"], tie=("run_id", "seq"))
    return shown(r, "key", "n", mean="mean", min="min", max="max")


@query(f"WITH {BINNED}, q AS (SELECT CAST(bin AS INT) AS bin, CAST(least(19, floor(v * 0.2)) AS INT) AS cell, count(*) AS d FROM y WHERE isfinite(v) AND v BETWEEN 0 AND 100 GROUP BY ALL) SELECT bin, cell, d, round(ln(1 + d) / ln(1 + max(d) OVER ()), 6) AS shade FROM q")
def A26_density(spark, d):
    return B.density(binned(spark, d), 0.0, 100.0, 20).withColumn("shade", rounded("shade", 6))


#: A line's cells in a bin, from its value to half way to its neighbours, counted cell by cell.
LINES_CROSS = f"""WITH {BINNED}, near_ AS (SELECT run_id, key, bin, v, lead(bin) OVER w AS b2, lead(v) OVER w AS v2, lag(bin) OVER w AS b0, lag(v) OVER w AS v0 FROM y WINDOW w AS (PARTITION BY run_id, key ORDER BY bin)),
line_ AS (SELECT bin, v, CASE WHEN isfinite(v0) AND b0 = bin - 1 THEN (v + v0) / 2 ELSE v END AS x, CASE WHEN isfinite(v2) AND b2 = bin + 1 THEN (v + v2) / 2 ELSE v END AS z FROM near_ WHERE isfinite(v)),
cross_ AS (SELECT bin, least(v, x, z) AS lo, greatest(v, x, z) AS hi FROM line_), cell_ AS (SELECT CAST(bin AS INT) AS bin, CAST(unnest(range(CAST(greatest(0, least(19, floor(lo * 0.2))) AS BIGINT), CAST(greatest(0, least(19, floor(hi * 0.2))) AS BIGINT) + 1)) AS INT) AS cell FROM cross_ WHERE hi >= 0 AND lo <= 100)"""


@query(f"{LINES_CROSS} SELECT bin, cell, count(*) AS d, round(ln(1 + count(*)) / ln(1 + max(count(*)) OVER ()), 6) AS shade FROM cell_ GROUP BY bin, cell")
def A26_line_density(spark, d):
    return B.line_density(binned(spark, d), 0.0, 100.0, 20).withColumn("shade", rounded("shade", 6))


@query("SELECT DISTINCT event_type AS key FROM events")
def A27_scope_keys(spark, d):
    return R.scope_keys(M.points(spark, d))


@query(f"WITH {M.RUNS} SELECT state, count(*) AS runs FROM r GROUP BY state")
def A28_state_counts(spark, d):
    return R.state_counts(M.runs(spark, d))


# ---- series ----

SMOOTH = f"""{M.POINTS}, f AS (SELECT *, pow(2, round_even(log2((max(step) OVER s - min(step) OVER s) / 1000), 0)) AS scale FROM p WINDOW s AS (PARTITION BY run_id, key)),
o AS (SELECT run_id, key, seq, step, value, scale FROM f WHERE isfinite(value))"""


@query(f"WITH {SMOOTH}, z AS (SELECT a.run_id, a.key, a.seq, sum(b.value * pow(0.6, (a.step - b.step) / a.scale)) / sum(pow(0.6, (a.step - b.step) / a.scale)) AS s FROM o a JOIN o b ON a.run_id = b.run_id AND a.key = b.key AND b.seq <= a.seq GROUP BY ALL) SELECT p.run_id, p.key, p.seq, {mark('smoothed', 'coalesce(s, value)')} FROM p LEFT JOIN z USING (run_id, key, seq)")
def W1_twema(spark, d):
    return shown(S.twema(M.points(spark, d), 0.6), "run_id", "key", "seq", smoothed="smoothed")


THIN = "SELECT run_id, key, seq FROM o WHERE {0}"
NUMBERED = f"WITH {M.POINTS}, o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, key) AS n FROM p WINDOW w AS (PARTITION BY run_id, key ORDER BY seq))"
query(f"{NUMBERED} SELECT run_id, key, seq FROM o WHERE i >= n - 5", "W3_thin_last")(lambda s, d: S.thin(M.points(s, d), last=5).select("run_id", "key", "seq"))
query(f"{NUMBERED} SELECT run_id, key, seq FROM o WHERE i % 3 = 0 OR i = n - 1", "W3_thin_every")(lambda s, d: S.thin(M.points(s, d), every=3).select("run_id", "key", "seq"))
query(f"{NUMBERED} SELECT run_id, key, seq FROM o WHERE n <= 4 OR i IN (SELECT unnest([round_even(j * (n - 1) / 3.0, 0) FOR j IN range(4)]))", "W3_thin_points")(lambda s, d: S.thin(M.points(s, d), n=4).select("run_id", "key", "seq"))


@query(f"WITH {M.POINTS} SELECT run_id, key, seq, round(step, 6) AS step, value FROM p WHERE key IN ('click', 'view') AND step BETWEEN 500000 AND 1500000 AND isfinite(value)")
def R5_series(spark, d):
    p = M.points(spark, d)
    return S.series_report(p.where(V.finite("value")), Q.keys_matching(F.col("key"), ["click", "view"]), since=5e5, until=1.5e6).select("run_id", "key", "seq", rounded("step", 6).alias("step"), "value")


@query(f"WITH {M.POINTS}, q AS (SELECT run_id, seq, step AS x, value, CAST(floor(step * (20 / 2592000.0)) AS INT) AS px, isfinite(value) AS ok FROM p WHERE key = 'click'), a AS (SELECT *, CASE WHEN ok IS DISTINCT FROM lag(ok) OVER w OR (ok AND px IS DISTINCT FROM lag(px) OVER w) THEN 1 ELSE 0 END AS c FROM q WINDOW w AS (PARTITION BY run_id ORDER BY seq)), b AS (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY seq) AS piece FROM a), g AS (SELECT run_id, piece, ok, min(seq) AS f, max(seq) AS e, arg_min(seq, (value, seq)) AS lo, arg_min(seq, (-value, seq)) AS hi FROM b GROUP BY ALL) SELECT DISTINCT run_id, u AS seq, ok FROM (SELECT run_id, ok, piece, unnest(CASE WHEN ok THEN [f, e, lo, hi] ELSE [f] END) AS u FROM g) WHERE ok OR piece > 1")
def W5_decimate(spark, d):
    p = M.points(spark, d).where("key = 'click'")
    return S.decimate(p, 0.0, 2592000.0, 20).select("run_id", "seq", (~F.isnan("value")).alias("ok"))


@query(f"WITH {M.POINTS}, o AS (SELECT *, lag(step) OVER w AS b, lead(step) OVER w AS a FROM p WINDOW w AS (PARTITION BY run_id, key ORDER BY seq)) SELECT run_id, key, seq FROM o WHERE step BETWEEN 500000 AND 900000 OR (step < 500000 AND a >= 500000) OR (step > 900000 AND b <= 900000)")
def W7_visible(spark, d):
    return S.visible(M.points(spark, d), 5e5, 9e5).select("run_id", "key", "seq")


@query(f"WITH {M.POINTS}, s AS (SELECT DISTINCT run_id, key, step FROM p), g AS (SELECT run_id, key, step - lag(step) OVER (PARTITION BY run_id, key ORDER BY step) AS gap FROM s) SELECT run_id, key, CAST(greatest(-20, floor(log2(median(gap)))) AS INT) AS fine FROM g WHERE gap IS NOT NULL GROUP BY run_id, key")
def W8_finest(spark, d):
    return B.finest(M.points(spark, d))


@query(f"WITH {M.LINES} SELECT run_id, seq, quantity FROM w QUALIFY seq > max(seq) OVER (PARTITION BY run_id) - 2")
def W9_tail(spark, d):
    return S.tail(M.lines(spark, d).where("key = 'quantity'"), 2).select("run_id", "seq", F.col("value").alias("quantity"))


@query(f"WITH {M.POINTS} SELECT run_id, key, arg_max(value, seq) FILTER (WHERE isfinite(value) AND step <= 700000) AS value FROM p GROUP BY run_id, key")
def J7_value_at(spark, d):
    return S.reduce_series(M.points(spark, d), at=7e5)


#: BINNED over smoothed points that stand for 1 to 3 rows.
SMOOTH_BINS = BINNED[len(M.POINTS) :].replace("avg(value) FILTER (WHERE isfinite(value)) AS m", "sum(value * (seq % 3 + 1)) FILTER (WHERE isfinite(value)) / sum(seq % 3 + 1) FILTER (WHERE isfinite(value)) AS m").replace("FROM p WHERE", "FROM sm WHERE")


@query(f"WITH {SMOOTH}, z AS (SELECT a.run_id, a.key, a.seq, sum(b.value * pow(0.6, (a.step - b.step) / a.scale)) / sum(pow(0.6, (a.step - b.step) / a.scale)) AS s FROM o a JOIN o b ON a.run_id = b.run_id AND a.key = b.key AND b.seq <= a.seq GROUP BY ALL), sm AS (SELECT p.run_id, p.key, p.seq, p.step, coalesce(s, value) AS value FROM p LEFT JOIN z USING (run_id, key, seq)){SMOOTH_BINS} SELECT key AS \"group\", CAST(bin AS INT) AS bin, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM y WHERE isfinite(v) GROUP BY key, bin")
def A23_smoothed_bins(spark, d):
    """Each run smoothed, its points weighted by the rows they stand for, then all runs of a key in each bin."""
    p = M.points(spark, d).withColumn("weight", F.col("seq") % 3 + 1)
    b = B.smoothed_bins(p, 0.0, 2592000.0, BINS, 0.6, weight="weight").where(V.finite("value")).withColumn("run_id", F.concat_ws("/", "key", "run_id"))
    stats = B.agg_bins(b, b.select("run_id", F.col("key").alias("group")).distinct())
    return stats.select("group", "bin", "n", rounded("mean", 6).alias("mean"), rounded("median", 6).alias("median"))


@query(f"WITH {M.POINTS}, f AS (SELECT * FROM p WHERE key = 'purchase' AND isfinite(value)), q AS (SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts - INTERVAL 19723 DAY) / 1e6 AS x FROM events WHERE event_type = 'error') SELECT q.run_id, round(q.x, 6) AS x, f.value FROM q ASOF LEFT JOIN f ON q.run_id = f.run_id AND q.x >= f.step")
def J9_asof_join(spark, d):
    p = M.points(spark, d)
    probes = p.where("key = 'error'").select("run_id", F.col("step").alias("x"))
    return S.asof_join(probes, p.where("key = 'purchase'")).select("run_id", rounded("x", 6).alias("x"), "value")


@query(f"WITH {M.POINTS} SELECT run_id, key, arg_min(seq, (abs(step - 800000), step >= 800000, CASE WHEN step < 800000 THEN -seq ELSE seq END)) AS seq FROM p GROUP BY run_id, key")
def J10_nearest(spark, d):
    return S.nearest(M.points(spark, d), 8e5).select("run_id", "key", "seq")


# ---- the pyramid ----


def bucket_sql(level: str, frm: str = "p") -> str:
    return f"""SELECT run_id, key, {level} AS level, CAST(floor(step / pow(2, {level})) AS BIGINT) AS bucket, count(*) FILTER (WHERE isfinite(value)) AS f, count(*) FILTER (WHERE value = 'inf'::DOUBLE) AS a, count(*) FILTER (WHERE value = '-inf'::DOUBLE) AS b, sum(value) FILTER (WHERE isfinite(value)) AS sv, sum(step) FILTER (WHERE isfinite(value)) AS ss, sum(step) FILTER (WHERE isinf(value)) AS si FROM {frm} WHERE NOT isnan(value) GROUP BY ALL"""


BUCKET_OUT = "run_id, key, CAST(level AS INT) AS level, bucket, CASE WHEN f > 0 THEN f ELSE a + b END AS n, CASE WHEN f > 0 THEN round(sv / f, 6) END AS mean, CASE WHEN f = 0 THEN CASE WHEN a > 0 AND b > 0 THEN 'nan' WHEN a > 0 THEN 'inf' ELSE '-inf' END END AS mean_mark, round(CASE WHEN f > 0 THEN ss / f ELSE si / (a + b) END, 3) AS step"


def buckets_out(b: DataFrame) -> DataFrame:
    return shown(B.finished(b).withColumn("step", rounded("step", 3)), "run_id", "key", "level", "bucket", "n", "step", mean="mean")


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT {BUCKET_OUT} FROM b")
def B1_bucketize(spark, d):
    return buckets_out(B.bucketize(M.points(spark, d), 14))


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('17')}) SELECT {BUCKET_OUT} FROM b")
def B2_merge(spark, d):
    return buckets_out(B.merge(B.bucketize(M.points(spark, d), 14), 3))


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT {BUCKET_OUT} FROM b WHERE bucket >= 20 AND bucket < 60")
def B3_cut(spark, d):
    return buckets_out(B.cut(B.bucketize(M.points(spark, d), 14), 20, 60))


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('10')}) SELECT run_id, key, CAST(floor(bucket / 256) AS BIGINT) AS block, count(*) AS buckets FROM b GROUP BY ALL")
def B5_by_block(spark, d):
    return B.by_block(B.bucketize(M.points(spark, d), 10)).groupBy("run_id", "key", "block").agg(F.count(F.lit(1)).alias("buckets"))


#: Level of a span by counting: the levels whose blocks are too narrow.
LEVEL = "CASE WHEN {0} > 0 THEN CAST(greatest(-20, least(62, -20 + len(list_filter(range(-20, 62), lambda k: pow(2, k) * 256 < {0})))) AS INT) ELSE 0 END"
SPANS = f"""s0 AS (SELECT run_id, key, min(step) AS lo, max(step) AS hi FROM p WHERE NOT isnan(value) GROUP BY ALL), s1 AS (SELECT *, {LEVEL.format('(hi - lo)')} AS top FROM s0),
d AS (SELECT DISTINCT run_id, key, step FROM p), g AS (SELECT run_id, key, step - lag(step) OVER (PARTITION BY run_id, key ORDER BY step) AS gap FROM d), e AS (SELECT run_id, key, CAST(greatest(-20, floor(log2(median(gap)))) AS INT) AS fine FROM g WHERE gap IS NOT NULL GROUP BY ALL),
s AS (SELECT run_id, key, least(coalesce(fine, top), top) AS fine, top, lo, hi FROM s1 LEFT JOIN e USING (run_id, key))"""


@query(f"WITH {M.POINTS}, {SPANS} SELECT run_id, key, fine, top, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s")
def B6_spans(spark, d):
    return B.spans(M.points(spark, d)).withColumns({"lo": rounded("lo", 6), "hi": rounded("hi", 6)})


PYRAMID = f"{M.POINTS}, {SPANS}, q AS (SELECT p.*, unnest(range(fine, top + 1)) AS lv FROM p JOIN s USING (run_id, key)), b AS ({bucket_sql('lv', 'q')})"


@query(f"WITH {PYRAMID} SELECT {BUCKET_OUT} FROM b")
def B6_pyramid(spark, d):
    return buckets_out(B.build_pyramid(M.points(spark, d)))


@query(f"WITH {PYRAMID} SELECT {BUCKET_OUT} FROM b")
def B7_grow(spark, d):
    p = M.points(spark, d)
    known = B.spans(p)
    early = p.where("seq % 3 <> 0")
    part = B.spans(early).drop("fine").join(known.select("run_id", "key", "fine"), ["run_id", "key"]).withColumn("fine", F.col("fine"))
    # The first part's levels begin where the whole's do, so that both pyramids have the same ones.
    part = part.withColumn("top", F.greatest("top", "fine")).select("run_id", "key", "fine", "top", "lo", "hi")
    late = p.where("seq % 3 = 0")
    fixed = lambda more: B.grow(B.build_pyramid(early, part), part, more)[0]
    whole = fixed(late).join(known.select("run_id", "key", F.col("fine").alias("_f"), F.col("top").alias("_t")), ["run_id", "key"]).where("level BETWEEN _f AND _t")
    return buckets_out(whole)


READ = "r AS (SELECT s.*, k.level AS lv, k.block AS bk FROM s JOIN (VALUES ('click', 15, 0), ('view', 9, 1), ('purchase', 22, 0)) k(key, level, block) USING (key))"


@query(f"WITH {PYRAMID}, {READ}, h AS (SELECT b.*, lv, bk, CASE WHEN lv >= b.level THEN bucket >> (lv - b.level) ELSE CAST(floor(CASE WHEN f > 0 THEN ss / f ELSE si / (a + b) END / pow(2, lv)) AS BIGINT) END AS nb FROM b JOIN r ON b.run_id = r.run_id AND b.key = r.key AND b.level = greatest(least(lv, top), fine)) SELECT run_id, key, CAST(lv AS INT) AS level, CAST(bk AS BIGINT) AS block, nb AS bucket, CASE WHEN sum(f) > 0 THEN sum(f) ELSE sum(a) + sum(b) END::BIGINT AS n FROM h WHERE floor(nb / 256) = bk GROUP BY run_id, key, lv, bk, nb")
def B9_read_blocks(spark, d):
    p = M.points(spark, d)
    known = B.spans(p)
    asks = spark.sql("SELECT * FROM VALUES ('click', 15, 0L), ('view', 9, 1L), ('purchase', 22, 0L) AS k(key, level, block)")
    return B.finished(B.read_blocks(B.build_pyramid(p, known), known, asks)).select("run_id", "key", F.col("level").cast("int").alias("level"), "block", "bucket", "n")


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('22')}) SELECT {BUCKET_OUT} FROM b")
def B11_at_level(spark, d):
    p = M.points(spark, d)
    return buckets_out(B.at_level(B.bucketize(p, F.col("run_id").cast("int") % 5 + 10), 22))


@query(f"WITH {PYRAMID} SELECT run_id, key, CAST(level AS INT) AS level, count(*) AS buckets FROM b JOIN s USING (run_id, key) WHERE level >= top - 2 GROUP BY ALL")
def B13_keep_top_levels(spark, d):
    p = M.points(spark, d)
    known = B.spans(p)
    return B.keep_top_levels(B.build_pyramid(p, known), known).groupBy("run_id", "key", "level").agg(F.count(F.lit(1)).alias("buckets"))


@query(f"WITH {M.POINTS}, c AS ({bucket_sql('16')}), b AS ({bucket_sql('10')}), k AS (SELECT *, CASE WHEN f > 0 THEN ss / f ELSE si / (a + b) END AS ms FROM c), u AS (SELECT * EXCLUDE ms FROM k WHERE floor(ms / (1024 * 256)) NOT IN (2, 3) UNION ALL SELECT * FROM b WHERE floor(bucket / 256) IN (2, 3)) SELECT {BUCKET_OUT} FROM u")
def J11_overlay(spark, d):
    p = M.points(spark, d)
    fine = B.by_block(B.bucketize(p, 10)).where("block IN (2, 3)").drop("block")
    asked = spark.sql("SELECT * FROM VALUES (10, 2L), (10, 3L) AS k(level, block)")
    return buckets_out(B.overlay(B.bucketize(p, 16).unionByName(fine), asked))


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT {BUCKET_OUT} FROM b")
def J12_with_tail(spark, d):
    p = M.points(spark, d)
    half = p.groupBy("run_id", "key").agg(F.percentile("seq", F.lit(0.5)).cast("long").alias("held_seq"), F.lit(14).alias("level"))
    first = p.join(half.select("run_id", "key", "held_seq"), ["run_id", "key"]).where("seq < held_seq").drop("held_seq")
    return buckets_out(B.with_tail(B.bucketize(first, 14), p, half))


@query(f"WITH {M.POINTS}, {SPANS}, c AS (SELECT key, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY key) SELECT key, {LEVEL.format('(hi - lo)')} AS level FROM c")
def P12_level_for(spark, d):
    return B.spans(M.points(spark, d)).groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("key", V.level_for(F.col("hi") - F.col("lo")).alias("level"))


@query(f"WITH {M.POINTS} SELECT run_id, key, pow(2, round_even(log2((max(step) - min(step)) / 1000), 0)) AS scale FROM p GROUP BY run_id, key HAVING max(step) > min(step)")
def P13_smooth_scale(spark, d):
    return M.points(spark, d).groupBy("run_id", "key").agg(F.max("step").alias("b"), F.min("step").alias("a")).where("b > a").select("run_id", "key", V.smooth_scale(F.col("b") - F.col("a")).alias("scale"))


# ---- fields and predicates ----

PREDICATES = {
    "F1_eq_text": (lambda: Q.eq(V.field("segment"), "BUILDING"), "segment = 'BUILDING'"),
    "F1_eq_number": (lambda: Q.eq(V.field("c.nation"), "7.0"), "nation = 7"),
    "F1_eq_infinity": (lambda: Q.eq(V.field("s.acctbal"), "inf"), "acctbal = 'inf'::DOUBLE"),
    "F1_eq_nan": (lambda: Q.eq(V.field("acctbal"), "nan"), "false"),
    "F2_ne": (lambda: Q.ne(V.field("lr"), 3), "lr IS DISTINCT FROM 3"),
    "F3_gt": (lambda: Q.gt(V.field("acctbal"), 5000), "acctbal > 5000 AND NOT isnan(acctbal)"),
    "F3_le": (lambda: Q.le(V.field("acctbal"), 100.5), "acctbal <= 100.5"),
    "F3_text": (lambda: Q.lt(V.field("segment"), "FURNITURE"), "segment < 'FURNITURE'"),
    "F4_isin": (lambda: Q.isin(V.field("lr"), 0, "6", 9), "coalesce(lr IN (0, 6, 9), false)"),
    "F4_not_in": (lambda: ~Q.isin(V.field("lr"), 0, 6), "coalesce(lr NOT IN (0, 6), true)"),
    "F5_like": (lambda: Q.like(V.field("segment"), "%b_ild%"), "segment ILIKE '%b_ild%'"),
    "F6_matches": (lambda: Q.matches(V.field("name"), "#0+1[0-3]"), "regexp_matches(name, '#0+1[0-3]', 'i')"),
    "F7_is_missing": (lambda: Q.is_missing(V.field("lr")), "lr IS NULL"),
    "F8_list": (lambda: Q.eq(V.field("tags"), "v3"), "id % 5 = 3"),
    "F8_not_list": (lambda: Q.ne(V.field("tags"), "v3"), "id % 5 <> 3"),
    "F9_both": (lambda: ~(Q.gt(V.field("acctbal"), 0) & Q.eq(V.field("state"), "running")), "NOT (coalesce(acctbal > 0 AND NOT isnan(acctbal), false) AND state = 'running')"),
    "F10_search": (lambda: Q.search("asia/nation_1"), "run_id ILIKE '%asia/nation_1%'"),
    "F10_literal": (lambda: Q.search("customer#[0"), "false"),
    "F13_scope": (lambda: V.in_scope("path", "EUROPE"), "r_name = 'EUROPE'"),
    "F14_which": (lambda: Q.which("finished"), "state <> 'running'"),
    "F16_focus": (lambda: Q.focus((V.field("segment"), "MACHINERY"), (V.field("lr"), "∅")), "segment = 'MACHINERY' AND lr IS NULL"),
}
for name_, (test_, sql_) in PREDICATES.items():
    query(f"WITH {M.RUNS} SELECT id FROM r WHERE {sql_}", name_)(lambda s, d, t=test_: Q.filter_runs(M.runs(s, d), t()).select("id"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 90")
def F3_variant(spark, d):
    return M.table(spark, d, "events").where(Q.ge(V.value(F.get(F.array(F.try_variant_get(F.parse_json("props"), "$.k", "variant")), F.lit(0))), 90)).select("event_id")


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE event_type IN ('click') OR regexp_matches(event_type, '^p')")
def F12_keys_matching(spark, d):
    return M.table(spark, d, "events").where(Q.keys_matching(F.col("event_type"), ["click"], "^p")).select("event_id", rounded("value", 6).alias("value"))


@query(f"WITH {M.POINTS} SELECT run_id, seq FROM p WHERE step BETWEEN 1000 AND 300000")
def F15_between_x(spark, d):
    return M.points(spark, d).where(Q.between_x(F.col("step"), 1000, 300000)).select("run_id", "seq")


@query(f"WITH {M.RUNS} SELECT id, segment, CAST(nation AS DOUBLE) AS nation, CAST(lr AS DOUBLE) AS lr, n_name AS sha, 1.0::DOUBLE AS ab FROM r")
def P1_fields(spark, d):
    n, t = V.as_number, V.text_of
    return M.runs(spark, d).select("id", t(V.field("segment")).alias("segment"), n(V.field("config.nation")).alias("nation"), n(V.field("lr")).alias("lr"), t(V.field("info.git.sha")).alias("sha"), n(V.field("info.a.b")).alias("ab"))


@query("SELECT p_partkey, TRY_CAST(regexp_extract(p_name || p_size, '[0-9]+') AS DOUBLE) AS a, CASE WHEN p_size % 3 = 0 THEN 'inf'::DOUBLE = 'inf'::DOUBLE END AS b, NULL::DOUBLE AS c FROM part")
def P2_as_number(spark, d):
    size = F.col("p_size").cast("string")
    odd = F.when(F.col("p_size") % 3 == 0, "inf").otherwise("Infinity")
    return M.table(spark, d, "part").select("p_partkey", V.number_of_text(F.concat(F.lit(" +"), size, F.lit(".0e0 "))).alias("a"), (V.number_of_text(odd) == float("inf")).alias("b"), V.number_of_text(F.concat(size, F.lit("d"))).alias("c"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price FROM part")
def P3_text_of(spark, d):
    return M.table(spark, d, "part").select("p_partkey", V.text_of_number("p_size").alias("size"), V.text_of_number("p_retailprice").alias("price"))


@query(f"WITH {M.RUNS} SELECT id, r_name || '/' || n_name AS parent, r_name AS up2, '' AS up3, CASE WHEN r_name = 'ASIA' THEN n_name || '/' || name ELSE run_id END AS rel, name AS leaf FROM r")
def P6_paths(spark, d):
    return M.runs(spark, d).select("id", V.parent("path").alias("parent"), V.ancestor("path", 2).alias("up2"), V.ancestor("path", 5).alias("up3"), V.relative("path", "ASIA").alias("rel"), V.leaf("path").alias("leaf"))


@query(f"WITH {M.RUNS} SELECT run_id, unnest(['segment', 'nation', 'opt.name']) AS key, unnest(['\"' || segment || '\"', CAST(nation AS VARCHAR), '\"adam\"']) AS json FROM r UNION ALL SELECT run_id, 'lr', CAST(lr AS VARCHAR) FROM r WHERE lr IS NOT NULL")
def P7_flatten(spark, d):
    return configs(M.runs(spark, d))


@query(f"WITH {M.RUNS} SELECT run_id, name AS label FROM r")
def P9_run_labels(spark, d):
    return R.run_labels(M.runs(spark, d)).select("run_id", "label")


@query("SELECT page_id, row_number() OVER (ORDER BY page_id) AS place FROM pages")
def P10_natural_order(spark, d):
    named = M.table(spark, d, "pages").select("page_id", F.concat(F.lit("Page"), F.col("page_id")).alias("name"))
    return R.placed_runs(named, V.natural_key("name").asc()).select("page_id", "place")


@query(f"WITH {M.POINTS} SELECT seq, CASE WHEN value > 0 AND isfinite(value) THEN round(log10(value), 6) END AS x FROM p")
def P11_log_x(spark, d):
    return M.points(spark, d).select("seq", F.when(V.finite("value"), rounded(V.log_x("value"), 6)).alias("x"))


@query(f"WITH {M.MEDIA} SELECT DISTINCT key, 'page' AS section FROM m")
def P14_sections(spark, d):
    return M.media(spark, d).select("key", V.section_of("key").alias("section")).distinct()


# ---- sorting, lists, joins ----


@query(f"WITH {M.RUNS} SELECT id, row_number() OVER (ORDER BY isnan(acctbal), acctbal DESC, run_id) AS place FROM r QUALIFY place <= 50")
def O1_sort_runs(spark, d):
    top = R.list_runs(M.runs(spark, d), sort="-acctbal", limit=50, columns=["id", "run_id", "summary"])
    from pyspark.sql import Window

    order = R.sort_columns("acctbal:desc", lambda f: V.value(F.col("summary")[f]))
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order, "run_id")).cast("long")).select("id", "place")


@query(f"WITH {M.RUNS} SELECT id FROM r ORDER BY name LIMIT 25")
def O2_sort_ui(spark, d):
    return R.sort_runs_ui(M.runs(spark, d), "name").limit(25).select("id")


@query(f"WITH {M.RUNS} SELECT id, row_number() OVER (ORDER BY isnan(acctbal), acctbal DESC, run_id) AS place FROM r")
def O1_sort_all_runs(spark, d):
    """O1 over every run: infinities, numbers, NaN last."""
    named, order = R.with_sort_columns(M.runs(spark, d).select("id", "run_id", "summary"), "acctbal:desc", lambda f: V.value(F.col("summary")[f]))
    return R.placed_runs(named.drop("summary"), *order, F.col("run_id").asc()).select("id", "place")


@query(f"WITH {M.RUNS} SELECT id, row_number() OVER (ORDER BY name, created DESC, run_id) AS place FROM r")
def O2_sort_ui_all(spark, d):
    """O2 over every run."""
    return R.placed_runs(M.runs(spark, d).select("id", "run_id", "name", "created"), *R.sort_columns_ui("name")).select("id", "place")


@query(f"WITH {M.POINTS} SELECT key, seq, rn FROM (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM p) WHERE rn <= 3")
def O4_smallest(spark, d):
    return R.smallest(M.points(spark, d), ["key"], "seq", 3).select("key", "seq", F.col("rn").cast("long").alias("rn"))


@query(f"WITH {M.MEDIA} SELECT run_id, key, max(ord) AS seq FROM m GROUP BY run_id, key")
def O5_latest_media(spark, d):
    return R.latest_media(M.media(spark, d).withColumnRenamed("order", "seq")).select("run_id", "key", "seq")


@query(f"WITH {M.MEDIA} SELECT run_id, key, coalesce(max(ord) FILTER (WHERE step <= 40), min(ord)) AS seq FROM m GROUP BY run_id, key")
def J8_media_at(spark, d):
    return R.media_at(M.media(spark, d).withColumnRenamed("order", "seq"), 40.0).select("run_id", "key", "seq")


@query(f"WITH {M.POINTS}, {M.MEDIA} SELECT q.run_id, count(m.run_id) AS media FROM (SELECT DISTINCT run_id FROM p) q LEFT JOIN m USING (run_id) GROUP BY q.run_id")
def J2_media_counts(spark, d):
    return R.with_media_counts(event_runs(M.points(spark, d)), M.media(spark, d)).select("run_id", "media")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE event_type = 'purchase'")
def J3_runs_logging(spark, d):
    p = M.points(spark, d)
    return R.runs_logging(event_runs(p), p, "purchase").select("run_id")


SNAPSHOT = f"WITH {M.RUNS}, h AS (SELECT run_id, id % 11 AS uid, id % 7 AS rows, 0 AS media FROM r WHERE id % 10 <> 0), l AS (SELECT run_id, CASE WHEN id % 17 = 0 THEN -1 ELSE id % 11 END AS uid, id % 7 + id % 3 - 1 AS rows, 0 AS media FROM r WHERE id % 9 <> 0)"
CHANGES = "c AS (SELECT coalesce(h.run_id, l.run_id) AS run_id, CASE WHEN h.run_id IS NULL THEN 'new' WHEN l.run_id IS NULL THEN 'gone' WHEN h.uid <> l.uid OR l.rows < h.rows THEN 'rewritten' WHEN l.rows <> h.rows THEN 'changed' ELSE 'unchanged' END AS change FROM h FULL JOIN l ON h.run_id = l.run_id)"


def snapshots(spark, d):
    r = M.runs(spark, d).select("run_id", "id")
    held = r.where("id % 10 <> 0").select("run_id", F.expr("id % 11").alias("uid"), F.expr("id % 7").alias("rows"), F.lit(0).alias("media"))
    listed = r.where("id % 9 <> 0").select("run_id", F.expr("CASE WHEN id % 17 = 0 THEN -1 ELSE id % 11 END").alias("uid"), F.expr("id % 7 + id % 3 - 1").alias("rows"), F.lit(0).alias("media"))
    return held, listed


@query(f"{SNAPSHOT}, {CHANGES} SELECT run_id, change FROM c")
def J4_diff_snapshots(spark, d):
    return R.diff_snapshots(*snapshots(spark, d))


@query(f"WITH {PYRAMID}, k AS (SELECT DISTINCT run_id, key, level, CAST(floor(bucket / 256) AS BIGINT) AS block FROM b) SELECT run_id, key, CAST(level AS INT) AS level, block FROM k WHERE CAST(run_id AS INT) % 3 = 0 OR level % 2 = 0")
def J5_lacking(spark, d):
    asked = B.by_block(B.build_pyramid(M.points(spark, d))).select("run_id", "key", "level", "block").distinct().withColumn("compiled", F.lit(10))
    held = asked.where("CAST(run_id AS INT) % 3 <> 0").withColumn("seq", F.when(F.col("level") % 2 == 0, 9).otherwise(10))
    return R.lacking(asked, held)


@query(f"WITH {M.RUNS}, x AS (SELECT min(run_id) AS a, max(run_id) AS b FROM r), f AS (SELECT run_id, unnest(['segment', 'nation', 'opt.name', 'lr']) AS key, unnest(['\"' || segment || '\"', CAST(nation AS VARCHAR), '\"adam\"', CAST(lr AS VARCHAR)]) AS json FROM r, x WHERE run_id IN (a, b)), g AS (SELECT key, max(json) FILTER (WHERE run_id = a) AS a, max(json) FILTER (WHERE run_id = b) AS b FROM f, x GROUP BY key) SELECT key, a, b FROM g WHERE coalesce(a, 'null') <> coalesce(b, 'null')")
def J13_diff_fields(spark, d):
    r = M.runs(spark, d)
    a, b = r.agg(F.min("run_id"), F.max("run_id")).first()
    return R.diff_fields(configs(r), [a, b]).select("key", F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))


def folders(spark, d):
    r = M.table(spark, d, "region").select(F.col("r_name").alias("path"), F.when(F.col("r_regionkey") % 2 == 0, "segment").alias("group_by"))
    return r.unionByName(M.runs(spark, d).where("parent LIKE 'A%'").select(F.col("parent").alias("path"), F.lit("run~2").alias("group_by")).distinct())


@query(f"WITH {M.RUNS} SELECT run_id, CAST(1 AS INT) AS depth, r_name AS path FROM r UNION ALL SELECT run_id, 2, r_name || '/' || n_name FROM r WHERE r_name LIKE 'A%'")
def J14_notes_for(spark, d):
    return R.notes_for(M.runs(spark, d), folders(spark, d)).select("run_id", "depth", "path")


@query(f"WITH {M.RUNS} SELECT run_id, CASE WHEN r.r_name LIKE 'A%' THEN 'run~2' WHEN r_regionkey % 2 = 0 THEN 'segment' ELSE 'run~1' END AS group_by FROM r JOIN region ON r.r_name = region.r_name")
def J15_default_group(spark, d):
    return R.default_group(M.runs(spark, d), folders(spark, d))


@query(f"WITH {M.RUNS} SELECT id, CASE WHEN state = 'running' AND 600 - heartbeat > 300 THEN 'crashed' ELSE state END AS state FROM r")
def R2_liveness(spark, d):
    return M.runs(spark, d).select("id", R.effective_state("state", "heartbeat", 600.0).alias("state"))


@query(f"WITH {M.RUNS} SELECT run_id AS path, state, step FROM r WHERE segment = 'HOUSEHOLD' AND state <> 'failed' ORDER BY step DESC, run_id LIMIT 20")
def R4_list(spark, d):
    return R.list_runs(M.runs(spark, d), Q.eq(V.field("segment"), "HOUSEHOLD"), Q.ne(V.field("state"), "failed"), sort="step:desc", limit=20, columns=["path", "state", "step"])


@query(f"{SNAPSHOT} SELECT coalesce(h.run_id, l.run_id) AS run_id, coalesce(h.uid, 0) + CASE WHEN l.run_id IS NULL THEN 0 ELSE 1 END AS version FROM h FULL JOIN l ON h.run_id = l.run_id")
def R8_versions(spark, d):
    held, listed = snapshots(spark, d)
    return R.bump_versions(held.select("run_id", F.col("uid").alias("version")), listed)


# ---- sets and workspaces ----

MEMBERS = f"WITH {M.RUNS}, a AS (SELECT name FROM r WHERE id % 2 = 0), b AS (SELECT name FROM r WHERE id % 3 = 0)"


def members(spark, d):
    r = M.runs(spark, d).select(F.col("name").alias("run_id"), "id")
    return [("a", r.where("id % 2 = 0").drop("id")), ("b", r.where("id % 3 = 0").drop("id"))]


@query(f"{MEMBERS} SELECT name AS run_id, 'a' AS dir, name AS path FROM a UNION ALL SELECT CASE WHEN name IN (SELECT name FROM a) THEN name || '<b>' ELSE name END, 'b', name FROM b")
def U1_merge_workspaces(spark, d):
    return R.merge_workspaces(members(spark, d)).select("run_id", "dir", "path")


@query("WITH n AS (SELECT n_name AS path, unnest(['k' || n_nationkey % 2, 'all']) AS key, 'note ' || n_nationkey AS value, n_nationkey AS id FROM nation), a AS (SELECT * FROM n WHERE id % 3 <> 0), b AS (SELECT path, key, 'b ' || value AS value FROM n WHERE id % 2 = 0 AND key = 'all') SELECT path, key, value FROM a WHERE (path, key) NOT IN (SELECT (path, key) FROM b) UNION ALL SELECT path, key, value FROM b")
def U1_merge_folders(spark, d):
    notes = M.table(spark, d, "nation").select(F.col("n_name").alias("path"), F.explode(F.array(F.concat(F.lit("k"), F.col("n_nationkey") % 2), F.lit("all"))).alias("key"), F.concat(F.lit("note "), "n_nationkey").alias("value"), F.col("n_nationkey").alias("id"))
    second = notes.where("id % 2 = 0 AND key = 'all'").withColumn("value", F.concat(F.lit("b "), "value"))
    return R.merge_folders([("a", notes.where("id % 3 <> 0").drop("id")), ("b", second.drop("id"))])


@query(f"{MEMBERS} SELECT 'a/' || name AS run_id, 'a' AS dir, name AS path FROM a UNION ALL SELECT 'b/' || name, 'b', name FROM b")
def U2_nest_workspaces(spark, d):
    return R.nest_workspaces(members(spark, d)).select("run_id", "dir", "path")


@query(f"{MEMBERS} SELECT 'a/' || name AS run_id, 'a' AS dir, name AS path FROM a UNION ALL SELECT 'b/' || name, 'b', name FROM b")
def U3_resolve(spark, d):
    return R.resolve(R.nest_workspaces(members(spark, d)).select("run_id"), ["a", "b"], nested=True)


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT {BUCKET_OUT} FROM b")
def U5_combine(spark, d):
    p = M.points(spark, d)
    return buckets_out(B.combine(B.bucketize(p.where("seq % 2 = 0"), 14), B.bucketize(p.where("seq % 2 = 1"), 14)))


@query(f"{MEMBERS} SELECT name AS run_id, 'a' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'b' FROM b WHERE name NOT IN (SELECT name FROM a)")
def U7_difference(spark, d):
    (_, a), (_, b) = members(spark, d)
    return R.assert_same(a, b)


# ---- sources ----


@query(f"WITH {M.LINES} SELECT run_id, seq, quantity FROM w WHERE seq >= 2 AND seq < 5")
def S1_read_rows(spark, d):
    rows = T.read_rows(M.line_rows(spark, d), ["quantity"], 2, 5)
    return rows.select("run_id", "seq", F.col("values.quantity").alias("quantity"))


@query(f"WITH {M.LINES} SELECT run_id, seq, step, value FROM l WHERE key = 'discount' AND seq >= 2 AND step <= 4")
def S2_points(spark, d):
    return T.points(M.line_rows(spark, d), ["discount"], start=2, step_hi=4.0).select("run_id", "seq", "step", "value")


@query(f"WITH {M.LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM w), b AS (SELECT run_id, min(seq) FILTER (WHERE rn <> seq) AS bad FROM g GROUP BY run_id) SELECT run_id, seq FROM w JOIN b USING (run_id) WHERE bad IS NULL OR seq < bad")
def S4_contiguous(spark, d):
    rows = M.lines(spark, d).where("key = 'quantity'").select("run_id", (F.col("seq") - 1).alias("seq"))
    return T.contiguous_rows(rows).select("run_id", (F.col("seq") + 1).alias("seq"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ord, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value AS v, CAST(event_id % 2 = 0 AS INT)::DOUBLE AS even FROM events")
def S5_ingest(spark, d):
    e = M.table(spark, d, "events")
    logs = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("order"), F.concat(F.lit('{"a": {"props": '), "props", F.lit(', "v": '), F.col("value").cast("string"), F.lit('}, "even": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit(', "text": "x", "none": null}')).alias("json"))
    return T.ingest_log(logs).select("run_id", F.col("order").alias("ord"), F.col("values")["a/props/k"].alias("k"), F.col("values")["a/v"].alias("v"), F.col("values")["even"].alias("even"))


@query("WITH o AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ord, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS DOUBLE) END AS step FROM events), i AS (SELECT *, count(step) OVER (PARTITION BY run_id ORDER BY ord) AS isl FROM o) SELECT run_id, ord, coalesce(max(step) OVER (PARTITION BY run_id, isl), -1) + row_number() OVER (PARTITION BY run_id, isl ORDER BY ord) - CASE WHEN isl > 0 THEN 1 ELSE 0 END AS step FROM i")
def S6_assign_steps(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("order"), F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("double")).alias("step"))
    return T.assign_steps(e).select("run_id", F.col("order").alias("ord"), "step")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY ALL")
def S8_merge_notes(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("order"))
    return T.merge_notes(e)


@query(f"WITH {M.RUNS} SELECT r_name || '/' || n_name AS run_id FROM r WHERE r_name = 'ASIA' UNION SELECT run_id FROM r WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def S9_discover(spark, d):
    r = M.runs(spark, d)
    marker = F.when(F.col("path").startswith("EUROPE"), F.concat(F.lit(".hidden/"), "path")).otherwise(F.col("path"))
    paths = r.select(F.concat(marker, F.lit("/run.parquet")).alias("path")).unionByName(r.where("path LIKE 'ASIA%'").select(F.concat("parent", F.lit("/run.parquet")).alias("path")))
    return T.discover(paths)


@query("WITH l AS (SELECT event_type AS \"table\", CAST(user_id AS VARCHAR) AS pk, arg_max(CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END, event_id) AS value FROM events GROUP BY ALL) SELECT \"table\", pk, CAST(value AS VARCHAR) AS value FROM l WHERE value >= 0")
def S12_replay_ops(spark, d):
    e = M.table(spark, d, "events")
    value = F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string"))
    ops = e.select(F.col("event_type").alias("table"), F.col("user_id").cast("string").alias("pk"), value.alias("value"), F.col("event_id").alias("offset"))
    return T.replay_ops(ops)


JOURNALS = "j AS (SELECT event_type AS log, event_id // 400 AS epoch, CAST(user_id AS VARCHAR) AS pk, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) END AS value, event_id AS o FROM events), n AS (SELECT log, max(epoch) AS epoch FROM j GROUP BY log), k AS (SELECT log, epoch, pk, arg_max(coalesce(value, ''), o) AS value FROM j JOIN n USING (log, epoch) GROUP BY log, epoch, pk)"


def journals(spark, d):
    """A log per event type that is begun anew, under another id, every 400 events."""
    k, value = F.col("event_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string"))
    epoch = F.floor(k / 400)
    return M.table(spark, d, "events").select(F.col("event_type").alias("log"), F.concat(F.lit("journal "), epoch).alias("journal"), epoch.alias("epoch"), F.lit("meta").alias("table"), F.col("user_id").cast("string").alias("pk"), value.alias("value"), k.alias("offset"))


@query(f"WITH {JOURNALS} SELECT log, 'journal ' || epoch AS journal, pk, value FROM k WHERE value <> ''")
def S12_journals(spark, d):
    return T.replay_journals(journals(spark, d)).select("log", "journal", "pk", "value")


@query(f"WITH {JOURNALS} SELECT log, 'journal ' || epoch AS journal, pk, value FROM k WHERE value <> ''")
def S12_journal_stream(spark, d):
    """The same records over three batches, in which older journals come late too."""
    from tideline.streaming import live

    ops, at = journals(spark, d), new_place(spark, "journals")
    store = live.JournalStore(spark, f"{at}/state", slots=4)
    start = lambda stream: stream.writeStream.foreachBatch(store.take).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    in_batches(spark, start, [ops.where(F.col("offset") % 3 == k) for k in range(3)])
    return store.at(store.version).select("log", "journal", "pk", "value")


@query("WITH b AS (SELECT event_type AS log, min(event_id) FILTER (WHERE event_id % 701 = 700) AS bad FROM events GROUP BY log) SELECT log, event_id AS \"offset\" FROM events JOIN b ON event_type = log WHERE bad IS NULL OR event_id < bad")
def S13_valid_prefix(spark, d):
    payload = F.col("props").cast("binary")
    e = M.table(spark, d, "events").select(F.col("event_type").alias("log"), F.col("event_id").alias("offset"), F.octet_length("props").alias("size"), (F.crc32(payload) + (F.col("event_id") % 701 == 700).cast("int")).alias("crc"), payload.alias("payload"))
    return T.valid_prefix(e).select("log", "offset")


@query(f"WITH {M.MEDIA} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS seq, key, sha256(html) || '.html' AS file, strlen(html) AS size FROM m")
def S14_catalog_media(spark, d):
    return T.catalog_media(M.media(spark, d))[0].select("run_id", F.col("seq").cast("long").alias("seq"), "key", "file", "size")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'svg' END AS kind FROM pages")
def S15_sniff(spark, d):
    heads = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "3C737667", "00"]
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % 6 + 1).cast("int")))
    return M.table(spark, d, "pages").select("page_id", T.sniff(F.concat(head, F.unhex(F.lit("0000")))).alias("kind"))


PAGE_HEADS = ["", " \n\t" * 200, '<?xml version="1.0"?><!--' + "x" * 300 + "--><svg>", "\n<svg>", "<p><svg>"]


@query("SELECT page_id, CAST(k AS INT) AS k, CASE WHEN k IN (2, 3) OR regexp_matches(html, '^\\s*<(svg|\\?xml)') AND k < 2 THEN 'svg' END AS kind FROM pages, range(5) r(k)")
def S15_sniff_pages(spark, d):
    """Each page's whole content as it is, after white space, after an SVG's beginnings, and after a tag with an inline <svg."""
    heads = F.posexplode(F.array(*map(F.lit, PAGE_HEADS))).alias("k", "head")
    pages = M.table(spark, d, "pages").select("page_id", "html", heads)
    return pages.select("page_id", "k", T.sniff(F.concat("head", "html").cast("binary")).alias("kind"))


@query(f"WITH {M.MEDIA}, c AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS seq, ord, html FROM m), f AS (SELECT DISTINCT html FROM m WHERE ord % 23 <> 0), x AS (SELECT run_id, min(seq) AS bad FROM c WHERE html NOT IN (SELECT html FROM f) GROUP BY run_id) SELECT run_id, seq FROM c LEFT JOIN x USING (run_id) WHERE bad IS NULL OR seq < bad")
def S16_visible_media(spark, d):
    m = M.media(spark, d)
    files = T.catalog_media(m.where("order % 23 <> 0"))[1]
    return T.visible_media(T.catalog_media(m)[0], files).select("run_id", F.col("seq").cast("long").alias("seq"))


@query(f"WITH {M.POINTS} SELECT key, run_id, seq, CASE WHEN isnan(value) THEN 'nan' WHEN value = 'inf'::DOUBLE THEN 'inf' WHEN value = '-inf'::DOUBLE THEN '-inf' ELSE 'finite' END AS value FROM p")
def S17_printable(spark, d):
    p = T.printable(M.points(spark, d), ["key", "run_id", "seq", "value"])
    return p.withColumn("value", F.when(F.col("value").isin("nan", "inf", "-inf"), F.col("value")).otherwise("finite"))


@query(f"WITH {PYRAMID}, k AS (SELECT DISTINCT b.run_id, b.key, level, CAST(floor(bucket / 256) AS BIGINT) AS block, CAST(b.run_id AS INT) AS n FROM b JOIN s USING (run_id, key) WHERE level >= top - 2) SELECT run_id, key, CAST(level AS INT) AS level, block, n % 4 < 2 AS replace FROM k WHERE n % 4 < 2 OR n % 9 > 5")
def S19_delta(spark, d):
    p = M.points(spark, d)
    known = B.spans(p)
    n = F.col("run_id").cast("int")
    blocks = B.by_block(B.build_pyramid(p, known)).join(known.select("run_id", "key", "top"), ["run_id", "key"]).select("run_id", "key", "level", "top", "block", (n % 9).alias("since")).distinct()
    r = p.select("run_id").distinct().withColumns({"uid": n, "rebuilt": F.lit(0)})
    held = r.where(n % 4 != 0).select("run_id", F.when(n % 4 == 1, -1).otherwise(n).alias("uid"), "rebuilt", F.lit(5).alias("compiled"))
    return T.delta_for(blocks, held, r).select("run_id", "key", "level", "block", "replace")


@query(f"WITH {PYRAMID}, {M.MEDIA}, runs_n AS (SELECT DISTINCT run_id, CAST(run_id AS INT) AS n FROM p), fg AS (SELECT *, n % 4 < 2 AS fresh, n % 4 < 2 OR n % 9 > 5 AS grown FROM runs_n), new_m AS (SELECT m.run_id, m.key, m.ord FROM m JOIN fg USING (run_id) WHERE fresh OR ord >= 30) SELECT 'record' AS kind, run_id, NULL AS key, NULL::BIGINT AS seq FROM fg WHERE grown OR run_id IN (SELECT run_id FROM new_m) UNION ALL SELECT 'media', run_id, key, ord FROM new_m UNION ALL SELECT 'span', s.run_id, s.key, NULL FROM s JOIN fg USING (run_id) WHERE grown UNION ALL SELECT 'block', run_id, key, block FROM (SELECT DISTINCT b.run_id, b.key, level, CAST(floor(bucket / 256) AS BIGINT) AS block FROM b JOIN s USING (run_id, key) WHERE level >= top - 2) JOIN fg USING (run_id) WHERE grown")
def S19_delta_tables(spark, d):
    """Record, media, spans and blocks that a replica lacks, as one list."""
    p = M.points(spark, d)
    known = B.spans(p)
    n = F.col("run_id").cast("int")
    blocks = B.by_block(B.build_pyramid(p, known)).join(known.select("run_id", "key", "top"), ["run_id", "key"]).select("run_id", "key", "level", "top", "block", (n % 9).alias("since")).distinct()
    r = p.select("run_id").distinct().withColumns({"uid": n, "rebuilt": F.lit(0), "compiled": n % 9})
    held = r.where(n % 4 != 0).select("run_id", F.when(n % 4 == 1, -1).otherwise(n).alias("uid"), "rebuilt", F.lit(5).alias("compiled"), F.lit(30).alias("media"))
    found = T.delta_tables(held, r, M.media(spark, d).withColumnRenamed("order", "seq"), known, blocks)
    none = lambda kind: F.lit(None).cast(kind)
    parts = [("record", "records", none("string"), none("long")), ("media", "media", F.col("key"), F.col("seq")), ("span", "spans", F.col("key"), none("long")), ("block", "blocks", F.col("key"), F.col("block"))]
    return functools.reduce(DataFrame.unionByName, (found[name].select(F.lit(kind).alias("kind"), "run_id", key.alias("key"), seq.cast("long").alias("seq")) for kind, name, key, seq in parts))


# ---- more of the pyramid, records, sinks ----


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('16')}), z AS (SELECT *, CASE WHEN f > 0 THEN ss / f ELSE si / (a + b) END AS ms FROM b) SELECT run_id, key, CAST(floor(ms / 4096) AS BIGINT) AS bucket, CASE WHEN f > 0 THEN f ELSE a + b END AS n FROM z")
def B4_refine(spark, d):
    return B.finished(B.refine(B.bucketize(M.points(spark, d), 16), 12)).select("run_id", "key", "bucket", "n")


@query(f"WITH {M.POINTS} SELECT run_id, seq, CAST(run_id AS INT) % 3 = 0 AS anew FROM p WHERE CAST(run_id AS INT) % 3 = 0 OR seq >= 5000")
def B8_compile_due(spark, d):
    p = M.points(spark, d)
    compiled = p.select("run_id").distinct().select("run_id", F.when(F.col("run_id").cast("int") % 3 == 0, 100).otherwise(5000).alias("compiled"))
    anew, grows = B.compile_due(p, compiled)
    return anew.withColumn("anew", F.lit(True)).unionByName(grows.withColumn("anew", F.lit(False))).select("run_id", "seq", "anew")


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT run_id, key, bucket, CASE WHEN f > 0 THEN f ELSE a + b END AS n FROM b WHERE CAST(run_id AS INT) % 2 = 0 UNION ALL SELECT run_id, key, bucket, CASE WHEN f > 0 THEN f ELSE a + b END FROM b WHERE CAST(run_id AS INT) % 2 = 1")
def U4_bucket_union(spark, d):
    p = M.points(spark, d)
    half = lambda k: B.bucketize(p.where(F.col("run_id").cast("int") % 2 == k), 14)
    return B.finished(half(0).unionByName(half(1))).select("run_id", "key", "bucket", "n")


#: The view's levels (l0 over all, f1 over the zoom), its blocks, and what is read of them before the finer cover the coarser.
VIEW = """w AS (SELECT *, greatest(1, least(800 / 4.0, 1.5e6 / n)) AS bk FROM (SELECT min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM s)),
v AS (SELECT *, CAST(greatest(-20, least(62, ceil(log2((hi - lo) / bk)))) AS INT) AS l0, list_min(list_filter(range(-20, 63), lambda f: f >= ceil(log2(250000 / bk)) AND floor(1250000 / (256 * pow(2, f))) - floor(1000000 / (256 * pow(2, f))) < 8)) AS f1 FROM w),
k AS (SELECT l0 AS lv, unnest(range(CAST(floor(lo / (256 * pow(2, l0))) AS BIGINT), CAST(floor(hi / (256 * pow(2, l0))) AS BIGINT) + 1)) AS bk FROM v UNION ALL SELECT f1, unnest(range(CAST(floor(1000000 / (256 * pow(2, f1))) AS BIGINT), CAST(floor(1250000 / (256 * pow(2, f1))) AS BIGINT) + 1)) FROM v WHERE f1 < l0),
h AS (SELECT b.*, lv, bk, CASE WHEN lv >= b.level THEN bucket >> (lv - b.level) ELSE CAST(floor(CASE WHEN f > 0 THEN ss / f ELSE si / (a + b) END / pow(2, lv)) AS BIGINT) END AS nb FROM b JOIN s USING (run_id, key) JOIN k ON b.level = greatest(least(lv, top), fine)),
r AS (SELECT run_id, key, lv AS level, nb AS bucket, sum(f) AS f, sum(a) AS a, sum(b) AS b, sum(sv) AS sv, sum(ss) AS ss, sum(si) AS si FROM h WHERE floor(nb / 256) = bk GROUP BY ALL),
o AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lv < r.level AND k.bk = floor(CASE WHEN f > 0 THEN ss / f ELSE si / (a + b) END / (256 * pow(2, k.lv)))))"""


@query(f"WITH {PYRAMID}, {VIEW} SELECT {BUCKET_OUT} FROM o")
def B12_view_buckets(spark, d):
    """Two layers of a chart 800 wide, 4 pixels a bucket, zoomed to a tenth: buckets of the whole span, finer ones inside."""
    p = M.points(spark, d)
    known = B.spans(p)
    return buckets_out(B.view_buckets(B.build_pyramid(p, known), known, 800, 4, (1.0e6, 1.25e6)))


@query(f"WITH {M.LINES} SELECT run_id, seq, key, value FROM l")
def S3_reshape(spark, d):
    return T.rows_to_points(M.line_rows(spark, d)).select("run_id", "seq", "key", "value")


@query(f"WITH {M.RUNS} SELECT run_id, created, CASE WHEN id % 2 = 0 THEN 'again' ELSE name END AS name, CASE WHEN id % 2 = 0 AND id % 4 = 0 THEN 'new' WHEN id % 5 = 1 THEN CASE WHEN id % 2 = 0 THEN '' END WHEN id % 5 = 0 THEN '' ELSE 'v' || id % 5 || ',' || segment END AS tags, n_name AS a, CASE WHEN id % 2 = 0 THEN 'x' END AS b FROM r")
def S7_upsert(spark, d):
    r = M.runs(spark, d)
    base = r.select("run_id", "created", "name", "state", "heartbeat", "tags", F.create_map(F.lit("k"), F.lit("old")).alias("config"), F.create_map(F.lit("a"), V.leaf("parent")).alias("info"))
    new = r.where("id % 2 = 0").select("run_id", (F.col("created") + 1).alias("created"), F.lit("again").alias("name"), F.lit("running").alias("state"), F.lit(9.0).alias("heartbeat"), F.when(F.col("id") % 4 == 0, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit(None).cast("map<string,string>").alias("config"), F.create_map(F.lit("b"), F.lit("x")).alias("info"))
    out = T.upsert_runs(base, new)
    return out.select("run_id", "created", "name", F.array_join("tags", ",").alias("tags"), F.col("info")["a"].alias("a"), F.col("info")["b"].alias("b"))


@query(f"WITH {M.LINES}, g AS (SELECT run_id, max(seq) AS n, count(*) AS c FROM w GROUP BY run_id) SELECT run_id, seq - 1 AS seq, quantity FROM w JOIN g USING (run_id) WHERE n = c")
def S18_compact(spark, d):
    from tideline.plans.shared import shared_dir

    import uuid

    rows = M.line_rows(spark, d).withColumn("seq", F.col("seq") - 1)
    whole = rows.groupBy("run_id").agg(F.max("seq").alias("_n"), F.count(F.lit(1)).alias("_c")).where("_n = _c - 1")
    fine = rows.join(whole.select("run_id"), "run_id", "left_semi")
    out = T.compact(fine, f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}")
    return out.select("run_id", "seq", F.col("values.quantity").alias("quantity"))


@query(f"WITH {PYRAMID} SELECT DISTINCT run_id, key, CAST(level AS INT) AS level, CAST(floor(bucket / 256) AS BIGINT) AS block, CAST(9 AS INT) AS since FROM b JOIN s USING (run_id, key) WHERE level >= top - 2")
def S20_apply_delta(spark, d):
    p = M.points(spark, d)
    known = B.spans(p)
    blocks = B.by_block(B.build_pyramid(p, known)).join(known.select("run_id", "key", "top"), ["run_id", "key"]).select("run_id", "key", "level", "top", "block", F.lit(9).alias("since")).distinct()
    n = F.col("run_id").cast("int")
    replica = blocks.where(n % 2 == 0).withColumn("since", F.lit(1))
    delta = blocks.where("level >= top - 2").withColumn("replace", n % 3 == 0)
    return T.apply_delta(replica, delta).select("run_id", "key", "level", "block", "since")


@query(f"WITH {M.RUNS}, {M.MEDIA} SELECT r.run_id, r_name || '/' || n_name AS parent, step, CASE WHEN acctbal = 'inf'::DOUBLE OR isnan(acctbal) THEN NULL ELSE acctbal END AS acctbal, CASE WHEN id < 7 THEN (SELECT count(*) FROM m WHERE m.run_id = CAST(id AS VARCHAR)) ELSE 0 END AS media FROM r")
def R1_run_records(spark, d):
    r = M.runs(spark, d)
    ids = r.select("run_id", F.col("id").cast("string").alias("_id"))
    media = M.media(spark, d).withColumnRenamed("run_id", "_id").join(ids, "_id").drop("_id")
    summary = r.select("run_id", F.col("step").alias("_step"), F.col("heartbeat").alias("_runtime"), "summary")
    out = R.run_records(r.drop("step"), summary, media)
    return out.select("run_id", "parent", "step", F.when(V.finite(V.as_number(V.field("acctbal"))), V.as_number(V.field("acctbal"))).alias("acctbal"), "media")


@query(f"WITH {M.MEDIA} SELECT run_id, key, ord AS seq FROM m WHERE key IN ('page/1', 'page/2')")
def R6_media_report(spark, d):
    return R.media_report(M.media(spark, d).withColumnRenamed("order", "seq"), "[12]$", "html").select("run_id", "key", "seq")


@query(f"WITH {M.MEDIA}, q AS (SELECT * FROM m WHERE run_id IN ('0', '1', '2')) SELECT run_id, key, coalesce(max(ord) FILTER (WHERE step <= 60), min(ord)) AS seq FROM q GROUP BY run_id, key")
def O6_media_panel(spark, d):
    m = M.media(spark, d).withColumnRenamed("order", "seq")
    return R.media_panel(m, m.select("run_id").distinct(), 60.0, most=3).select("run_id", "key", "seq")


@query(f"WITH {M.RUNS}, w AS (SELECT DISTINCT r_name AS path FROM r UNION SELECT r_name || '/' || n_name FROM r WHERE r_name LIKE 'A%') SELECT path FROM w WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def S10_folder_notes(spark, d):
    docs = folders(spark, d).select("path", F.when(F.col("path").startswith("ASIA"), F.lit('{"question": 1}')).otherwise("{broken").alias("text"))
    return R.related_folders(T.parse_notes(docs), "ASIA").select("path")


@query(f"""WITH {M.POINTS}, {M.MEDIA}, q AS (SELECT DISTINCT run_id, CAST(run_id AS INT) % 7 AS team FROM p), l AS (SELECT run_id, max(seq) + 1 AS rows, arg_max(step, seq) AS step, arg_max(t, seq) AS t FROM p GROUP BY run_id)
SELECT run_id, 'run' AS section, 'run ' || run_id AS name, rows AS n, NULL::DOUBLE AS first_step, round(step, 6) AS last_step, round(t, 6) AS value, NULL AS value_mark, CASE team % 2 WHEN 0 THEN 'finished' ELSE 'running' END AS text FROM q JOIN l USING (run_id)
UNION ALL SELECT run_id, 'key', key, count(*), round(arg_min(step, seq), 6), round(arg_max(step, seq), 6), {mark('value', 'arg_max(value, seq)').replace(' AS value,', ',').replace(' AS value_mark', '')}, NULL FROM p GROUP BY run_id, key
UNION ALL SELECT run_id, 'media', key, ord, NULL, step, step, NULL, 'html' FROM m WHERE run_id IN (SELECT run_id FROM q)
UNION ALL SELECT run_id, 'notes', CAST(team AS VARCHAR), 1, NULL, NULL, NULL, NULL, '{{"team":' || team || '}}' FROM q WHERE team < 4""")
def R3_run_report(spark, d):
    """The report of every run."""
    p = M.points(spark, d)
    team = F.col("run_id").cast("int") % 7
    records = event_runs(p).withColumns({"name": F.concat(F.lit("run "), "run_id"), "state": F.when(team % 2 == 0, "finished").otherwise("running")})
    folders_ = spark.range(4).select(F.col("id").cast("string").alias("path"), F.parse_json(F.concat(F.lit('{"team": '), F.col("id").cast("string"), F.lit("}"))).alias("info"))
    out = R.run_report(records, p, p, M.media(spark, d).withColumnRenamed("order", "seq"), folders_)
    return shown(out.withColumns({c: rounded(c, 6) for c in ("first_step", "last_step")}), "run_id", "section", "name", "n", "first_step", "last_step", "text", value="value")


@query(f"WITH {M.RUNS} SELECT CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS dir, count(*) AS runs, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'crashed') AS crashed, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'finished') AS finished FROM r GROUP BY dir")
def R7_index_report(spark, d):
    r = M.runs(spark, d)
    return R.index_report(R.nest_workspaces([("a", r.where("id % 3 = 0")), ("b", r.where("id % 3 <> 0"))]), ("dir",))


@query(f"WITH {M.RUNS}, w AS (SELECT r_name || '/' || n_name AS path, max(id) FILTER (WHERE id % 2 = 0) AS even, max(id) FILTER (WHERE id % 2 = 1) AS odd FROM r GROUP BY path) SELECT path, CASE WHEN path LIKE 'A%' THEN '\"kept\"' END AS old, coalesce(CAST(even AS VARCHAR), CASE WHEN path LIKE 'A%' THEN '0' END) AS even, CAST(odd AS VARCHAR) AS odd FROM w")
def S11_merge_folder_notes(spark, d):
    """Every run writes its id to its folder's document, under `even` or `odd`."""
    r = M.runs(spark, d)
    base = r.where("parent LIKE 'A%'").select(F.col("parent").alias("path")).distinct().withColumn("info", F.parse_json(F.lit('{"old": "kept", "even": 0}')))
    writes = r.select(F.col("parent").alias("path"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("order"))
    at = lambda k: F.to_json(F.try_variant_get("info", f"$.{k}", "variant")).alias(k)
    return T.merge_folder_notes(base, writes).select("path", at("old"), at("even"), at("odd"))


# ---- streaming ----


def staged(spark: SparkSession, df: DataFrame) -> tuple[str, DataFrame]:
    """df written in the shared folder, a file a task, for a file stream to take up."""
    import uuid

    from tideline.plans.shared import shared_dir

    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df


def in_batches(spark: SparkSession, start: Callable[..., StreamingQuery], *members: list[DataFrame]) -> None:
    """Streams that take tables one after the other, a batch each: every member's next table is written, a file a task, and
    `start` runs the query of all streams on what is there. Its checkpoint is the same each time."""
    places = [new_place(spark, "batches") for _ in members]
    for tables in zip(*members, strict=True):
        for at, table in zip(places, tables, strict=True):
            table.write.mode("append").parquet(at)
        start(*(spark.readStream.schema(table.schema).parquet(at) for at, table in zip(places, tables, strict=True))).awaitTermination()


def new_place(spark: SparkSession, name: str) -> str:
    import uuid

    from tideline.plans.shared import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def appended(stream: DataFrame, at: str) -> StreamingQuery:
    """Starts a stream that adds what it gives for all that is there now to the table `at`/out."""
    return stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{at}/out").start()


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, from a table in the shared folder."""
    at = new_place(spark, "stream")
    if mode == "append":
        appended(stream, at).awaitTermination()
    else:
        out = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
        out.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT run_id, key, bucket, CASE WHEN f > 0 THEN f ELSE a + b END AS n FROM b WHERE CAST(run_id AS INT) % 3 <> 0")
def B16_cache_levels(spark, d):
    import uuid

    from tideline.plans.shared import shared_dir

    p = M.points(spark, d)
    n = F.col("run_id").cast("int")
    runs = p.select("run_id").distinct().withColumns({"state": F.when(n % 3 == 0, "running").otherwise("finished"), "rows": n, "version": F.lit(1)})
    path = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    buckets = B.bucketize(p, 14)
    T.cache_levels(buckets.where(n % 2 == 0), runs, path)
    kept = T.cache_levels(buckets, runs.withColumn("version", F.when(n % 5 == 0, 2).otherwise(1)), path)
    return B.finished(kept).select("run_id", "key", "bucket", "n")


@query("WITH o AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) SELECT run_id, seq FROM o WHERE seq < 49")
def T2_contiguous_stream(spark, d):
    from pyspark.sql import Window

    from tideline.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    p = M.points(spark, d, odd=False).withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")).cast("long") - 1)
    rows = p.select("run_id", "seq", "step", "value").where("seq % 50 <> 49")
    path, staged_rows = staged(spark, rows.unionByName(rows.where("seq % 3 = 0")))
    found = drained(spark, live.contiguous_stream(spark.readStream.schema(staged_rows.schema).parquet(path)))
    return found.where("NOT gap").select("run_id", "seq")


@query(f"WITH {M.POINTS} SELECT run_id, seq FROM p WHERE seq > 100")
def T1_tail_stream(spark, d):
    from tideline.streaming import live

    path, p = staged(spark, M.points(spark, d))
    return drained(spark, live.tail_stream(spark, path, p.schema, after=100)).select("run_id", "seq")


@query(f"WITH {PYRAMID} SELECT {BUCKET_OUT} FROM b")
def T3_stream_pyramid(spark, d):
    import uuid

    from tideline.plans.shared import shared_dir
    from tideline.streaming import live

    path, p = staged(spark, M.points(spark, d))
    at = f"{shared_dir(spark)}/pyramid-{uuid.uuid4().hex}"
    store = live.PyramidStore(spark, f"{at}/store")
    live.stream_pyramid(spark.readStream.schema(p.schema).parquet(path), store, f"{at}/checkpoint").awaitTermination()
    return buckets_out(store.at(store.version)[0])


#: A run's points come by event number in four batches. Its finest levels are those of all points up to the batch in which
#: it reaches 60 rows, or of its first batch with that key if that is later.
REBUILD = f"""{M.POINTS}, n AS (SELECT p.*, CAST(least(3, seq * 4 // (SELECT max(event_id) + 1 FROM events)) AS INT) AS b FROM p), t AS (SELECT run_id, b, sum(count(DISTINCT seq)) OVER (PARTITION BY run_id ORDER BY b) AS c FROM n GROUP BY run_id, b),
u AS (SELECT run_id, coalesce(min(b) FILTER (WHERE c >= 60), 3) AS last FROM t GROUP BY run_id), f AS (SELECT run_id, key, greatest(last, min(b)) AS last FROM n JOIN u USING (run_id) WHERE NOT isnan(value) GROUP BY run_id, key, last), young AS (SELECT n.* FROM n JOIN f USING (run_id, key) WHERE b <= last),
{SPANS.replace(' FROM p', ' FROM young').replace('s AS (', 's_young AS (')}, s AS (SELECT p.run_id, p.key, fine, greatest(any_value(top), {LEVEL.format('(max(step) - min(step))')}) AS top FROM p JOIN s_young USING (run_id, key) WHERE NOT isnan(value) GROUP BY p.run_id, p.key, fine),
q AS (SELECT p.*, unnest(range(fine, top + 1)) AS lv FROM p JOIN s USING (run_id, key)), b AS ({bucket_sql('lv', 'q')})"""


@query(f"WITH {REBUILD} SELECT {BUCKET_OUT} FROM b")
def T3_rebuild_rule(spark, d):
    """Runs are built anew until they have 60 rows and grow from then on, over four batches of a stream."""
    from tideline.streaming import live

    p, at = M.points(spark, d), new_place(spark, "pyramid")
    width = p.agg(F.max("seq") + 1).first()[0]
    batch = F.least(F.lit(3), F.floor(F.col("seq") * 4 / width))
    store = live.PyramidStore(spark, f"{at}/store", least=60, slots=8)
    in_batches(spark, lambda stream: live.stream_pyramid(stream, store, f"{at}/checkpoint"), [p.where(batch == k) for k in range(4)])
    return buckets_out(store.at(store.version)[0])


FEED = f"{SNAPSHOT}, {CHANGES}, e AS (SELECT c.run_id, change, CASE WHEN change IN ('new', 'rewritten') THEN coalesce(l.rows, 0) > 0 ELSE coalesce(l.rows, 0) > coalesce(h.rows, 0) END AS more FROM c LEFT JOIN h ON c.run_id = h.run_id LEFT JOIN l ON c.run_id = l.run_id WHERE change <> 'unchanged'), f AS (SELECT run_id, unnest(list_filter([CASE WHEN change IN ('rewritten', 'gone') THEN 'delete' END, CASE WHEN change IN ('new', 'rewritten') THEN 'run' END, CASE WHEN more THEN 'rows' END, CASE WHEN change = 'changed' THEN 'run' END], lambda x: x IS NOT NULL)) AS event FROM e)"


@query(f"{FEED} SELECT run_id, event FROM f")
def T6_change_feed(spark, d):
    """The feed's second batch: a stream that first got a listing of what is held, then one of what is there."""
    from tideline.streaming import live

    at, (held, listed) = new_place(spark, "feed"), snapshots(spark, d)
    for order, states in enumerate((held, listed)):
        states = states.withColumn("order", F.lit(order))
        states.write.mode("append").parquet(f"{at}/in")
        live.change_feed(spark.readStream.schema(states.schema).parquet(f"{at}/in"), f"{at}/feed", f"{at}/checkpoint", complete=True).awaitTermination()
    return spark.read.parquet(f"{at}/feed/events/v=1").select("run_id", "event")


@query(
    f"{FEED}, o AS (SELECT r_name || '/' || n_name AS run_id, CASE WHEN n_nationkey % 5 <> 0 THEN '{{\"v\":' || n_nationkey % 3 || '}}' END AS was, CASE WHEN n_nationkey % 4 <> 0 THEN '{{\"v\":' || n_nationkey % 2 || '}}' END AS now FROM nation JOIN region ON n_regionkey = r_regionkey) "
    "SELECT run_id, event, NULL AS info FROM f UNION ALL SELECT run_id, 'folder', now FROM o WHERE was IS DISTINCT FROM now"
)
def T6_feed_updates(spark, d):
    """Runs and folders in one feed of updates: what is gone comes as a row that says so."""
    from tideline.streaming import live

    at, (held, listed) = new_place(spark, "feed"), snapshots(spark, d)
    nations = M.table(spark, d, "nation").join(F.broadcast(M.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    note = lambda keep, of: nations.select(F.concat_ws("/", "r_name", "n_name").alias("run_id"), F.when(F.col("n_nationkey") % keep != 0, F.concat(F.lit('{"v":'), (F.col("n_nationkey") % of).cast("string"), F.lit("}"))).alias("info"), F.lit(True).alias("folder"))
    gone = held.join(listed.select("run_id"), "run_id", "left_anti").withColumn("gone", F.lit(True))
    first = held.unionByName(note(5, 3), allowMissingColumns=True).withColumn("gone", F.lit(None).cast("boolean"))
    then = listed.unionByName(gone, allowMissingColumns=True).unionByName(note(4, 2), allowMissingColumns=True)
    updates = [x.withColumn("order", F.lit(k)).select("run_id", "uid", "rows", "media", "gone", "folder", "info", "order") for k, x in enumerate((first, then))]
    in_batches(spark, lambda stream: live.change_feed(stream, f"{at}/feed", f"{at}/checkpoint"), updates)
    return spark.read.parquet(f"{at}/feed/events/v=1").select("run_id", "event", "info")


@query(f"{SNAPSHOT}, {CHANGES} SELECT c.run_id, change FROM c WHERE starts_with(c.run_id, 'ASIA/') AND change <> 'unchanged'")
def T7_subscribe(spark, d):
    from tideline.streaming import live

    path, changes = staged(spark, R.diff_snapshots(*snapshots(spark, d)).where("change <> 'unchanged'"))
    return drained(spark, live.subscribe(spark.readStream.schema(changes.schema).parquet(path), "ASIA"))


@query(f"WITH {M.POINTS} SELECT run_id, max(seq) + 1 AS rows FROM p GROUP BY run_id")
def T8_live_seqs(spark, d):
    from tideline.streaming import live

    path, p = staged(spark, M.points(spark, d))
    return drained(spark, live.live_seqs(spark.readStream.schema(p.schema).parquet(path)), "complete")


@query(f"{SNAPSHOT}, {CHANGES} SELECT run_id, CASE WHEN change = 'rewritten' THEN 1 ELSE 0 END AS value FROM c WHERE change IN ('rewritten', 'changed', 'unchanged')")
def T9_rewrites(spark, d):
    """A stream of two listings: what is held, with value 0, then what is there, with value 1."""
    from tideline.streaming import live

    at, (held, listed) = new_place(spark, "listed"), snapshots(spark, d)
    store = live.ListedPoints(spark, f"{at}/store", "value int")
    for value, states in enumerate((held, listed)):
        states = states.withColumn("value", F.lit(value))
        states.write.mode("append").parquet(f"{at}/in")
        live.follow_listings(spark.readStream.schema(states.schema).parquet(f"{at}/in"), store, f"{at}/checkpoint").awaitTermination()
    return store.at(1)


@query(f"WITH {M.POINTS}, b AS ({bucket_sql('14')}) SELECT {BUCKET_OUT} FROM b")
def T4_live_view(spark, d):
    """Buckets of each series' first half, and a stream of all points in three batches, of which the second half is taken."""
    from tideline.streaming import live

    p, at = M.points(spark, d), new_place(spark, "view")
    half = p.groupBy("run_id", "key").agg(((F.min("seq") + F.max("seq")) / 2).cast("long").alias("held_seq"), F.lit(14).alias("level"))
    compiled = B.bucketize(p.join(half.drop("level"), ["run_id", "key"]).where("seq < held_seq"), 14)
    view = live.LiveView(spark, f"{at}/view", lambda: compiled, lambda: half, slots=16)
    in_batches(spark, lambda stream: live.live_view(view, stream, f"{at}/checkpoint"), [p.where(F.col("seq") % 3 == k) for k in range(3)])
    return buckets_out(view.buckets(view.version))


@query("SELECT 'supplier ' || s_suppkey AS run_id, unnest(['running', 'crashed']) AS state FROM supplier")
def T5_liveness(spark, d):
    """Each run beats once; it is said to run, and to have crashed when no other beat comes for two seconds."""
    import time

    from tideline.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    at = new_place(spark, "beats")
    path, beats = staged(spark, M.table(spark, d, "supplier").select(F.concat(F.lit("supplier "), "s_suppkey").alias("run_id"), F.col("s_suppkey").cast("double").alias("at")))
    out = live.crash_stream(spark.readStream.schema(beats.schema).parquet(path), limit=2.0).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint")
    running = out.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{at}/out")).trigger(processingTime="1 second").start()
    said = lambda: spark.read.schema("run_id string, state string").parquet(f"{at}/out")
    runs, until = beats.count(), time.time() + 300
    while time.time() < until and (not running.lastProgress or said().where("state = 'crashed'").count() < runs) and running.isActive:
        time.sleep(1)
    running.stop()
    return said()


@query(f"WITH {M.POINTS} SELECT CASE WHEN seq % 2 = 0 THEN 'a/' ELSE 'b/' END || run_id AS run_id, seq FROM p")
def T10_merge_streams(spark, d):
    from tideline.streaming import live

    p = M.points(spark, d).select("run_id", "seq")
    streams = []
    for name, k in (("a", 0), ("b", 1)):
        path, part = staged(spark, p.where(F.col("seq") % 2 == k))
        streams.append((name, spark.readStream.schema(part.schema).parquet(path)))
    return drained(spark, live.merge_streams(streams)).select("run_id", "seq")


@query("WITH o AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) SELECT run_id, seq FROM o WHERE seq BETWEEN 17 AND CASE WHEN CAST(run_id AS INT) % 2 = 0 THEN 29 ELSE 1000000 END")
def T1_follow(spark, d):
    """The last three of the twenty rows that each run has at first, then what follows; every other run ends at row 30."""
    from pyspark.sql import Window

    from tideline.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    e = M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("seq"), F.col("props").alias("values"), F.lit(None).cast("long").alias("done"))
    e = written(e, "events")
    shown_now = written(live.tail(e.where("seq < 20"), 3), "shown")
    ended = e.select("run_id").distinct().where("CAST(run_id AS INT) % 2 = 0").select("run_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("values"), F.lit(30).cast("long").alias("done"))
    at = new_place(spark, "stream")
    in_batches(spark, lambda stream: appended(live.follow(stream, shown_now.select("run_id", "seq")), at), [e.where("seq < 25"), e.where("seq BETWEEN 25 AND 35").unionByName(ended), e.where("seq > 35")])
    return shown_now.select("run_id", "seq").unionByName(spark.read.parquet(f"{at}/out").select("run_id", "seq"))


@query("WITH s AS (SELECT 'supplier ' || s_suppkey AS run_id, s_suppkey % 7 AS rows, s_suppkey % 3 AS media, s_suppkey % 5 AS a, s_suppkey % 2 AS b FROM supplier) SELECT run_id, rows, media, least(rows, a) AS held_rows, least(media, b) AS held_media FROM s WHERE a < rows OR b < media")
def T8_losses(spark, d):
    """What each source has by its heartbeat, and what is held of it: runs that are short of it after two seconds."""
    import time

    from tideline.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    at, k = new_place(spark, "losses"), F.col("s_suppkey")
    said = M.table(spark, d, "supplier").select(F.concat(F.lit("supplier "), k).alias("run_id"), (k % 7).alias("rows"), (k % 3).alias("media"), (k % 5).alias("a"), (k % 2).alias("b"))
    beats, held = said.select("run_id", "rows", "media"), said.select("run_id", F.least("rows", "a").alias("rows"), F.least("media", "b").alias("media"))
    said, has = (spark.readStream.schema(df.schema).parquet(staged(spark, df)[0]) for df in (beats, held))
    out = live.find_losses(said, has, patience=2.0).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint")
    running = out.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{at}/out")).trigger(processingTime="1 second").start()
    found = lambda: spark.read.schema("run_id string, rows long, media long, held_rows long, held_media long").parquet(f"{at}/out")
    until = time.time() + 300
    while time.time() < until and running.isActive and (not running.lastProgress or not found().limit(1).count()):
        time.sleep(1)
    running.stop()  # timers of one batch end in one batch
    return found()


@query(
    f"WITH {M.RUNS}, m AS (SELECT name, id, unnest(['a', 'b', 'c']) AS dir FROM r), k AS (SELECT *, CASE dir WHEN 'a' THEN id % 2 = 0 WHEN 'b' THEN id % 3 = 0 ELSE id % 5 <> 0 END AS has, CASE dir WHEN 'a' THEN 1 ELSE 0 END AS came FROM m), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY came, dir) AS place FROM k WHERE has), b1 AS (SELECT CASE WHEN place = 1 THEN name ELSE name || '<' || dir || '>' END AS run_id, dir, name AS path, came AS at, FALSE AS gone FROM o), "
    "b2 AS (SELECT CASE WHEN place = 1 THEN name ELSE name || '<b>' END AS run_id, dir, name AS path, 2 AS at, TRUE AS gone FROM o WHERE dir = 'b' AND id % 4 <> 1), "
    "o3 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY came, dir) AS place FROM k WHERE has AND NOT (dir = 'b' AND id % 4 <> 1)), "
    "b3 AS (SELECT CASE WHEN place = 1 THEN name ELSE name || '<' || dir || '>' END AS run_id, dir, name AS path, 3 AS at, FALSE AS gone FROM o3) SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3"
)
def T10_claims(spark, d):
    """Three members whose runs share paths: b and c come first, then a; b gives most of its runs up, and all are told again."""
    from tideline.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    runs = M.runs(spark, d).select(F.col("name").alias("run_id"), "id")
    has = {"a": runs.where("id % 2 = 0"), "b": runs.where("id % 3 = 0"), "c": runs.where("id % 5 <> 0")}
    told = lambda df, at, gone=False: df.select("run_id", F.lit(at).cast("long").alias("at"), F.lit(gone).alias("gone"), F.lit(None).cast("string").alias("data"))
    late = {"a": [told(has["a"].limit(0), 0), told(has["a"], 1), told(has["a"].limit(0), 2), told(has["a"], 3)], "c": [told(has["c"], 0), *(told(has["c"].limit(0), k) for k in (1, 2)), told(has["c"], 3)]}
    late["b"] = [told(has["b"], 0), told(has["b"].limit(0), 1), told(has["b"].where("id % 4 <> 1"), 2, True), told(has["b"].where("id % 4 = 1"), 3)]
    at = new_place(spark, "claims")
    store = live.ClaimStore(spark, f"{at}/store", list("abc"))
    in_batches(spark, lambda *streams: live.claim_streams(list(zip("abc", streams, strict=True)), store, f"{at}/checkpoint"), *(late[name] for name in "abc"))
    return store.told().select("run_id", "dir", "path", F.col("at").cast("int").alias("at"), "gone")


@query(f"WITH {M.POINTS} SELECT run_id, key, max(seq) AS seq, {mark('value', 'arg_max(value, seq)')} FROM p GROUP BY run_id, key")
def T11_stream_summary(spark, d):
    from tideline.streaming import live

    path, p = staged(spark, M.points(spark, d))
    return shown(drained(spark, live.stream_summary(spark.readStream.schema(p.schema).parquet(path)), "complete"), "run_id", "key", "seq", value="value")
