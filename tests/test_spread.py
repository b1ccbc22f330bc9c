"""Scans in row order with one series over several tasks, against plain recomputation."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tideline.operators import pyramid as B
from tideline.operators import series as S
from tideline.plans import shared
from tideline.sources import tables as T

POINTS = "run_id string, key string, seq long, step double, t double, value double"


@pytest.fixture
def tasks(spark):
    """Seven tasks for every shuffle, so that each of these series lies in several."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def walk(seed, n=300, run="r", rising=True):
    r, step, out = random.Random(seed), 0.0, []
    for i in range(n):
        step += r.choice([0.0, 1.0, 1.0, 2.5, 16.0]) if rising or r.random() > 0.01 else -3.0
        out.append((run, "k", i, step, step / 2, r.choice([r.random(), math.nan, math.inf, r.random(), -1.0])))
    return out


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scans(tasks):
    rows = [("a", i, i % 5 if i % 3 else None) for i in range(200)] + [("b", 0, None), (None, 0, 3), (None, 1, None)]
    placed = shared.in_order(tasks.createDataFrame(rows, "g string, i int, v int").repartition(3), ["g"], "i")
    assert placed.select("_part").distinct().count() > 3
    want, last, total, before = [], {}, {}, {}
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        total[g] = total.get(g, 0) + i
        want.append((str(g), i, str(last[g]), total[g], str(before.get(g))))
        before[g] = i
    out = shared.previous(shared.running(shared.latest(placed, ["g"], F.col("v")), ["g"], F.col("i")), ["g"], "i")
    got = [(str(r["g"]), r["i"], str(r["_latest"]), r["_sum"], str(r["_prev"] and r["_prev"]["i"])) for r in out.collect()]
    assert sorted(got) == sorted(want)
    empty = shared.in_order(tasks.createDataFrame([], "g string, i int, v int"), ["g"], "i")
    assert shared.latest(empty, ["g"], F.col("v")).count() == 0


def test_asof(tasks):
    pts = walk(1) + walk(2, 40, "s")
    probes = [("r", x / 3) for x in range(-3, 900, 7)] + [("r", 100.0)] * 50 + [("s", 5.0), ("none", 1.0), ("r", None), (None, 2.0)]
    got = S.asof_join(tasks.createDataFrame(probes, "run_id string, x double"), tasks.createDataFrame(pts, POINTS))

    def found(run, x):
        ok = [(p[3], p[2], p[5]) for p in pts if p[0] == run and x is not None and p[3] <= x and math.isfinite(p[5])]
        return (str(run), str(x), *(str(v) for v in ((max(ok)[0], max(ok)[2]) if ok else (None, None))))

    assert sorted((str(r["run_id"]), str(r["x"]), str(r["at"]), str(r["value"])) for r in got.collect()) == sorted(found(*p) for p in probes)


def test_extents_and_visible(tasks):
    up, down = walk(3), walk(4, 300, "d", rising=False)
    df = tasks.createDataFrame(up + down, POINTS)
    rises = {r["run_id"]: r["rises"] for r in S.extents(df).collect()}
    assert rises == {"r": True, "d": all(a[3] <= b[3] for a, b in zip(down, down[1:]))} and not rises["d"]
    x0, x1 = up[100][3] + 0.1, up[200][3]
    inside = [p[2] for p in up if x0 <= p[3] <= x1]
    got = rows_of(S.visible(df.where("run_id = 'r'"), x0, x1), "seq")
    assert [s for (s,) in got] == [inside[0] - 1, *inside, inside[-1] + 1]
    assert S.visible(df, 1e9, 2e9).count() == 0


def test_decimate_over_tasks(tasks):
    pts = walk(5)
    x1 = pts[-1][3]
    want, k = set(), 0
    column = lambda p: math.floor(p[3] * (10 / x1)) if math.isfinite(p[5]) else None
    while k < len(pts):
        piece = [p for p in pts[k:]]
        n = next((i for i, p in enumerate(piece) if column(p) != column(piece[0])), len(piece))
        piece, k = piece[:n], k + n
        if column(piece[0]) is None:
            want.add((piece[0][2], False))
        else:
            want |= {(p[2], True) for p in (piece[0], min(piece, key=lambda p: (p[5], p[2])), min(piece, key=lambda p: (-p[5], p[2])), piece[-1])}
    first = next(i for i, p in enumerate(pts) if math.isfinite(p[5]))
    want -= {(i, False) for i in range(first)}  # no break before the first drawn point
    got = S.decimate(tasks.createDataFrame(pts, POINTS), 0.0, x1, 10).select("seq", (~F.isnan("value")).alias("ok"))
    assert rows_of(got, "seq", "ok") == sorted(want)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 150, 151])
def test_finest(tasks, n):
    r = random.Random(n)
    steps = sorted({r.choice([r.uniform(0, 1), r.uniform(0, 300), r.randint(0, 5000)]) for _ in range(n)})
    gaps = [b - a for a, b in zip(steps, steps[1:])]
    pts = [("r", "k", i, float(s), 0.0, 1.0) for i, s in enumerate(steps)] * 2
    got = B.finest(tasks.createDataFrame(pts, POINTS)).collect()
    assert [x["fine"] for x in got] == [max(-20, math.floor(math.log2(statistics.median(gaps))))]


def test_steps_and_contiguity(tasks):
    r = random.Random(9)
    logged = [("r", i, r.choice([None, None, float(2 * i)])) for i in range(200)] + [("n", i, None) for i in range(3)]
    want, last = [], {}
    for run, i, step in logged:
        last[run] = step if step is not None else last.get(run, -1.0) + 1
        want.append((run, i, last[run]))
    assert rows_of(T.assign_steps(tasks.createDataFrame(logged, "run_id string, order int, step double")), "run_id", "order", "step") == sorted(want)
    rows = tasks.createDataFrame([("r", i) for i in range(200) if i != 150] + [("z", 1)], "run_id string, seq long")
    assert rows_of(T.contiguous_rows(rows), "run_id", "seq") == [("r", i) for i in range(150)]


@pytest.mark.parametrize("block", [1, 7, 65536])
def test_smoothing_over_tasks(tasks, block):
    pts = walk(6) + walk(7, 40, "s") + [("t", "k", i, float(i), 0.0, math.nan if i < 50 else 2.0) for i in range(90)] + [("u", "k", 0, 1.0, 0.0, 5.0), (None, "k", 0, None, 0.0, 4.0), (None, "k", 1, 3.0, 0.0, 4.0)]
    placed = tasks.createDataFrame(pts, POINTS).repartition(3).withColumn("extra", F.lit("x"))
    got = {(r["run_id"], r["seq"]): r["smoothed"] for r in S.twema(placed, 0.7, 3.0, block=block).collect()}
    assert len(got) == len(pts)
    state = {}
    for run, _, seq, x, _, y in pts:
        want = y
        if x is not None and math.isfinite(y):
            a, d, last = state.get(run, (0.0, 0.0, x))
            w = 0.7 ** (max(x - last, 0.0) / 3.0)
            state[run] = a, d, last = a * w + y, d * w + 1, x
            want = a / d
        assert got[run, seq] == pytest.approx(want, rel=1e-9, nan_ok=True), (run, seq)


def test_thinning_ranks_once(tasks):
    pts = walk(8, 120) + walk(9, 11, "s")
    df = tasks.createDataFrame(pts, POINTS)
    for last, every, n in [(None, None, None), (50, None, None), (None, 7, None), (50, 7, None), (50, 7, 4), (None, 3, 9), (200, None, 1), (3, 100, 2)]:
        want = set()
        for run in ("r", "s"):
            own = [p[2] for p in pts if p[0] == run][-(last or 1000) :]
            own = [p for i, p in enumerate(own) if not every or i % every == 0 or i == len(own) - 1]
            if n and len(own) > n:
                own = [own[round(j * ((len(own) - 1) / (n - 1) if n > 1 else len(own)))] for j in range(n)]
            want |= {(run, p) for p in own}
        assert set(rows_of(S.thin(df, last, every, n), "run_id", "seq")) == want, (last, every, n)


@pytest.mark.parametrize("rows", [1, 3, 10])
def test_finest_over_batches(tasks, rows):
    """Gaps across Arrow batches and tasks, with short and long series beside each other."""
    r = random.Random(rows)
    steps = {f"s{k:02d}": [float(r.choice([r.randint(0, 40), r.randint(0, 3000)])) for _ in range(n)] for k, n in enumerate([1, 2, 90, 1, 3, 40, 1])}
    pts = [(k, "k", i, s, 0.0, 1.0) for k, v in steps.items() for i, s in enumerate(v)]
    name, old = "spark.sql.execution.arrow.maxRecordsPerBatch", tasks.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tasks.conf.set(name, str(rows))
    try:
        got = {x["run_id"]: x["fine"] for x in B.finest(tasks.createDataFrame(pts, POINTS)).collect()}
    finally:
        tasks.conf.set(name, old)
    gaps = {k: [b - a for a, b in zip(u, u[1:])] for k, v in steps.items() if len(u := sorted(set(v))) > 1}
    assert got == {k: max(-20, math.floor(math.log2(statistics.median(g)))) for k, g in gaps.items()}


def test_rows_and_summaries_use_tasks_as_their_rows_ask(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 20)
    points = spark.range(400).selectExpr("CAST(id % 25 AS STRING) AS run_id", "id DIV 50 AS seq", "CAST(id DIV 50 AS DOUBLE) AS step", "IF(id % 50 < 25, 'a', 'b') AS key", "CAST(id AS DOUBLE) AS value").withColumn("t", F.col("step") / 2)
    rows = T.points_to_rows(points)
    assert rows.rdd.getNumPartitions() == 20  # of 2 shuffle partitions
    assert sorted((r["run_id"], r["seq"], r["values"]["a"], r["values"]["b"]) for r in rows.collect()) == sorted((str(i), q, 50.0 * q + i, 50.0 * q + 25 + i) for i in range(25) for q in range(8))
    out = S.summaries(rows, T.rows_to_points(rows))
    assert out.rdd.getNumPartitions() == 10
    assert sorted((r["run_id"], r["rows"], r["_step"], r["_runtime"], r["summary"]["a"], r["summary"]["b"]) for r in out.collect()) == sorted((str(i), 8, 7.0, 3.5, 350.0 + i, 375.0 + i) for i in range(25))
