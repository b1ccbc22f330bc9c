"""Streams over staged files, against what they should leave."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tideline.operators import pyramid as B
from tideline.streaming import live
from tideline.streaming.stores import Slots, Tiers


def drain(stream, path, mode="append"):
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/c").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{path}/o").start().awaitTermination()
    else:
        out.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{path}/o")).start().awaitTermination()


def test_contiguity(spark, tmp_path):
    rows = [("a", s, float(s), float(s)) for s in (2, 0, 1, 1, 4)] + [("b", 0, 0.0, 0.0)]
    schema = "run_id string, seq long, step double, value double"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(live.contiguous_stream(stream), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/o")
    assert sorted(map(tuple, got.where("NOT gap").select("run_id", "seq").collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert got.where("gap AND run_id = 'a' AND seq = 3").count() == 1


def test_pyramid_grows_over_batches(spark, tmp_path):
    p = spark.range(400).select(F.lit("r").alias("run_id"), F.lit("k").alias("key"), F.col("id").alias("seq"), (F.col("id") * 1.0).alias("step"), (F.col("id") / 2).alias("t"), F.sin("id").alias("value"))
    for lo, hi in ((0, 100), (200, 400), (100, 200)):
        p.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = live.PyramidStore(spark, f"{tmp_path}/store")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.stream_pyramid(stream, store, f"{tmp_path}/c").awaitTermination()
    buckets, spans = store.at(store.version)
    assert store.version == 2
    whole = B.build_pyramid(p, spans)
    n = whole.count()
    assert buckets.count() == n and buckets.agg(F.sum("n_fin")).first() == whole.agg(F.sum("n_fin")).first()
    # A batch that is run again gives the same version.
    store.take(p.where("seq >= 100 AND seq < 200"), 2)
    assert store.at(2)[0].count() == n


def test_change_feed(spark, tmp_path):
    schema = "run_id string, uid string, rows long, media long, order long"
    for part in ([("a", "u", 3, 0, 0)], [("a", "u", 5, 1, 1), ("b", "v", 0, 0, 2)], [("a", "w", 1, 0, 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.change_feed(stream, f"{tmp_path}/feed", f"{tmp_path}/c").awaitTermination()
    events = spark.read.parquet(*(f"{tmp_path}/feed/events/v={v}" for v in range(3))).orderBy("batch", "run_id", "ord").collect()
    assert [(r["batch"], r["run_id"], r["event"]) for r in events] == [(0, "a", "run"), (0, "a", "rows"), (1, "a", "rows"), (1, "a", "media"), (1, "a", "run"), (1, "b", "run"), (2, "a", "delete"), (2, "a", "run"), (2, "a", "rows")]


def test_contiguity_over_gaps(spark, tmp_path):
    """Rows of many batches in any order: each run's come once and in order, as far as none is missing."""
    r = random.Random(3)
    schema, runs = "run_id string, seq long, step double, value double", {"a": 60, "b": 35, "c": 1}
    left = [(k, s, float(s), s / 2) for k, n in runs.items() for s in range(n) if (k, s) != ("b", 20)]
    left += r.sample(left, 30)
    r.shuffle(left)
    for i in range(0, len(left), 30):
        spark.createDataFrame(left[i : i + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(live.contiguous_stream(stream), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/o")
    assert sorted(map(tuple, got.where("NOT gap").select("run_id", "seq", "value").collect())) == [(k, s, s / 2) for k, n in sorted(runs.items()) for s in range(n) if k != "b" or s < 20]
    assert got.where("gap AND run_id = 'b' AND seq = 20").count() >= 1


def test_slots_keep_untouched_files(spark, tmp_path):
    """A version writes the partitions that it touches; the others keep their files, and earlier versions can be read."""
    table = Slots(spark, f"{tmp_path}/t", "k long, n long", ["k"], slots=8)
    df = lambda rows: spark.createDataFrame(rows, "k long, n long")
    table.put(df([(k, 0) for k in range(40)]), 0, range(8))
    before, one = set(table.read(0).inputFiles()), df([(7, 1)])
    touched = table.touched(one)
    kept = table.read(0, touched).where("k <> 7").unionByName(one)
    for _ in range(2):  # a version that is written again is the same
        table.put(kept, 1, touched)
    assert len(touched) == 1 and len(before - set(table.read(1).inputFiles())) == 1
    assert {r["k"]: r["n"] for r in table.read(1).collect()} == {k: int(k == 7) for k in range(40)} and table.read(0).where("n = 1").count() == 0
    table.put(table.none(), 2, touched)
    again = Slots(spark, f"{tmp_path}/t", "k long, n long", ["k"], slots=8)  # from what is written alone
    assert again.read(2).count() == 40 - kept.count() and again.read(2, touched).count() == 0 and again.read(-1).count() == 0


def test_tiers_read_what_is_touched(spark, tmp_path):
    """Forty batches, each of one key at a level of its own: a batch's keys lie in files as large as what the key has, not the
    table; every version is the sum of its batches, and few segments are left."""
    table = Tiers(spark, f"{tmp_path}/t", "k string, level int, n long", ["k"], lambda df: df.groupBy("k", "level").agg(F.sum("n").alias("n")), every=3, slots=4)
    size = lambda df: sum(os.path.getsize(r[0].removeprefix("file://")) for r in df.select(F.input_file_name()).distinct().collect())
    read = []
    for v in range(40):
        rows = spark.createDataFrame([(f"k{v % 10}", v % 10, 1)], "k string, level int, n long")
        read.append(size(table.rows(table.live(v - 1), table.parts_of(rows))))
        table.put(rows, v)
        if v in (0, 8, 9, 26, 39):
            assert {r["k"]: r["n"] for r in table.read(v).collect()} == {f"k{k}": len(range(k, v + 1, 10)) for k in range(min(10, v + 1))}
            assert len(table.live(v)) <= 2 * 4
    whole = size(table.rows(table.live(39)))
    assert max(read) <= whole / 5 and max(read[20:]) <= 2 * max(read[:20])


def points_of(spark, rows):
    return spark.createDataFrame([(run, "k", seq, float(step), seq / 2, value) for run, seq, step, value in rows], live.POINT)


def test_young_runs_are_rebuilt(spark, tmp_path):
    """A run's finest level follows its steps until it has its rows; a batch of other runs leaves its files alone."""
    store = live.PyramidStore(spark, f"{tmp_path}/s", least=20, slots=32)
    store.take(points_of(spark, [("a", s, 4096 * s, 1.0) for s in range(4)]), 0)
    assert store.at(0)[1].first()["fine"] == 6
    store.take(points_of(spark, [("a", 4 + s, 12288 + s, 2.0) for s in range(10)]), 1)
    spans = store.at(1)[1].first()
    assert spans["fine"] == 0  # built anew: the middle gap is 1 now
    store.take(points_of(spark, [("a", 14 + s, 12300 + 16 * s, float("inf")) for s in range(10)]), 2)  # 24 rows: from here on it grows
    fine = store.at(2)[1].first()["fine"]
    held = set(store.spans.read(2).inputFiles())
    store.take(points_of(spark, [("b", s, s, 0.0) for s in range(3)]), 3)
    assert held <= set(store.spans.read(3).inputFiles()) and store.young.read(3).select("run_id").distinct().collect() == [("b",)]
    store.take(points_of(spark, [("a", 24 + s, 5000.0 * s, 3.0) for s in range(3)]), 4)
    buckets, spans = store.at(4)
    assert spans.where("run_id = 'a'").first()["fine"] == fine and spans.where("run_id = 'a'").first()["top"] > 1
    every = points_of(spark, [("a", s, 4096 * s, 1.0) for s in range(4)] + [("a", 4 + s, 12288 + s, 2.0) for s in range(10)] + [("a", 14 + s, 12300 + 16 * s, float("inf")) for s in range(10)] + [("b", s, s, 0.0) for s in range(3)] + [("a", 24 + s, 5000.0 * s, 3.0) for s in range(3)])
    plain = lambda df: sorted(map(tuple, df.select("run_id", "level", "bucket", "n_fin", "n_pos", "sum_v").collect()))
    was = plain(buckets)
    assert was == plain(B.build_pyramid(every, spans))
    store.take(points_of(spark, [("a", 24 + s, 5000.0 * s, 3.0) for s in range(3)]), 4)  # again: the same version
    assert plain(store.at(4)[0]) == was


def test_levels_wait_for_the_refresh_or_the_end(spark, tmp_path):
    clock = [100.0]
    store = live.PyramidStore(spark, f"{tmp_path}/s", refresh=10.0, slots=4, now=lambda: clock[0])
    n = lambda: store.at(store.version)[0].where("run_id = 'a'").groupBy("level").agg(F.sum("n_fin").alias("n")).agg(F.max("n")).first()[0]
    store.take(points_of(spark, [("a", s, s, 1.0) for s in range(4)]), 0)
    assert n() == 4
    store.take(points_of(spark, [("a", 4, 4, 1.0)]), 1)
    assert n() == 4 and store.waiting.read(1).count() == 1
    clock[0] += 11
    store.take(points_of(spark, [("b", 0, 0, 1.0)]), 2)
    assert n() == 5 and store.waiting.read(2).count() == 0
    store.take(points_of(spark, [("a", 5, 5, 1.0)]).withColumn("state", F.lit("running")), 3)
    assert n() == 5
    store.take(spark.createDataFrame([("a", None, None, None, None, None, "finished")], live.POINT + ", state string"), 4)
    assert n() == 6


def test_rewritten_runs_alone_are_written(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "run_id string, uid string, rows long, media long, value int")
    store = live.ListedPoints(spark, f"{tmp_path}/s", "value int", add_new=True, slots=64)
    first = [(f"r{k}", "u", 2, 0, v) for k in range(30) for v in (0, 1)]
    store.take(listing(first), 0)
    files = set(store.at(0).inputFiles())
    then = [r for r in first if r[0] not in ("r3", "r4")] + [("r3", "w", 1, 0, 9), ("new", "u", 1, 0, 5)]
    store.take(listing([(r, u, 3 if r == "r5" else n, m, v) for r, u, n, m, v in then]), 1)
    assert sorted(map(tuple, store.at(1).collect())) == sorted((r, v) for r, _, _, _, v in then)
    assert len(files - set(store.at(1).inputFiles())) <= 3  # those of r3, r4 and new


def test_live_view_drops_what_is_compiled(spark, tmp_path):
    """Points past the compiled ones are served at once, and leave the tail when they have been compiled."""
    held, compiled = {"seq": 5}, points_of(spark, [("a", s, s, 1.0) for s in range(5)])
    known = lambda: spark.createDataFrame([("a", "k", 0, held["seq"])], "run_id string, key string, level int, held_seq long")
    view = live.LiveView(spark, f"{tmp_path}/v", lambda: B.bucketize(compiled, 0), known, slots=4)
    view.take(points_of(spark, [("a", s, s, 1.0) for s in (4, 5, 6)]), 0)
    assert view.buckets(0).count() == 7 and view.tail.read(0).count() == 2
    held["seq"], compiled = 7, points_of(spark, [("a", s, s, 1.0) for s in range(7)])
    view.take(points_of(spark, [("a", 7, 7, 1.0), ("a", 7, 7, 1.0)]), 1)
    one = spark.createDataFrame([("a",)], "run_id string")
    assert view.tail.read(1).count() == 1 and view.buckets(1, one).agg(F.sum("n_fin")).first()[0] == view.buckets(1).agg(F.sum("n_fin")).first()[0] == 8


def test_feed_tells_what_is_gone(spark, tmp_path):
    feed = live.Feed(spark, f"{tmp_path}/f", slots=4)
    schema = "run_id string, uid string, rows long, media long, gone boolean, folder boolean, info string, order long"
    batches = [
        [("a", "u", 1, 0, None, None, None, 0), ("x", None, None, None, None, True, "{}", 1)],
        [("a", None, None, None, True, None, None, 2), ("b", "u", 0, 1, None, None, None, 3), ("x", None, None, None, None, True, "{}", 4), ("y", None, None, None, None, True, "1", 5)],
        [("a", "u", 1, 0, None, None, None, 6), ("a", None, None, None, True, None, None, 7), ("x", None, None, None, None, True, None, 8), ("c", None, None, None, True, None, None, 9)],
    ]
    told = []
    for v, rows in enumerate(batches):
        feed.take(spark.createDataFrame(rows, schema), v)
        told.append([(r["run_id"], r["event"], r["info"]) for r in spark.read.parquet(f"{tmp_path}/f/events/v={v}").orderBy("at", "run_id", "ord").collect()])
    assert told == [[("a", "run", None), ("a", "rows", None), ("x", "folder", "{}")], [("a", "delete", None), ("b", "run", None), ("b", "media", None), ("y", "folder", "1")], [("x", "folder", None)]]
    assert feed.states.read(2).collect() == [("b", "u", 0, 1)]


def test_a_silent_run_crashes(spark, tmp_path):
    """A beat makes a run run; the timer expires when no other comes, and a later beat makes it run again."""
    beat = lambda: spark.createDataFrame([("a", 1.0)], "run_id string, at double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    beat()
    stream = spark.readStream.schema("run_id string, at double").parquet(f"{tmp_path}/in")
    out = live.crash_stream(stream, limit=2.0).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c")
    query = out.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/o")).trigger(processingTime="1 second").start()
    said = lambda: [r["state"] for r in spark.read.schema("run_id string, state string, batch long").parquet(f"{tmp_path}/o").orderBy("batch").collect()]

    def until(states):
        for _ in range(120):
            if query.lastProgress and said() == states:
                return True
            time.sleep(0.5)
        return False

    try:
        assert until(["running", "crashed"]), said()
        beat()
        assert until(["running", "crashed", "running", "crashed"]), said()
    finally:
        query.stop()


def test_liveness(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 1.0)], "run_id string, at double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run_id string, at double").parquet(f"{tmp_path}/in")
    out = live.crash_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c")
    query = out.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/o")).trigger(processingTime="1 second").start()
    for _ in range(60):  # timers keep the query going, so it never is at its end
        if query.lastProgress and (query.lastProgress["batchId"] >= 1 or query.lastProgress["numInputRows"]):
            break
        time.sleep(1)
    query.stop()
    found = spark.read.schema("run_id string, state string").parquet(f"{tmp_path}/o")
    assert sorted(map(tuple, found.collect())) == [("a", "running"), ("b", "running")]


@pytest.mark.parametrize("prefix, n", [("", 3), ("x", 2), ("x/a", 1)])
def test_subscribe(spark, prefix, n):
    feed = spark.createDataFrame([("x/a",), ("x/b",), ("xy",)], "run_id string")
    assert live.subscribe(feed, prefix).count() == n


def test_claims_over_batches(spark, tmp_path):
    """Claims of a batch are taken up by the next; a path that is given up goes to the one that came next. Batches may
    come in several files."""
    from tideline import queries as Q

    schema = "run_id string, at long, gone boolean, data string"
    a = [[("x", 1, False, "1"), ("y", 1, None, None)], [("x", 2, True, None)], [("x", 3, False, None)]]
    b = [[("x", 0, False, None)], [("y", 2, False, None), (None, 2, False, None)], [("x", 3, False, None), ("z", 3, True, None)]]
    store = live.ClaimStore(spark, f"{tmp_path}/claims", ["a", "b"], slots=4)
    tables = [[spark.createDataFrame(rows, schema).repartition(3) for rows in member] for member in (a, b)]
    batches = []
    take = store.take
    store.take = lambda batch, version: batches.append(len(batch.inputFiles())) or take(batch, version)
    Q.in_batches(spark, lambda *s: live.claim_streams(list(zip("ab", s, strict=True)), store, f"{tmp_path}/c"), *tables)
    assert len(batches) == 3
    got = sorted(((r["at"], r["dir"], r["path"], r["run_id"], r["gone"]) for r in store.told().collect()), key=str)
    assert got == sorted([(0, "b", "x", "x", False), (1, "a", "x", "x<a>", False), (1, "a", "y", "y", False), (2, "a", "x", "x<a>", True), (2, "b", "y", "y<b>", False), (2, "b", None, None, False), (3, "a", "x", "x<a>", False), (3, "b", "x", "x", False), (3, "b", "z", "z", True)], key=str)


def test_follow_batches_of_several_files(spark, tmp_path):
    """Runs of one slot keep their own tails and ends."""
    from tideline import queries as Q

    schema = "run_id string, seq long, values string, done long"
    rows = lambda lo, hi: [(r, i, str(i), None) for r in ("a", "b", None) for i in range(lo, hi)]
    seen = spark.createDataFrame([("a", 2), ("b", 0)], "run_id string, seq long")
    parts = [rows(0, 6), rows(4, 9) + [("b", None, None, 7)], rows(9, 12)]
    tables = [spark.createDataFrame(p, schema).repartition(3) for p in parts]
    Q.in_batches(spark, lambda stream: Q.appended(live.follow(stream, seen, slots=1), str(tmp_path)), tables)
    got = sorted(((r["run_id"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted([("a", i) for i in range(3, 12)] + [("b", i) for i in range(1, 7)] + [(None, i) for i in range(12)], key=str)
