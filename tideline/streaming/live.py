"""Live maintenance by Structured Streaming: tails, contiguity, pyramids, liveness, change feeds, summaries."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tideline.functions.values import in_scope
from tideline.operators import pyramid as B
from tideline.operators.runs import diff_snapshots
from tideline.plans.shared import join_groups, written
from tideline.streaming.stores import Slots, Tiers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail_stream(spark: SparkSession, path: str, schema: StructType, after: int = -1) -> DataFrame:
    """Rows past a sequence number, as they are committed."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("seq") > after)


def dealt(stream: DataFrame, by: str, slots: int) -> DataFrame:
    """The stream in groups of keys, `slots` of them: a call of Python works on all keys of a group that a batch brings. A
    checkpoint holds for one number of slots; a call holds a slot's part of a batch."""
    return stream.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(slots)).cast("int")).groupBy("_slot")


def state_key(name: str | None) -> tuple[str]:
    """A key of a slot's map; a null one has its own."""
    return ("",) if name is None else ("=" + name,)


class Following(StatefulProcessor):
    """Passes on the rows past their tails of a slot's runs until these have ended: `done` is how many rows a run has then,
    and none at or beyond that number come through, whichever of both is read first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run string", "done long, next long")  # done: -1 while a run goes on

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows), ignore_index=True)
        code, runs = pd.factorize(f["run_id"], use_na_sentinel=False)
        keys = [state_key(None if pd.isna(r) else r) for r in runs]
        known = [self.runs.getValue(k) or (-1, 0) for k in keys]
        done, start = np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], np.int64)
        most = np.iinfo(np.int64).max
        end, after = np.where(done < 0, most, done), np.full(len(keys), -1, np.int64)
        said, tails = f["done"].notna().to_numpy(), f["after"].notna().to_numpy()
        np.minimum.at(end, code[said], f["done"][said].astype("int64").to_numpy())
        np.maximum.at(after, code[tails], f["after"][tails].astype("int64").to_numpy())
        start = np.maximum(start, after + 1)
        at = np.flatnonzero(f["seq"].notna().to_numpy())
        seq = f["seq"].iloc[at].astype("int64").to_numpy()
        kept = (seq >= start[code[at]]) & (seq < end[code[at]])
        got = f.iloc[at[kept]].assign(seq=seq[kept], _code=code[at[kept]]).drop_duplicates(["_code", "seq"]).sort_values(["_code", "seq"])
        now = np.array([k[1] for k in known], np.int64)
        np.maximum.at(now, got["_code"].to_numpy(), got["seq"].to_numpy() + 1)
        for i, k in enumerate(keys):
            new = (-1 if end[i] == most else int(end[i]), int(now[i]))
            if new != tuple(known[i]):
                self.runs.updateValue(k, new)
        yield got[["run_id", "seq", "values"]]

    def close(self) -> None:
        pass


def tail(rows: DataFrame, lines: int) -> DataFrame:
    """The last `lines` rows of each run. rows: run_id, seq and more."""
    last = rows.groupBy("run_id").agg(F.max("seq").alias("_last"))
    return rows.join(last, "run_id").where(F.col("seq") > F.col("_last") - lines).drop("_last")


def follow(stream: DataFrame, seen: DataFrame, slots: int = 1024) -> DataFrame:
    """(run_id, seq, values) of rows that come after those of `seen` (run_id, seq: what is shown already), each once, until
    its run ends. stream: run_id, seq, values (JSON), and `done`, the number of rows of a run that has ended, in a row
    that has no seq. Rows of a run come in order of seq from one batch to the next. Needs the RocksDB state store."""
    after = seen.groupBy("run_id").agg(F.max("seq").alias("after"))
    known = stream.select("run_id", "seq", "values", "done").join(after, "run_id", "left")
    return dealt(known, "run_id", slots).transformWithStateInPandas(statefulProcessor=Following(), outputStructType="run_id string, seq long, values string", outputMode="append", timeMode="none")


class Contiguity(StatefulProcessor):
    """Emits each run's rows once and in order: what was seen is skipped, what is ahead waits. Rows that go on from the
    last one are taken as they come; only those beyond a gap go through the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.ahead = handle.getMapState("ahead", "seq long", "step double, value double")

    def waiting(self, at: int) -> pd.DataFrame:
        """Rows from `at` on that waited for the one before."""
        out = []
        while self.ahead.containsKey((at + len(out),)):
            seq = at + len(out)
            out.append((seq, *self.ahead.getValue((seq,))))
            self.ahead.removeKey((seq,))
        return pd.DataFrame(out, columns=["seq", "step", "value"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        held = next(iter(self.ahead.keys()), None) is not None
        for f in rows:
            f = f[["seq", "step", "value"]].drop_duplicates("seq").sort_values("seq")
            while len(f := f[f["seq"] >= at]):
                n = int((f["seq"].to_numpy() == at + np.arange(len(f))).sum())  # distinct and sorted: the first n go on
                found = f.iloc[:n] if n else self.waiting(at) if held else f.iloc[:0]
                if not len(found):
                    break
                yield found.assign(run_id=key[0], gap=False)
                at += len(found)
            for r in f.itertuples(index=False):
                self.ahead.updateValue((int(r.seq),), (float(r.step), float(r.value)))
                held = True
            if held and len(found := self.waiting(at)):
                yield found.assign(run_id=key[0], gap=False)
                at += len(found)
        self.next.update((at,))
        if held and next(iter(self.ahead.keys()), None) is not None:
            yield pd.DataFrame([(at, None, None, key[0], True)], columns=["seq", "step", "value", "run_id", "gap"])  # the row that is missing

    def close(self) -> None:
        pass


def contiguous_stream(rows: DataFrame) -> DataFrame:
    """(run_id, seq, step, value, gap) of a stream of rows (run_id, seq, step, value): each row once, in order; `gap` rows
    name the row that others wait for. Needs the RocksDB state store."""
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Contiguity(), outputStructType="run_id string, seq long, step double, value double, gap boolean", outputMode="append", timeMode="none")


class Liveness(StatefulProcessor):
    """running on a heartbeat; crashed when none came for `limit` seconds."""

    def __init__(self, limit: float = 300.0):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, timer long")

    def say(self, key, state: str) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        before = self.known.get() if self.known.exists() else ("", 0)
        if before[1]:
            self.handle.deleteTimer(before[1])
        due = timerValues.getCurrentProcessingTimeInMs() + int(self.limit * 1000)
        self.handle.registerTimer(due)
        self.known.update(("running", due))
        yield self.say(key, "running") if before[0] != "running" else self.say(key, "running").iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.update(("crashed", 0))
        yield self.say(key, "crashed")

    def close(self) -> None:
        pass


def crash_stream(heartbeats: DataFrame, limit: float = 300.0) -> DataFrame:
    """(run_id, state) as runs start to beat and fall silent."""
    return heartbeats.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Liveness(limit), outputStructType="run_id string, state string", outputMode="update", timeMode="ProcessingTime")


class Losses(StatefulProcessor):
    """Compares what is held of a running run with what its source says it has. What a heartbeat says has to be there by
    the next one or within `patience` seconds; else the run is short of it."""

    def __init__(self, patience: float = 30.0):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows long, media long")
        self.due = handle.getValueState("due", "rows long, media long, timer long")

    def short(self, key, due) -> pd.DataFrame:
        rows, media = self.held.get() if self.held.exists() else (0, 0)
        found = pd.DataFrame([(key[0], due[0], due[1], rows, media)], columns=["run_id", "rows", "media", "held_rows", "held_media"])
        return found if rows < due[0] or media < due[1] else found.iloc[:0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows))
        got, beats = f[~f["beat"]], f[f["beat"]]
        if len(got):
            before = self.held.get() if self.held.exists() else (0, 0)
            self.held.update((max(before[0], int(got["rows"].max())), max(before[1], int(got["media"].max()))))
        due = self.due.get() if self.due.exists() else None
        if due is not None and len(beats):
            self.handle.deleteTimer(due[2])
            yield self.short(key, due)
        if len(beats):
            at = timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000)
            self.handle.registerTimer(at)
            self.due.update((int(beats["rows"].max()), int(beats["media"].max()), at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()
        self.due.clear()
        yield self.short(key, due)

    def close(self) -> None:
        pass


def find_losses(beats: DataFrame, held: DataFrame, patience: float = 30.0) -> DataFrame:
    """(run_id, rows, media, held_rows, held_media) of runs that lack what their source had at an earlier heartbeat. Both
    are streams of (run_id, rows, media): the source's counts of its running runs, and what has been taken over."""
    said = lambda df, beat: df.select("run_id", F.col("rows").cast("long").alias("rows"), F.col("media").cast("long").alias("media"), F.lit(beat).alias("beat"))
    both = said(beats, True).unionByName(said(held, False))
    return both.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Losses(patience), outputStructType="run_id string, rows long, media long, held_rows long, held_media long", outputMode="update", timeMode="ProcessingTime")


POINT = "run_id string, key string, seq long, step double, t double, value double"
BUCKET = "run_id string, key string, level int, bucket long, n_fin long, sum_v double, sum_s double, sum_t double, n_pos long, n_neg long, sum_s_inf double, sum_t_inf double"


class PyramidStore:
    """A pyramid kept by a stream of points; rows may also say that a run has stopped (column `state`, then without a key).

    A run with fewer than `least` rows compiled is built anew with each batch that brings more, so that its finest level
    follows its steps: its points are kept beside the store until then. From there on it grows, and a batch adds only what
    its points do to the buckets that they touch. Levels are compiled for a new run, and for others once `refresh`
    seconds have passed since they were last or the run has stopped; until then their points wait. A batch reads and writes
    the partitions of its runs and of those that wait, and of the pyramid the top levels of series that rise above them."""

    def __init__(self, spark: SparkSession, path: str, least: int = 4096, refresh: float = 0.0, slots: int = 64, now: Callable[[], float] = time.time):
        self.spark, self.least, self.refresh, self.now = spark, least, refresh, now
        table = lambda name, schema: Slots(spark, f"{path.rstrip('/')}/{name}", schema, ["run_id"], slots)
        self.runs = table("runs", "run_id string, compiled long, at double")
        self.spans = table("spans", "run_id string, key string, fine int, top int, lo double, hi double")
        self.young, self.waiting, self.recent = table("young", POINT), table("waiting", POINT), table("recent", BUCKET)
        self.log = Tiers(spark, f"{path.rstrip('/')}/log", BUCKET, B.SERIES, lambda df: df.groupBy(*B.SERIES, "level", "bucket").agg(*B.summed()), slots=max(1, slots // 16))  # beside the levels

    def at(self, version: int) -> tuple[DataFrame, DataFrame] | None:
        """Buckets and spans after a batch."""
        return (self.log.read(version).unionByName(self.recent.read(version)), self.spans.read(version)) if version >= 0 else None

    def lifted_from(self, rises: DataFrame, version: int) -> DataFrame:
        """The buckets that series rise from."""
        return self.log.read(version, self.log.parts_of(rises))

    def take(self, batch: DataFrame, version: int) -> None:
        batch = batch.withColumn("state", F.lit(None).cast("string")) if "state" not in batch.columns else batch
        batch = written(batch.select(*(c.split()[0] for c in POINT.split(", ")), "state"), "batch")
        before, columns = version - 1, [c.split()[0] for c in POINT.split(", ")]
        slots = self.runs.touched(batch) | set(self.waiting.held(before))
        new = written(batch.where("key IS NOT NULL").select(columns).unionByName(self.waiting.read(before, slots)), "new-points")
        ended = batch.where("state <> 'running'").select("run_id").distinct().withColumn("ended", F.lit(True))
        held = self.runs.read(before, slots)
        counts = new.groupBy("run_id").agg(F.countDistinct("seq").alias("rows")).join(held, "run_id", "left").join(ended, "run_id", "left")
        due = F.col("at").isNull() | F.col("ended").isNotNull() | (F.lit(self.now()) - F.col("at") >= self.refresh)
        counts = written(counts.select("run_id", "rows", F.coalesce("compiled", F.lit(0)).alias("compiled"), due.alias("due")), "due-runs")  # a row a run
        of = lambda df, where: df.join(counts.where(where).select("run_id"), "run_id", "left_semi")
        without = lambda df, where: df.join(counts.where(where).select("run_id"), "run_id", "left_anti")
        young, old = (f"due AND compiled {sign} {self.least}" for sign in ("<", ">="))
        grown_up = f"{young} AND compiled + rows >= {self.least}"
        n = counts.agg(F.count_if(F.expr(young)).alias("young"), F.count_if(F.expr(old)).alias("old")).first()
        points, fresh, built = self.young.none(), self.spans.none(), self.recent.none()
        added, grown = self.recent.none(), self.spans.none()
        if n["young"]:
            points = written(of(self.young.read(before, slots), young).unionByName(of(new, young)), "young-points")
            fresh = written(B.spans(points), "young-spans")
            built = written(B.build_pyramid(points, fresh), "young-buckets")
        if n["old"]:
            more = of(new, old)
            known = of(self.spans.read(before, slots), old).join(more.select(*B.SERIES).distinct(), B.SERIES, "left_semi")
            added, grown = B.growth(lambda rises: self.lifted_from(rises, before), known, more)
        self.log.put(added.unionByName(of(built, grown_up)), version)
        spans = without(self.spans.read(before, slots), young).join(grown.select(*B.SERIES), B.SERIES, "left_anti")
        self.spans.put(spans.unionByName(fresh).unionByName(grown), version, slots)
        self.young.put(without(self.young.read(before, slots), young).unionByName(without(points, grown_up)), version, slots)
        self.recent.put(without(self.recent.read(before, slots), young).unionByName(without(built, grown_up)), version, slots)
        now = counts.where("due").select("run_id", (F.col("compiled") + F.col("rows")).alias("compiled"), F.lit(self.now()).alias("at"))
        self.runs.put(without(held, "due").unionByName(now), version, slots)
        self.waiting.put(of(new, "NOT due"), version, slots)
        self.version = version


def stream_pyramid(points: DataFrame, store: PyramidStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps the pyramid up with a stream of points: `every` seconds, or with what is there now."""
    out = points.writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


class LiveView:
    """Compiled levels with the points past them, as a stream of points goes on. `held` gives, at each batch, the level of
    a series and the seq compiled so far (run_id, key, level, held_seq), `compiled` the buckets up to it. The points past
    it are kept in partitions of their runs; a batch writes those that it touches anew, and drops from them what has been
    compiled meanwhile."""

    def __init__(self, spark: SparkSession, path: str, compiled: Callable[[], DataFrame], held: Callable[[], DataFrame], slots: int = 64):
        self.compiled, self.held = compiled, held
        self.tail = Slots(spark, f"{path.rstrip('/')}/tail", POINT, ["run_id"], slots)

    def past(self, points: DataFrame) -> DataFrame:
        return points.join(self.held(), B.SERIES).where(F.col("seq") >= F.col("held_seq"))

    def take(self, points: DataFrame, version: int) -> None:
        points = points.select([c.split()[0] for c in POINT.split(", ")]).persist()
        touched = self.tail.touched(points)
        late = self.past(self.tail.read(version - 1, touched).unionByName(points)).dropDuplicates(["run_id", "key", "seq"])
        self.tail.put(late.select(points.columns), version, touched)
        points.unpersist()
        self.version = version

    def buckets(self, version: int, runs: DataFrame | None = None) -> DataFrame:
        """The view after a batch, of these runs (run_id) or all: theirs are read from their own partitions."""
        slots = None if runs is None else self.tail.touched(runs)
        only = lambda df: df if runs is None else df.join(runs.select("run_id"), "run_id", "left_semi")
        return B.combine(only(self.compiled()), B.bucketize(self.past(only(self.tail.read(version, slots))), F.col("level")))


def live_view(view: LiveView, points: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keeps the view up with what a stream of points has now."""
    return points.writeStream.foreachBatch(view.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_seqs(rows: DataFrame) -> DataFrame:
    """Rows held per run, to compare with the source."""
    return rows.groupBy("run_id").agg((F.max("seq") + 1).alias("rows"))


def stream_summary(points: DataFrame) -> DataFrame:
    """Each metric's last value; new metrics appear as they come."""
    return points.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def events_of(held: DataFrame, listed: DataFrame, batch: int) -> DataFrame:
    """The change events of one batch in order: a new run's own first; a run's event after those of its rows and media."""
    d = diff_snapshots(held, listed).where("change <> 'unchanged'").join(listed.select("run_id", "rows", "media"), "run_id", "left").join(held.select("run_id", F.col("rows").alias("_r"), F.col("media").alias("_m")), "run_id", "left")
    event = lambda kind, order, ok: F.when(ok, F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("event")))
    fresh, gone = F.col("change").isin("new", "rewritten"), F.col("change").isin("gone", "rewritten")
    more = lambda c, old: F.coalesce(F.col(c), F.lit(0)) > F.when(fresh, 0).otherwise(F.coalesce(F.col(old), F.lit(0)))
    kinds = F.array(event("delete", 0, gone), event("run", 1, fresh), event("rows", 2, more("rows", "_r")), event("media", 3, more("media", "_m")), event("run", 4, ~fresh & (F.col("change") != "gone")))
    return d.select(F.lit(batch).alias("batch"), "run_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("e")).select("batch", "run_id", "e.*")


class Feed:
    """A change feed over run states and folder notes, batch by batch: rows (run_id, event, ord, info, at) in tables below
    `path`/events, in the order of `at`, run_id and `ord`; a folder's path is its run_id. What is held of runs and folders lies in partitions of which a batch
    reads and writes those it touches. complete: a batch lists all runs and folders, so what it lacks is gone; else
    what is gone has a row that says so (column `gone`)."""

    def __init__(self, spark: SparkSession, path: str, complete: bool = False, slots: int = 64):
        self.path, self.complete = path.rstrip("/"), complete
        self.states = Slots(spark, f"{self.path}/states", "run_id string, uid string, rows long, media long", ["run_id"], slots)
        self.folders = Slots(spark, f"{self.path}/folders", "run_id string, info string", ["run_id"], slots)

    def take(self, batch: DataFrame, number: int) -> None:
        """batch: run_id, uid, rows, media, order, and, if there are any, gone and folder notes: rows with `folder` true,
        their path as run_id and the note's JSON as info (null: none any more)."""
        more = {c: F.lit(None).cast(kind) for c, kind in (("gone", "boolean"), ("folder", "boolean"), ("info", "string")) if c not in batch.columns}
        batch = written(batch.withColumns(more), "updates")
        last = lambda where, columns: batch.where(where).groupBy("run_id").agg(F.max_by(F.struct(*columns, "gone", F.col("order").alias("at")), "order").alias("l")).select("run_id", "l.*")
        events = []
        for table, where, columns in ((self.states, "NOT coalesce(folder, false)", ["uid", "rows", "media"]), (self.folders, "folder", ["info"])):
            new = written(last(where, columns).withColumn("uid", F.col("uid").cast("string")) if "uid" in columns else last(where, columns), "latest")
            touched = set(range(table.slots)) if self.complete else table.touched(new)
            held = table.read(number - 1, touched)
            held_now = held if self.complete else held.join(new.select("run_id"), "run_id", "left_semi")
            there = new.where("NOT coalesce(gone, false)" + (" AND info IS NOT NULL" if table is self.folders else ""))
            if table is self.states:
                found = events_of(held_now, there.select("run_id", *columns), number)
                events.append(found.join(new.select("run_id", "at"), "run_id", "left").select("run_id", "event", "ord", F.lit(None).cast("string").alias("info"), "at"))
            else:
                both = held_now.select("run_id", F.col("info").alias("_was")).join(there.select("run_id", "info"), "run_id", "full").where("NOT (info <=> _was)")
                events.append(both.join(new.select("run_id", "at"), "run_id", "left").select("run_id", F.lit("folder").alias("event"), F.lit(5).alias("ord"), "info", "at"))
            kept = held.limit(0) if self.complete else held.join(new.select("run_id"), "run_id", "left_anti")
            table.put(kept.unionByName(there.select(held.columns)), number, touched)
        found = functools.reduce(DataFrame.unionByName, events)
        found.select("run_id", "event", "ord", "info", "at", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{self.path}/events/v={number}")


def change_feed(updates: DataFrame, path: str, checkpoint: str, complete: bool = False) -> StreamingQuery:
    """Appends the change events of a stream of updates (see Feed.take) below `path`, a table for each batch."""
    return updates.writeStream.foreachBatch(lambda batch, number: Feed(batch.sparkSession, path, complete).take(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(feed: DataFrame, prefix: str) -> DataFrame:
    return feed.where(in_scope("run_id", prefix))


def handle_rewrites(points: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Points after a batch: those of rewritten and gone runs are deleted, rewritten ones' are taken from `fresh`."""
    kept = points.join(changes.where("change IN ('rewritten', 'gone')").select("run_id"), "run_id", "left_anti")
    return kept.unionByName(fresh.join(changes.where("change = 'rewritten'").select("run_id"), "run_id", "left_semi"))


class ListedPoints:
    """Points kept in step with a stream of listings: a batch is all that is there, as rows of run states (run_id, uid,
    rows, media) and the points' own columns. Rewritten runs are replaced, gone ones go, others keep what they have; new
    ones come with their own rows, or from the listing with `add_new`. Points lie in partitions of their runs, and only
    those of runs that come, go or were rewritten are written again; the others' files stay as they are."""

    def __init__(self, spark: SparkSession, path: str, columns: str, add_new: bool = False, slots: int = 64):
        """columns: those of the points, as DDL."""
        self.add_new = add_new
        self.points = Slots(spark, f"{path.rstrip('/')}/points", f"run_id string, {columns}", ["run_id"], slots)
        self.runs = Slots(spark, f"{path.rstrip('/')}/runs", "run_id string, uid string, rows long, media long", ["run_id"], slots)

    def at(self, version: int) -> DataFrame:
        return self.points.read(version)

    def take(self, listing: DataFrame, batch: int) -> None:
        listing = written(listing, "listing")
        listed = listing.select("run_id", F.col("uid").cast("string").alias("uid"), F.col("rows").cast("long").alias("rows"), F.col("media").cast("long").alias("media")).distinct()
        changes = written(diff_snapshots(self.runs.read(batch - 1), listed).where("change <> 'unchanged'"), "changes")
        moved = changes.where("change <> 'changed'").where(F.lit(self.add_new or not batch) | (F.col("change") != "new"))
        touched = self.points.touched(moved)
        fresh = listing.join(moved.where("change = 'new'").select("run_id"), "run_id", "left_semi")
        held = self.points.read(batch - 1, touched)
        self.points.put(handle_rewrites(held, moved, listing.select(held.columns)).unionByName(fresh.select(held.columns)), batch, touched)
        touched = self.runs.touched(changes)
        self.runs.put(listed, batch, touched)
        self.version = batch


def follow_listings(listings: DataFrame, store: ListedPoints, checkpoint: str) -> StreamingQuery:
    """Keeps the store in step with what has been listed by now; all new files are one listing."""
    return listings.writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_streams(members: list[tuple[str, DataFrame]]) -> DataFrame:
    """Member streams as one, run ids under the member's name."""
    return functools.reduce(DataFrame.unionByName, (df.withColumns({"dir": F.lit(name), "run_id": F.concat(F.lit(name + "/"), F.col("run_id"))}) for name, df in members))


class ClaimStore:
    """Which member of a workspace holds a path: members in the order in which they came. The first has the bare id, a
    later one `path<member>`; one that no longer has the run gives its claim up. The claims lie in partitions of their
    paths, of which a batch reads and writes those it touches; what it tells is the table `path`/told/v=<batch>. A path's
    rows in one batch are folded as one list."""

    def __init__(self, spark: SparkSession, path: str, order: list[str], slots: int = 64):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order
        self.owners = Slots(spark, f"{self.path}/owners", "path string, owners array<string>", ["path"], slots)

    def take(self, batch: DataFrame, version: int) -> None:
        """batch: path, dir, at, gone and data."""
        member = F.array_position(F.array(*map(F.lit, self.order)), F.col("dir"))
        told = written(batch.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", member.alias("member"), "gone", "dir", "data"))).alias("rows")), "claims")
        touched = self.owners.touched(told)
        held = self.owners.read(version - 1, touched)
        start = F.struct(F.coalesce("owners", F.array().cast("array<string>")).alias("owners"), F.array().cast("array<struct<run_id:string,dir:string,at:bigint,gone:boolean,data:string>>").alias("told"))

        def step(acc, r):
            now = F.when(~r["gone"] & ~F.array_contains(acc["owners"], r["dir"]), F.array_append(acc["owners"], r["dir"])).otherwise(acc["owners"])
            bare = ~F.array_contains(now, r["dir"]) | (F.get(now, F.lit(0)) == r["dir"])
            run = F.when(bare, F.col("path")).otherwise(F.concat("path", F.lit("<"), r["dir"], F.lit(">")))
            one = F.struct(run.alias("run_id"), r["dir"].alias("dir"), r["at"].alias("at"), r["gone"].alias("gone"), r["data"].alias("data"))
            return F.struct(F.when(r["gone"], F.array_remove(now, r["dir"])).otherwise(now).alias("owners"), F.array_append(acc["told"], one).alias("told"))

        folded = written(join_groups(told, held, ["path"], "left").select("path", F.aggregate("rows", start, step).alias("f")), "claims-folded")
        folded.select("path", F.explode("f.told").alias("t")).select("t.run_id", "t.dir", "path", "t.at", "t.gone", "t.data").write.mode("overwrite").parquet(f"{self.path}/told/v={version}")
        left = join_groups(held, told.select("path"), ["path"], "left_anti").unionByName(folded.select("path", F.col("f.owners").alias("owners")).where("size(owners) > 0"))
        self.owners.put(left, version, touched)
        self.version = version

    def told(self) -> DataFrame:
        """(run_id, dir, path, at, gone, data) of all batches."""
        return self.spark.read.schema("run_id string, dir string, path string, at long, gone boolean, data string").parquet(*(f"{self.path}/told/v={v}" for v in range(self.version + 1)))


def claim_streams(members: list[tuple[str, DataFrame]], store: ClaimStore, checkpoint: str) -> StreamingQuery:
    """Member streams as one tree in the store, where a path that several members hold is the bare id for the first that
    came (in the store's order of members within a batch's moment) and `path<member>` for the others. members: name and
    stream of run_id, at (order in time), gone (the member has the run no more) and data."""
    every = functools.reduce(DataFrame.unionByName, (df.select(F.col("run_id").alias("path"), F.lit(name).alias("dir"), F.col("at").cast("long").alias("at"), F.coalesce("gone", F.lit(False)).alias("gone"), "data") for name, df in members))
    return every.writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class JournalStore:
    """The state of op logs that a stream follows: records (log, journal, epoch, table, pk, value, offset), in partitions of
    their logs. A record of a newer epoch discards all that its log's earlier journal left, also what came in earlier
    batches; records of an older epoch that come late are left out."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 64):
        self.rows = Slots(spark, path, "log string, journal string, epoch long, `table` string, pk string, value string, offset long", ["log"], slots)

    def take(self, ops: DataFrame, version: int) -> None:
        ops = ops.select("log", "journal", F.col("epoch").cast("long").alias("epoch"), "table", "pk", "value", F.col("offset").cast("long").alias("offset")).persist()
        touched = self.rows.touched(ops)
        every = self.rows.read(version - 1, touched).unionByName(ops)
        now = every.join(every.groupBy("log").agg(F.max("epoch").alias("epoch")), ["log", "epoch"])
        last = now.groupBy("log", "journal", "epoch", "table", "pk").agg(F.max_by("value", "offset").alias("value"), F.max("offset").alias("offset"))
        self.rows.put(last.select("log", "journal", "epoch", "table", "pk", "value", "offset"), version, touched)
        ops.unpersist()
        self.version = version

    def at(self, version: int) -> DataFrame:
        """What replaying all records so far leaves. Deleted rows are kept as nulls, so that a late record can't undo it."""
        return self.rows.read(version).where("value IS NOT NULL").select("log", "journal", "table", "pk", "value")
