"""Sources and sinks: rows and points, ingest, discovery, notes, logs, media, compaction, replicas."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tideline.functions.values import to_marker
from tideline.plans.shared import dealt, in_order, latest, ranks, running, written


def read_rows(rows: DataFrame, keys: list[str] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows [start, stop) of each run, values restricted to `keys`; rows without any of them keep their place."""
    out = rows.where((F.col("seq") >= start) & (F.col("seq") < stop if stop is not None else F.lit(True)))
    return out.withColumn("values", F.map_filter("values", lambda k, v: k.isin(*keys))) if keys else out


def rows_to_points(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", "seq", "step", "t", F.explode("values").alias("key", "value"))


def points_to_rows(points: DataFrame, count: int | None = None) -> DataFrame:
    """One row per (run, seq) with the map of its values; a metric that a row lacks isn't in its map. Of several points of
    one metric in a row the largest stays. count: a bound of the number of points, where one is known; they are counted
    otherwise, as the number of tasks follows it."""
    spread = dealt(points, points.count() if count is None else count, "run_id", "seq")
    once = spread.groupBy("run_id", "seq", "step", "t", "key").agg(F.max("value").alias("value"))
    return once.groupBy("run_id", "seq", "step", "t").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("values"))


def points(rows: DataFrame, keys: list[str], start: int = 0, stop: int | None = None, step_lo: float | None = None, step_hi: float | None = None) -> DataFrame:
    """The points of some metrics in a window of rows and steps."""
    near = rows.where((F.col("step") >= step_lo if step_lo is not None else F.lit(True)) & (F.col("step") <= step_hi if step_hi is not None else F.lit(True)))
    return rows_to_points(read_rows(near, keys, start, stop))


def contiguous_rows(rows: DataFrame) -> DataFrame:
    """Each run's rows up to the first gap in seq, which begins at 0."""
    first = ranks(rows.select("run_id", "seq"), ["run_id"], "seq").where("rn - 1 <> seq").groupBy("run_id").agg(F.min("seq").alias("_bad"))
    return rows.join(first, "run_id", "left").where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")


def ingest_log(logs: DataFrame, column: str = "json") -> DataFrame:
    """Values of logged JSON objects: nested keys joined by `/` to any depth, booleans as 0 and 1, numbers kept, anything
    else and rows without a number dropped. logs: run_id, order and the JSON text. The objects of each level are written
    and counted, until none is left. Where two values come to one key, as in {"a/b": 1, "a": {"b": 2}}, the later one in
    the document counts."""
    level, done = logs.select("run_id", "order", F.lit(None).cast("string").alias("key"), F.array().cast("array<int>").alias("place"), F.col(column).alias("text")), []
    while not done or level.count():
        read = level.select("run_id", "order", "key", "place", F.from_json("text", "map<string,variant>").alias("v"), F.from_json("text", "map<string,string>").alias("s"))  # both in the text's order
        each = read.select("run_id", "order", "key", "place", F.posexplode(F.arrays_zip(F.map_keys("v").alias("k"), F.map_values("v").alias("v"), F.map_values("s").alias("s"))).alias("pos", "e"))
        level = each.select("run_id", "order", F.concat_ws("/", "key", "e.k").alias("key"), F.array_append("place", F.col("pos")).alias("place"), F.col("e.v").alias("v"), F.col("e.s").alias("text"))
        kind = F.schema_of_variant("v")
        value = F.when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("v", "$", "double"))
        done.append(level.withColumn("value", value).where("value IS NOT NULL").drop("v", "text"))
        level = written(level.where(kind.startswith("OBJECT")).drop("v"), "log-level")
    leaves = functools.reduce(DataFrame.unionByName, done).groupBy("run_id", "order", "key").agg(F.max_by("value", "place").alias("value"))
    return leaves.groupBy("run_id", "order").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("values"))


def assign_steps(logged: DataFrame, before: Column | float = -1.0) -> DataFrame:
    """A row without a step takes the one before it plus 1; `before` is the step that the run ended on. logged: run_id,
    order, step."""
    placed = running(in_order(logged, ["run_id"], "order"), ["run_id"], F.lit(1)).withColumnRenamed("_sum", "_rn")
    known = latest(placed, ["run_id"], F.when(F.col("step").isNotNull(), F.struct("step", "_rn")))
    base = F.coalesce("_latest.step", before if isinstance(before, Column) else F.lit(before))
    return known.withColumn("step", base + F.col("_rn") - F.coalesce("_latest._rn", F.lit(0))).drop("_latest", "_rn", "_part", "_at")


def upsert_runs(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Runs that go on: id and created stay; name, state and heartbeat are set; tags stay if the new ones are empty; a
    given config replaces; info is merged per top-level key."""
    b, n = base.alias("b"), incoming.alias("n")
    new = F.col("n.run_id").isNotNull()
    pick = lambda c: F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    info = F.map_concat(F.map_filter(F.coalesce("b.info", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("n.info", k), F.lit(False))), F.coalesce("n.info", F.create_map().cast("map<string,string>")))
    return b.join(n, F.col("b.run_id") == F.col("n.run_id"), "full").select(
        F.coalesce("b.run_id", "n.run_id").alias("run_id"), F.coalesce("b.created", "n.created").alias("created"), *map(pick, ("name", "state", "heartbeat")),
        F.when(F.size(F.coalesce("n.tags", F.array().cast("array<string>"))) > 0, F.col("n.tags")).otherwise(F.coalesce("b.tags", "n.tags")).alias("tags"), F.coalesce("n.config", "b.config").alias("config"), info.alias("info"),
    )


def merge_notes(notes: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The last write of each key wins. notes: by, key, value, order."""
    return notes.groupBy(*by, "key").agg(F.max_by("value", "order").alias("value"))


def discover(paths: DataFrame, marker: str = "run.parquet") -> DataFrame:
    """Run ids: folders that hold the marker file, none inside another run, skipping hidden and tool folders."""
    runs = paths.where(F.element_at(F.split("path", "/"), -1) == marker).select(F.regexp_replace("path", "/?[^/]*$", "").alias("run_id"))
    runs = runs.where(~F.col("run_id").rlike(r"(^|/)(\.[^/]*|node_modules|__pycache__)(/|$)")).distinct()
    parts = F.split("run_id", "/")
    above = runs.select("run_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up")).where("up <> run_id")
    inside = above.join(runs.select(F.col("run_id").alias("up")), "up", "left_semi").select("run_id").distinct()
    return runs.join(inside, "run_id", "left_anti")


def read_folder_notes(spark: SparkSession, root: str, name: str = "notes.json", held: DataFrame | None = None) -> DataFrame:
    """(path, info) of the JSON document in each folder; one that is no object becomes {"value": x}; one that can't be
    read keeps what was held, or is left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", "true").text(root)
    return parse_notes(raw.select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/"), "/[^/]*$", "").alias("path"), F.col("value").alias("text")), held)


def parse_notes(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    v = F.try_parse_json("text")
    info = F.when(v.isNotNull() & ~F.schema_of_variant(v).startswith("OBJECT"), F.try_parse_json(F.concat(F.lit('{"value": '), F.to_json(v), F.lit("}")))).otherwise(v)
    new = docs.select("path", info.alias("info"))
    if held is not None:
        new = new.join(held.select("path", F.col("info").alias("_held")), "path", "left").select("path", F.coalesce("info", "_held").alias("info"))
    return new.where("info IS NOT NULL")


def merge_folder_notes(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Folders' documents (path, info) with keys written to them: the last write of each key replaces what the document
    had, other keys stay; a folder without a document gets one. incoming: path, key, value (JSON text), order. A value
    that is no JSON is kept as a text."""
    held = base.select("path", F.explode(F.from_json(F.to_json("info"), "map<string,variant>")).alias("key", "value"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    json = F.when(F.col("value").isNull(), "null").when(F.try_parse_json("value").isNull(), quoted("value")).otherwise(F.col("value"))
    old = held.select("path", "key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"), F.lit(-(1 << 63)).alias("order"))
    both = old.unionByName(incoming.select("path", "key", json.alias("value"), F.col("order").cast("long").alias("order")))
    merged = merge_notes(both, ("path",)).withColumn("_entry", F.concat(quoted("key"), F.lit(":"), F.col("value")))
    made = merged.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("_entry")), ",").alias("_all"))  # a document's keys
    every = base.select("path").unionByName(incoming.select("path")).distinct().join(made, "path", "left")
    return every.select("path", F.parse_json(F.concat(F.lit("{"), F.coalesce("_all", F.lit("")), F.lit("}"))).alias("info"))


def replay_ops(ops: DataFrame) -> DataFrame:
    """The state after records (table, pk, value, offset) in order: a later one replaces an earlier one; a null value
    deletes."""
    return ops.groupBy("table", "pk").agg(F.max_by("value", "offset").alias("value")).where("value IS NOT NULL")


def replay_journals(ops: DataFrame) -> DataFrame:
    """The state of logs that may have been begun anew: records (log, journal, epoch, table, pk, value, offset), where a
    journal is one writing of a log and `epoch` rises with each. Only the newest journal of a log counts, whatever the
    earlier ones held; within it a later record replaces an earlier one and a null value deletes."""
    newest = ops.groupBy("log").agg(F.max("epoch").alias("epoch"))
    now = ops.join(newest, ["log", "epoch"])
    return now.groupBy("log", "journal", "table", "pk").agg(F.max_by("value", "offset").alias("value")).where("value IS NOT NULL")


def valid_prefix(records: DataFrame) -> DataFrame:
    """Each log's records before the first whose checksum or length is wrong. records: log, offset, size, crc, payload."""
    bad = records.where((F.crc32("payload") != F.col("crc")) | (F.octet_length("payload") != F.col("size"))).groupBy("log").agg(F.min("offset").alias("_bad"))
    return records.join(bad, "log", "left").where(F.col("_bad").isNull() | (F.col("offset") < F.col("_bad"))).drop("_bad")


def sniff(content: Column | str) -> Column:
    """The image type that leading bytes show, null for none. The signatures are fixed values; an SVG begins, after white
    space of any length, with `<svg` or `<?xml`."""
    head = F.hex(F.substring(content, 1, 12)) if isinstance(content, str) else F.hex(F.substr(content, F.lit(1), F.lit(12)))
    text = (F.col(content) if isinstance(content, str) else content).cast("string")
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(text.rlike(r"\A[ \t\n\r\x0B\f]*+<(svg|\?xml)"), "svg")


def catalog_media(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media numbered per run, named by the digest of their content, and the distinct contents. items: run_id, order, step,
    t, key, kind, ext, content."""
    named = items.withColumn("file", F.concat(F.sha2("content", 256), F.lit("."), "ext"))
    listed = named.select("run_id", "order", "step", "t", "key", "kind", "file", F.octet_length("content").cast("long").alias("size"))
    catalog = ranks(listed, ["run_id"], "order").select("run_id", (F.col("rn") - 1).cast("int").alias("seq"), "step", "t", "key", "kind", "file", "size")
    return catalog, named.groupBy("file").agg(F.first("content").alias("content"))


def visible_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """Each run's items up to the first gap in seq or missing file."""
    there = media.join(files.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left")
    bad = ranks(there.select("run_id", "seq", "_there"), ["run_id"], "seq").where("rn - 1 <> seq OR _there IS NULL").groupBy("run_id").agg(F.min("seq").alias("_bad"))
    return there.join(bad, "run_id", "left").where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).select(media.columns)


def printable(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns for output, sorted by name if none are chosen; non-finite numbers become their markers."""
    kinds = dict(df.dtypes)
    show = lambda c: F.coalesce(to_marker(c), F.col(c).cast("string")).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(*map(show, columns or sorted(df.columns)))


def write_out(df: DataFrame, path: str, fmt: str = "json", columns: list[str] | None = None) -> None:
    """json or jsonl (a document a line), csv or tsv with a header."""
    out = printable(df, columns).write.mode("overwrite")
    if fmt in ("json", "jsonl"):
        out.json(path)
    else:
        out.csv(path, sep="\t" if fmt == "tsv" else ",", header=True)


def compact(rows: DataFrame, out: str, most: int = 65535, most_bytes: int = 8 << 20) -> DataFrame:
    """Rows written anew in order, in files of at most `most` rows and as many as `most_bytes` hold of the largest row (as
    text), after a proof that nothing but the files changed. Runs that aren't contiguous are refused."""
    rows = written(rows, "rows")  # read four times from here on
    if rows.join(contiguous_rows(rows).select("run_id", "seq"), ["run_id", "seq"], "left_anti").limit(1).count():
        raise ValueError("rows are not contiguous")
    largest = rows.agg(F.max(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 1
    rows.repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq").write.option("maxRecordsPerFile", max(1, min(most, most_bytes // largest))).parquet(out)
    new = rows.sparkSession.read.schema(rows.schema).parquet(out)
    flat = lambda df, n: df.withColumn("values", F.to_json(F.map_from_entries(F.sort_array(F.map_entries("values"))))).withColumn("_times", F.lit(n))
    both = flat(rows, 1).unionByName(flat(new, -1)).groupBy(*(F.col(f"`{c}`") for c in rows.columns)).agg(F.sum("_times").alias("_times"))
    if both.where("_times <> 0").limit(1).count():
        raise ValueError("the written rows differ")
    return new


def cache_levels(pyramid: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """The buckets of finished runs kept by (key, level), each with a digest of its run's path, rows and version. Only
    partitions that hold a run whose digest changed are written again. runs: run_id, state, rows, version."""
    spark = pyramid.sparkSession
    done = runs.where("state <> 'running'").select("run_id", F.sha2(F.concat_ws("|", "run_id", "rows", "version"), 256).alias("digest"))
    now = pyramid.join(done, "run_id")
    try:
        held = spark.read.parquet(path).select(now.columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = now.limit(0)
    on = ["run_id", "key", "level", "digest"]
    stale = now.select(*on).distinct().join(held.select(*on).distinct(), on, "left_anti").unionByName(held.select(*on).distinct().join(now.select(*on).distinct(), on, "left_anti")).select("key", "level").distinct()
    again = written(now.join(stale, ["key", "level"], "left_semi"), "levels")
    again.repartition("key", "level").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key", "level").parquet(path)
    return spark.read.parquet(path).select(now.columns)


def delta_for(blocks: DataFrame, held: DataFrame, runs: DataFrame) -> DataFrame:
    """Blocks that a replica lacks: all of a run it doesn't hold or holds under another uid or rebuild, else those changed
    since, of the top levels. blocks: run_id, key, level, top, block, since; held: run_id, uid, rebuilt, compiled."""
    r = runs.select("run_id", "uid", "rebuilt")
    h = held.select("run_id", F.col("uid").alias("_uid"), F.col("rebuilt").alias("_rebuilt"), F.col("compiled").alias("_compiled"))
    kept = blocks.where(F.col("level") >= F.col("top") - 2).join(r, "run_id").join(h, "run_id", "left")
    fresh = F.col("_uid").isNull() | (F.col("_uid") != F.col("uid")) | (F.col("_rebuilt") != F.col("rebuilt"))
    return kept.where(fresh | (F.col("since") > F.col("_compiled"))).withColumn("replace", fresh).drop("_uid", "_rebuilt", "_compiled", "uid", "rebuilt")


def delta_tables(held: DataFrame, runs: DataFrame, media: DataFrame, spans: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """All that a replica lacks: `records` and `media` of runs, `spans` and `blocks` of series. Of a run that it holds, media
    from its own count on (held.media), and the spans and record only if something is new; everything of one that is new
    or was replaced. runs: run_id, uid, rebuilt, compiled and the record; held: run_id, uid, rebuilt, compiled, media."""
    h = held.select("run_id", F.col("uid").alias("_uid"), F.col("rebuilt").alias("_rebuilt"), F.col("compiled").alias("_compiled"), F.col("media").alias("_media"))
    state = runs.select("run_id", "uid", "rebuilt", "compiled").join(h, "run_id", "left")
    fresh = F.col("_uid").isNull() | (F.col("_uid") != F.col("uid")) | (F.col("_rebuilt") != F.col("rebuilt"))
    state = state.select("run_id", fresh.alias("_fresh"), "_media", (fresh | (F.col("compiled") > F.col("_compiled"))).alias("_grown"))
    items = media.join(state, "run_id").where(F.col("_fresh") | (F.col("seq") >= F.col("_media"))).select(media.columns)
    with_items = items.select("run_id").distinct().withColumn("_items", F.lit(True))
    changed = state.join(with_items, "run_id", "left").where(F.col("_grown") | F.col("_items"))
    return {"records": runs.join(changed, "run_id", "left_semi"), "media": items, "spans": spans.join(state.where("_grown"), "run_id", "left_semi"), "blocks": delta_for(blocks, held, runs)}


def apply_delta(replica: DataFrame, delta: DataFrame) -> DataFrame:
    """The replica with a delta: runs to replace go first, equal blocks are overwritten, levels below the kept ones drop."""
    on = ["run_id", "key", "level", "block"]
    whole = delta.where("replace").select("run_id").distinct()
    kept = replica.join(whole, "run_id", "left_anti").join(delta.select(*on), on, "left_anti")
    out = kept.unionByName(delta.select(*kept.columns))
    top = out.groupBy("run_id", "key").agg(F.max("top").alias("_top"))
    return out.join(top, ["run_id", "key"]).where(F.col("level") >= F.col("_top") - 2).withColumn("top", F.col("_top")).drop("_top")
