"""Shards of near equal bytes by sampled splitters, with DataFrame functions only.

Records are ordered by the hash of their text, so equal texts lie side by side. A size-weighted sample of keys gives
quantile boundaries, records fall into the ranges between them, and ranges that turn out overfull are sampled again and
subdivided: between texts, or inside one only if it fills a range of its own and still is too much. Exact loads of the
ranges give every record's place in the order of all bytes, and with it its shard and slot.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import text_or_empty, written

CELLS = 12  # bits of the key by which records find the few boundaries near them
KEY = ("key", "doc", "uid")
LOWEST = -(1 << 63)


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of a bounded number of rows that the driver holds, made without Python on the executors."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
    return spark.range(0, 1, 1, 1).select(F.explode(parsed).alias("r")).select("r.*")


def uniform(*seed) -> F.Column:
    """A number in [0, 1) that depends on the row alone."""
    return F.shiftrightunsigned(F.xxhash64(*seed), 11) / F.lit(float(1 << 53))


def ranged(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Adds `range`: how many boundaries are at or below the record's key. Each cell of keys knows its own boundaries."""
    cells: dict[int, dict] = {}
    for cell in range(1 << CELLS):
        cells[cell] = {"cell": cell, "before": 0, "near": []}
    for b in bounds:
        cells[(b[0] >> (64 - CELLS)) + (1 << CELLS - 1)]["near"].append(dict(zip(KEY, b, strict=True)))
    seen = 0
    for cell in cells.values():
        cell["before"] = seen
        seen += len(cell["near"])
    table = small_table(rows.sparkSession, list(cells.values()), "cell int, before int, near array<struct<key:long,doc:long,uid:long>>")
    own = F.struct(*KEY)
    cell = (F.shiftright("key", 64 - CELLS) + (1 << CELLS - 1)).cast("int")
    return rows.withColumn("cell", cell).join(F.broadcast(table), "cell").withColumn("range", F.col("before") + F.size(F.filter("near", lambda b: b <= own))).drop("cell", "before", "near")


def quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Up to parts - 1 keys that cut the weighted sample into equal parts. sample: (key..., weight), sorted."""
    total, seen, out = sum(s[-1] for s in sample), 0.0, []
    for s in sample:
        if len(out) < parts - 1 and seen >= total * (len(out) + 1) / parts and (not out or s[:-1] > out[-1]):
            out.append(s[:-1])
        seen += s[-1]
    return out


def finer(sample: list[tuple], parts: int, alone: bool) -> set[tuple]:
    """Boundaries inside an overfull range: before texts, and after one that takes more than one part; between records of
    one text only where the range holds no other (`alone`)."""
    cuts = quantiles(sample, parts)
    if alone:
        return set(cuts)
    keys = [c[0] for c in cuts]
    wide = {k for k in keys if keys.count(k) > 1 and k < (1 << 63) - 1}
    return {(k, LOWEST, LOWEST) for k in keys} | {(k + 1, LOWEST, LOWEST) for k in wide}


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, ranges_a_shard: int = 64, draws: int = 16, whole: float = 0.1) -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes of the text plus `overhead`), text_crc32, shard, slot.

    Equal texts share a shard unless they hold more than `whole` of one; a larger group is cut where the shard is full. So
    shards differ in bytes by that share or by two large documents. Slots count from 0 in each shard without gaps. A null
    text is an empty one, a null doc_id sorts first, repeated rows are records of their own (ties go by their place in
    the input), an empty table gives no rows, other columns are left out. What reaches the driver depends on the
    parameters alone: ranges_a_shard * shards ranges, `draws` times as many sampled keys, and as many again for ranges
    that hold over three times the mean.
    """
    spark, text = docs.sparkSession, text_or_empty()
    rows = written(docs.select("doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), F.monotonically_increasing_id().alias("uid")), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = ranges_a_shard * shards

    def drawn(part: DataFrame, wanted: Column, load: Column, seed: int) -> DataFrame:
        """Records drawn with a chance in proportion to their size, `wanted` on average for `load` bytes; weights make up for sizes beyond a chance of 1."""
        share = load / wanted
        return part.where(uniform("uid", F.lit(seed)) < F.col("size") / share).withColumn("weight", F.greatest(F.col("size").cast("double"), share))

    sample = drawn(rows, F.lit(float(draws * ranges)), F.lit(float(max(total, 1))), 0).select(*KEY, "weight")
    bounds = sorted({(b[0], LOWEST, LOWEST) for b in quantiles(sorted(map(tuple, sample.collect())), ranges)})
    cut, idle, seed = set(), 0, 0  # texts that lie in several ranges; rounds without a new boundary
    while True:
        dealt = ranged(rows, bounds)
        loads = {r["range"]: r for r in dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high")).collect()}
        parts = {k: max(2 * r["bytes"] * ranges // max(total, 1), 2 * r["n"] * ranges // max(n, 1)) for k, r in loads.items()}
        over = [{"range": k, "bytes": float(r["bytes"]), "parts": parts[k]} for k, r in loads.items() if parts[k] >= 6 and r["low"] != r["high"]]
        if not over or idle == 3:
            break
        seed += 1
        again = dealt.join(F.broadcast(small_table(spark, over, "range int, bytes double, parts int")), "range")
        more: dict[int, list] = {}
        for *key, weight, k in drawn(again, F.col("parts") * float(draws), F.col("bytes"), seed).select(*KEY, "weight", "range").collect():
            more.setdefault(k, []).append((*key, weight))
        alone = {k: loads[k]["low"]["key"] == loads[k]["high"]["key"] for k in more}
        cut |= {loads[k]["low"]["key"] for k in more if alone[k]}
        now = sorted(set(bounds).union(*(finer(sorted(s), parts[k], alone[k]) for k, s in more.items())))
        idle, bounds = (idle + 1 if now == bounds else 0), now
    before, prefix, groups = 0, [], {}
    for k in sorted(loads):
        key = loads[k]["low"]["key"]
        prefix.append({"range": k, "start": before} | ({"cut": key} if key in cut else {}))
        if key in cut:
            first, size = groups.get(key, (before, 0))
            groups[key] = first, size + loads[k]["bytes"]
        before += loads[k]["bytes"]
    for x in prefix:  # a text that was cut has its ranges to itself
        if "cut" in x:
            x["of_start"], x["of_bytes"] = groups[x.pop("cut")]
    of_range, of_group = Window.partitionBy("range").orderBy(*KEY), Window.partitionBy("range", "key")
    at = F.coalesce(F.sum("size").over(of_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        dealt.withColumn("at", at)
        .withColumns({"group_at": F.min("at").over(of_group), "group_bytes": F.sum("size").over(of_group)})
        .join(F.broadcast(small_table(spark, prefix, "range int, start long, of_start long, of_bytes long")), "range")
        .withColumns({"group_at": F.coalesce("of_start", F.col("start") + F.col("group_at")), "group_bytes": F.coalesce("of_bytes", "group_bytes")})
        .withColumn("middle", F.when(F.col("group_bytes") * shards <= F.lit(whole * total), F.col("group_at") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("at") + F.col("size") / 2))
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEY)) - 1)
        .select("doc_id", "size", "text_crc32", "range", "shard", "nth")
    )
    placed = written(placed, "placed")
    counts = placed.groupBy("range", "shard").count()  # a range meets one or two shards
    first = counts.withColumn("first", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    out = placed.join(F.broadcast(first), ["range", "shard"]).withColumn("slot", F.col("first") + F.col("nth"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
