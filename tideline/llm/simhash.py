"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a variant in common that is within r bits of both. Every distinct
fingerprint emits all its variants within r bits; fingerprints that meet at a variant are linked.

The shuffle is on variants, but doesn't send each of them: they are dealt out by the values of a few chosen bits, a cell,
so a variant's cell is a function of the variant and all equal variants meet in it. A fingerprint is sent once to each
cell that one of its variants lies in, and its variants there are made by the receiver, so about a hundred rows are
shuffled for two thousand variants. Fingerprints that collide at one variant are linked to the least of them only, so no
pairs within a group are spelled out; each such pair is verified by its distance.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import aside, back, chunks, flat, join_spread, ragged, text_or_empty, written
from tideline.llm.components import components, roots
from tideline.llm.text_stats import word_bounds

MOST = 1 << 21  # variants held at once


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    buf, offsets = flat(texts)
    buf = buf + 32 * ((buf >= 0x41) & (buf <= 0x5A)).astype(np.uint8)
    starts, ends = word_bounds(buf, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out.view(np.int64)
    at = np.searchsorted(starts, offsets)
    size = ends - starts
    joined = np.append(buf, np.uint8(0x20))[ragged(starts, size + 1)]
    new_end = np.cumsum(size + 1) - 1
    joined[new_end] = 0x20
    new_start = new_end - size
    words = np.diff(at)
    count = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    first = ragged(at[:-1], count)
    last = first + np.repeat(np.minimum(shingle, words), count) - 1
    raw, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[s:e], seed) for s, e in zip(new_start[first].tolist(), new_end[last].tolist(), strict=True)], np.uint64)
    full = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[full]
    for i in range(0, len(full), 256):  # a bit matrix for some hundred texts at a time
        stop = begin[i + 256] if i + 256 < len(full) else len(hashes)
        bits = np.unpackbits(hashes[begin[i] : stop].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, begin[i : i + 256] - begin[i], axis=0, dtype=np.int64)
        own = full[i : i + 256]
        out[own] = np.packbits(2 * ones > count[own, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def fingerprint_batches(batches: Iterator[pa.RecordBatch], keep: list[str], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in chunks(whole, "text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fingerprints(b.column("text"), shingle, seed))], [*keep, "fp"])


@functools.cache
def flips(places: tuple[int, ...], most: int) -> np.ndarray:
    """All masks with at most `most` of the bits at `places`."""
    return np.array([sum(1 << p for p in c) for k in range(most + 1) for c in itertools.combinations(places, k)], np.uint64)


def meet(fps: np.ndarray, left: np.ndarray, free: tuple[int, ...], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints whose other bits are set to the variants' already, with `left` flips left over the bits
    `free`. Too many variants at once are halved by the value of one more bit."""
    masks = [flips(free, k) for k in range(int(left.max(initial=0)) + 1)]
    made = sum(int((left == k).sum()) * len(m) for k, m in enumerate(masks))
    if made > MOST and len(free) > 1 and len(fps) > 1:
        bit = np.uint64(1 << free[0])
        value, source = fps
        for want in (np.uint64(0), bit):
            rest = left - ((value & bit) != want)
            own = rest >= 0
            yield from meet(np.stack(((value[own] & ~bit) | want, source[own])), rest[own], free[1:], distance)
        return
    value = np.concatenate([(fps[0][left == k][:, None] ^ m).ravel() for k, m in enumerate(masks)])
    source = np.concatenate([np.repeat(fps[1][left == k], len(m)) for k, m in enumerate(masks)])
    order = np.argsort(value)
    value, source = value[order], source[order]
    same = value[1:] == value[:-1]
    if same.any():
        run = np.concatenate(([0], np.cumsum(~same)))
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.minimum.reduceat(source, begin)[run]
        near = (source != least) & (np.bitwise_count(source ^ least) <= distance)
        yield source[near], least[near]


def linked(batches: Iterator[pa.RecordBatch], places: tuple[int, ...], radius: int) -> Iterator[pa.RecordBatch]:
    """batches: (cell, fp) with all fingerprints of a cell one after the other. Gives links (a, b), reduced per task portion."""
    bits = sum(1 << p for p in places)
    free = tuple(p for p in range(64) if not bits >> p & 1)
    full = len(flips(free, radius))

    def work(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        spread = np.zeros(len(cell), np.uint64)
        for k, p in enumerate(places):
            spread |= (cell.astype(np.uint64) >> np.uint64(k) & np.uint64(1)) << np.uint64(p)
        left = radius - np.bitwise_count((fp & np.uint64(bits)) ^ spread).astype(np.int64)
        found = list(meet(np.stack(((fp & np.uint64(~bits & (1 << 64) - 1)) | spread, fp)), left, free, 2 * radius))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            node, root = roots(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root].view(np.int64)), pa.array(root[node != root].view(np.int64))], ["a", "b"])

    cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        cell = np.append(cell, b.column("cell").to_numpy().astype(np.int64))
        fp = np.append(fp, b.column("fp").to_numpy().view(np.uint64))
        while len(cell):
            # whole cells for about MOST variants, or one cell that has more; the last cell may go on in the next batch
            if (close := 16 * max(1, MOST // full)) >= len(cell):
                break
            end = int(np.searchsorted(cell, cell[close], "left")) or int(np.searchsorted(cell, cell[close], "right"))
            if end >= len(cell):
                break
            yield from work(cell[:end], fp[:end])
            cell, fp = cell[end:], fp[end:]
    if len(cell):
        yield from work(cell, fp)


def link_fingerprints(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within `distance` bits (an even number).
    distinct: `fp`, each once."""
    radius = distance // 2
    ones = distinct.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftright("fp", p).bitwiseAND(F.lit(1))).alias(f"b{p}") for p in range(64))).first()
    n = ones["n"]
    many = min(20, max(6, (max(n, 1) // 64).bit_length()))
    places = tuple(sorted(sorted(range(64), key=lambda p: (abs(2 * (ones[f"b{p}"] or 0) - n), p))[:many]))  # the most even bits
    cell = F.lit(0).cast("long")
    for k, p in enumerate(places):
        cell = cell.bitwiseOR(F.shiftleft(F.shiftright("fp", p).bitwiseAND(F.lit(1)), k))
    near = [int(m) for m in flips(tuple(range(many)), radius)]
    sent = distinct.select("fp", cell.cast("int").alias("own")).select(F.explode(F.transform(F.lit(near), lambda m: F.col("own").bitwiseXOR(m))).alias("cell"), "fp")
    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: linked(batches, places, radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """docs' columns but the text, with fp (the fingerprint as a long) and component_id (smallest doc_id reachable).

    A null or empty text has fingerprint zero and is linked like any other; under `shingle` words make one shingle.
    Repeated rows and copies share a fingerprint, are linked as one and each get the component. A null doc_id is never
    the smallest; a component of nulls alone has a null id. An empty table gives no rows; columns named fp or
    component_id are replaced.
    """
    kept = docs.drop("fp", "component_id")
    work = aside(kept, "text")
    schema = T.StructType([work.schema["row"], T.StructField("fp", T.LongType())])
    marked = written(work.mapInArrow(lambda batches: fingerprint_batches(batches, ["row"], shingle, seed), schema), "fingerprints")
    marked = marked.withColumn("doc_id", F.col("row").getField("doc_id"))
    found = join_spread(marked, by_fingerprint(marked.select("doc_id", "fp"), distance), "fp", ["doc_id"])
    return found.select(*back(found, [c for c in kept.columns if c != "text"]), "fp", "component_id")


def by_fingerprint(marked: DataFrame, distance: int) -> DataFrame:
    """For each fingerprint of marked (doc_id, fp): how many rows have it, the least fingerprint it reaches (root) and that
    component's least doc_id."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    found = components(link_fingerprints(distinct.select("fp"), distance))
    rooted = written(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.col("rows").alias("copies"), F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows")), "component-ids")
    return written(join_spread(rooted, least, "root", ["fp"]).select("fp", "root", "component_id", F.col("copies").alias("rows")), "fingerprint-components")


def keep_one(docs: DataFrame, shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id (a null one is the largest; of rows that share
    it that of the least hash, of repeated rows one), with docs' columns. Texts are shuffled once, by two hashes of doc_id
    and text; what is kept grows with the input, so it is never broadcast; rows that make up a
    thousandth of the table and are equal are reduced where they are read. An empty table gives none."""
    work = aside(docs, "text")
    doc_id, text = F.col("row").getField("doc_id"), text_or_empty()
    keys = [F.xxhash64(doc_id, text, doc_id.isNull()).alias("key"), F.xxhash64(text, doc_id).alias("check")]  # 128 bits
    keyed = work.select("row", "text", *keys)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("key", "check", "fp"))])
    narrow = keyed.select(doc_id.alias("doc_id"), "key", "check", "text")
    ids = written(narrow.mapInArrow(lambda batches: fingerprint_batches(batches, ["doc_id", "key", "check"], shingle, seed), schema), "fingerprints")
    best = ids.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "check")).alias("best"))  # a row a fingerprint
    best = best.join(by_fingerprint(ids, distance).select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = best.select("best.key", "best.check")
    twins = ids.groupBy("key", "check").agg(F.count(F.lit(1)).alias("rows"))  # rows that are equal in doc_id and text
    kept = written(twins.join(kept, ["key", "check"]), "kept-rows")
    total = ids.count()
    hot = kept.where(F.col("rows") >= max(2, total // 1000)).select("key", "check")  # a thousand or so
    one = keyed.join(F.broadcast(hot), ["key", "check"], "left_semi").groupBy("key", "check").agg(F.first(F.struct("row", "text")).alias("one")).select("one.*")  # one a task is sent
    met = keyed.join(F.broadcast(hot), ["key", "check"], "left_anti").join(kept.hint("merge"), ["key", "check"], "left_semi")
    once = met.withColumn("nth", F.row_number().over(Window.partitionBy("key", "check").orderBy("key"))).where("nth = 1")
    every = once.select("row", "text").unionByName(one)
    return every.select(*back(every, docs.columns, "text"))
