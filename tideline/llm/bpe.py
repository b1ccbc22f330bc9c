"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark tasks.

Each task cuts its texts into words, and its own DuckDB merges the distinct ones: rows (word, position, token) join the
table of merges, each word's leftmost pair of minimum rank is contracted, and the recursion goes on with the words that
still changed. Aggregation ordered by position gives the bytes that a text's ids stand for.

A word is a row of stretches, each of twice the longest token's bytes or more; a usual one has a single stretch. Whatever keeps a
pair from merging lies in one token with one of its halves in the end, and begins with a pair of lower rank in the same
stretch or one beside it. So the pairs that have the least rank of their three stretches are contracted in the same step, of
overlapping equal ones every other from the left, and a word of any length takes about as many steps as a usual one.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.llm.common import binary_array, chunks, flat, ragged
from tideline.llm.pretokens import word_starts

#: A token's `spot` is its word's number and its first byte's place there, in the upper and lower half of one number.
#: `before` is the overlapping pair of equal rank on a pair's left; a pair that has one belongs to a row of such pairs, and
#: waits if that one isn't among the least.
MERGE = """
WITH RECURSIVE step AS (
    SELECT spot, id, size, 0 AS n FROM start
    UNION ALL
    (WITH live AS (SELECT * FROM step WHERE n < {steps}),
    pairs AS (
        SELECT l.spot, r.spot AS next, r.size, m.rank, l.spot >> {bits} AS stretch
        FROM live l JOIN live r ON r.spot = l.spot + l.size JOIN merges m ON m.pair = (l.id::BIGINT << 32 | r.id)),
    lowest AS (SELECT stretch, min(rank) AS rank FROM pairs GROUP BY stretch),
    around AS (SELECT stretch + d AS stretch, min(rank) AS rank FROM lowest, (VALUES (-1), (0), (1)) t(d) GROUP BY stretch + d),
    least AS (SELECT pairs.* FROM pairs JOIN around USING (stretch, rank)),
    linked AS (SELECT l.*, p.spot AS before FROM least l LEFT JOIN pairs p ON p.next = l.spot AND p.rank = l.rank),
    runs AS (
        SELECT *, before IS NOT NULL AND before IS DISTINCT FROM lag(spot) OVER w AS waits, count_if(before IS NULL) OVER w AS run
        FROM linked WHERE before IS NOT NULL OR next IN (SELECT spot FROM linked WHERE before IS NOT NULL) WINDOW w AS (ORDER BY spot)),
    turns AS (SELECT *, row_number() OVER w % 2 = 1 AND count_if(waits) OVER w = 0 AS chosen FROM runs WINDOW w AS (PARTITION BY run ORDER BY spot)),
    chosen AS (SELECT spot, next, size, rank FROM linked WHERE before IS NULL UNION ALL SELECT spot, next, size, rank FROM turns WHERE chosen AND before IS NOT NULL),
    marks AS (SELECT spot, rank, size FROM chosen UNION ALL SELECT next, NULL, -1 FROM chosen)
    SELECT l.spot, coalesce(m.rank, l.id), l.size + coalesce(m.size, 0), l.n + 1
    FROM live l JOIN (SELECT DISTINCT spot >> 32 AS word FROM chosen) c ON c.word = l.spot >> 32 LEFT JOIN marks m ON m.spot = l.spot
    WHERE m.size IS DISTINCT FROM -1))
SELECT spot, id, size, step.n AS n FROM step JOIN (SELECT spot >> 32 AS word, max(n) AS n FROM step GROUP BY spot >> 32) w ON w.word = step.spot >> 32 AND w.n = step.n
"""
DECODE = """
SELECT n, list(data ORDER BY pos) AS parts
FROM (SELECT n, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) JOIN vocabulary USING (id) GROUP BY n ORDER BY n
"""


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def tables(path: str):
    """This worker's DuckDB with the vocabulary and the pairs of tokens that join into a token."""
    import duckdb

    ranks = read_ranks(path)
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})  # nothing is spilled to a machine's own folder
    a, b, rank = np.array(pairs, np.int64).T
    con.register("pairs", pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32), "rank": rank}))
    con.execute("CREATE TABLE merges AS SELECT a::BIGINT << 32 | b AS pair, rank FROM pairs")
    con.register("tokens", pa.table({"id": pa.array(ranks.values(), pa.int32()), "data": pa.array(ranks, pa.binary())}))
    con.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")
    return con


class MergedWords:
    """Ids of the distinct words of a task, each merged once."""

    #: Rows that one recursion may make, and those that it begins with (more only for a longer word).
    ROWS, BEGUN, KEPT = 8_000_000, 400_000, 600_000

    def __init__(self, path: str):
        self.ranks, self.con = read_ranks(path), tables(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.reach = max(map(len, self.ranks))
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.KEPT:
            self.clear()
        new = [w for w in words if w not in self.index]
        cuts = np.flatnonzero(np.diff(np.cumsum([len(w) for w in new]) // self.BEGUN)) + 1 if new else []
        for i, j in zip([0, *cuts], [*cuts, len(new)], strict=True):
            if i < j:
                self.add(new[i:j], self.merge(new[i:j]))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def merge(self, words: list[bytes]) -> pa.Array:
        """A recursion keeps the rows of all its steps, so it stops after as many as ROWS allows, and another goes on with the
        words that aren't done."""
        whole = [self.ranks.get(w) for w in words]  # a word that is a token is that token
        pieces = [w if k is None else b"\0" for w, k in zip(words, whole, strict=True)]
        buf, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte[buf]
        ids[(np.cumsum(size) - size)[[k is not None for k in whole]]] = [k for k in whole if k is not None]
        left = pa.table({"spot": ragged(np.arange(len(words), dtype=np.int64) << 32, size), "id": ids, "size": np.ones(len(buf), np.int32)})
        done = []
        while left.num_rows:
            steps = max(1, self.ROWS // left.num_rows)
            found = self.run(MERGE.format(bits=(2 * self.reach).bit_length(), steps=steps), left)
            ended = pc.less(found["n"], steps)
            done.append(found.filter(ended).drop_columns(["n"]))
            left = found.filter(pc.invert(ended)).drop_columns(["n"])
        made = pa.concat_tables(done).sort_by("spot")
        ends = np.searchsorted(made["spot"].to_numpy(), np.arange(len(words) + 1, dtype=np.int64) << 32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), made["id"].combine_chunks())

    def run(self, sql: str, start: pa.Table) -> pa.Table:
        self.con.register("start", start)
        made = self.con.sql(sql).to_arrow_table()
        self.con.unregister("start")
        return made

    def add(self, words: list[bytes], ids: pa.Array) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        size = np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.begin, self.size = np.append(self.begin, len(self.ids) + np.cumsum(size) - size), np.append(self.size, size)
        self.ids = np.append(self.ids, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32))


def decode_lists(con, lists: pa.Array) -> pa.Array:
    """The bytes of each list of ids, by an aggregation ordered by their places; none for a null list or id."""
    con.register("lists", pa.table({"n": pa.array(np.arange(len(lists))), "ids": lists}))
    made = con.sql(DECODE).to_arrow_table().combine_chunks()
    con.unregister("lists")
    parts = made["parts"].combine_chunks() if isinstance(made["parts"], pa.ChunkedArray) else made["parts"]
    flat_parts, sizes = parts.flatten(), np.zeros(len(lists), np.int64)
    buf, inner = flat(flat_parts)
    ends = np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    sizes[made["n"].to_numpy()] = np.diff(inner[ends])
    return binary_array(buf, np.concatenate(([0], np.cumsum(sizes))))


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = MergedWords(path)
    for whole in batches:
        for b in chunks(whole, "text", 4 << 20):
            buf, offsets = flat(b.column("text"))
            starts = word_starts(buf, offsets)
            coded = binary_array(buf, np.append(starts, len(buf))).dictionary_encode()
            place = words.take(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(words.size[place])))[np.searchsorted(starts, offsets)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.ids[ragged(words.begin[place], words.size[place])]))
            keep = [i for i, x in enumerate(b.schema.names) if x != "text"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [lists, decode_lists(words.con, lists)], [b.schema.names[i] for i in keep] + ["ids", "decoded"])


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """Each row of docs with `ids` (array<int>) and `decoded` (the bytes of those ids) instead of its text.

    A null text is empty: no ids, no bytes. Repeated rows are encoded alike, of equal ranks the leftmost pair is merged
    first, an empty table gives an empty one; texts and words of any length are taken whole. Other columns stay; one named ids or decoded is replaced. No shuffle: every row stays in its
    partition.
    """
    kept = docs.drop("ids", "decoded")
    fields = [f for f in kept.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
    return kept.mapInArrow(lambda batches: encode_batches(batches, path), schema)


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = decode_lists(tables(path), b.column("ids").cast(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "decoded"])


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`: the bytes of the list `ids`, joined in order. A null list or id gives nothing."""
    kept = encoded.drop("decoded")
    return kept.mapInArrow(lambda batches: decode_batches(batches, path), T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))
