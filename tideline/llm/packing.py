"""Packing of token sequences by minimum bin slack.

Documents become pieces: as many of full capacity as they hold, and a remainder. What decides the packing is only how
many pieces there are of each length, at most `capacity` numbers however large the input is. From that table a bitset
subset-sum dynamic program picks, for each window, the multiset of remaining lengths that fills it closest to capacity;
the choice is traced back to counts and used as often as the counts allow. Every piece then finds its window from its
place among the pieces of its length, which is its place in its block plus the pieces of that length in earlier blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import chunks, written
from tideline.llm.pretokens import LibraryWords

PIECE = "block long, nth long, start long, length int, doc_tokens long, ids_crc32 long"


def cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of every document in order; nth counts the pieces of one length within this task."""
    words, seen, block = LibraryWords(path, fast=True), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for whole in batches:
        for b in chunks(whole, "text"):
            tokens, offsets = words.encoded(b.column("text"))
            n = np.diff(offsets)
            tokens = np.insert(tokens.astype("<u4"), offsets[1:], end_id)
            n, offsets = n + 1, offsets + np.arange(len(offsets))
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, n[row] - start)
            nth = np.empty(len(row), np.int64)
            order = np.argsort(length, kind="stable")
            of, first, count = np.unique(length[order], return_index=True, return_counts=True)
            nth[order] = np.arange(len(row)) - np.repeat(first, count) + np.repeat(seen[of], count)
            seen[of] += count
            raw = memoryview(tokens).cast("B")
            begin = offsets[row] + start
            parts = [raw[4 * s : 4 * (s + k)] for s, k in zip(begin.tolist(), length.tolist(), strict=True)]
            kept = [b.column(i).take(pa.array(row)) for i, name in enumerate(b.schema.names) if name != "text"]
            made = [pa.array(np.full(len(row), block)), pa.array(nth), pa.array(start), pa.array(length.astype(np.int32)), pa.array(n[row]), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = [name for name in b.schema.names if name != "text"] + [x.split()[0] for x in PIECE.split(", ")]
            if ids:
                made.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(kept + made, names)


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, no more of each than counts has, whose sum is as close to room as can be.

    Bit s of `reached` says that some multiset sums to s. Each length adds its copies in powers of two; the bitset before
    each addition is kept, so that the best sum is traced back to how many copies of each length it takes."""
    reached, steps, full = 1, [], (1 << room + 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, copies = min(int(counts[length]), room // length), 1
        while left:
            k = min(copies, left)
            steps.append((reached, length, k))
            reached |= reached << k * length & full
            left, copies = left - k, copies * 2
        if reached >> room & 1:
            break
    at, taken = reached.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            taken[length] = taken.get(length, 0) + k
    return taken


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (how many of each length, how many such windows), until no length is left.

    A window takes the longest piece left and the fill closest to what remains. It is repeated while counts last, so
    there are at most a few windows for each length, whatever the counts are."""
    counts, out = counts.copy(), []
    while (left := np.flatnonzero(counts)).size:
        longest = int(left[-1])
        counts[longest] -= 1
        taken = fill(counts, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(int(counts[k]) // m for k, m in taken.items())
        for k, m in taken.items():
            counts[k] -= m * times
        out.append((taken, times))
    return out


def segments(windows: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length and window kind: its first piece's number, and where those pieces go. Sorted by length, number."""
    seen, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for taken, times in windows:
        base = 0
        for length, m in sorted(taken.items(), reverse=True):
            rows.append((length, int(seen[length]), m, base, sequence))
            seen[length] += m * times
            base += m * length
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "m", "base", "sequence"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def place(batches: Iterator[pa.RecordBatch], seg: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    bound = np.searchsorted(seg["length"], np.arange(seg["length"].max(initial=0) + 2))
    for b in batches:
        length, number = b.column("length").to_numpy().astype(np.int64), b.column("number").to_numpy()
        at = np.empty(len(length), np.int64)
        for k in np.unique(length):
            own = length == k
            at[own] = bound[k] + np.searchsorted(seg["first"][bound[k] : bound[k + 1]], number[own], "right") - 1
        turn = number - seg["first"][at]
        sequence = seg["sequence"][at] + turn // seg["m"][at]
        offset = seg["base"][at] + turn % seg["m"][at] * length
        keep = [i for i, x in enumerate(b.schema.names) if x != "number"]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)], [b.schema.names[i] for i in keep] + ["sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset; with `ids`, also the piece's
    ids as little-endian unsigned 32-bit numbers.

    A null text is empty: its document is the end id alone. Repeated rows are documents of their own; a null doc_id stays
    null. An empty table gives no piece. Texts of any length are encoded whole and cut at multiples of capacity, so each
    id lies in exactly one piece. Other columns of docs are left out. Ties between pieces of one length go by block and
    place in it. Sequences are numbered from 0 without gaps, pieces lie end to end from offset 0.
    """
    spark = docs.sparkSession
    kept = docs.select("doc_id", "text")
    schema = T.StructType([kept.schema["doc_id"], *T._parse_datatype_string(PIECE).fields, *([T.StructField("ids", T.BinaryType())] if ids else [])])
    pieces = written(kept.mapInArrow(lambda batches: cut(batches, tokenizer_path, capacity, end_id, ids), schema), "pieces")
    blocks = written(pieces.groupBy("block", "length").count(), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in blocks.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    seg = segments(plan(counts, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("block", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    # Counts by block grow with the number of tasks, so they are never broadcast; a key's pieces are those of one task.
    numbered = pieces.join(before.hint("merge"), ["block", "length"]).select(*(c for c in pieces.columns if c not in ("block", "nth")), (F.col("_before") + F.col("nth")).alias("number"))
    out = T.StructType([f for f in numbered.schema.fields if f.name != "number"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(lambda batches: place(batches, seg), out)
