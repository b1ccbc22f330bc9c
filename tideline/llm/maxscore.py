"""Exact top-k search by inner product with MaxScore over sharded postings.

A vector's components are terms with a sign: the posting of (dimension, sign) lists the vectors of a shard whose
component has that sign. A query's terms that raise a score are bounded by the shard's largest impact of each. Terms are
split in order of their bounds: documents that occur only in the non-essential ones, whose bounds together stay below
the k-th best score so far, can't be among the best. The essential postings are traversed, and the other terms are
probed only for candidates that are still competitive. The shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import written


class Shard:
    """Postings of one shard: for each dimension and sign, the vectors' places and their impacts, largest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.postings: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for d, column in enumerate(self.columns):
            for positive in (True, False):
                at = np.flatnonzero(column > 0 if positive else column < 0)
                at = at[np.argsort(-np.abs(column[at]), kind="stable")]
                if len(at):
                    self.postings[d, positive] = at, np.abs(column[at])

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but the query's own, ties to smaller ids."""
        size = len(query)
        terms = [(abs(int(q)), d, p) for d, q in enumerate(query.tolist()) if q and d < len(self.columns) and (p := self.postings.get((d, q > 0)))]
        terms = sorted(((q * int(p[1][0]), q, d, p) for q, d, p in terms), key=lambda t: t[:3])
        bounds = np.array([t[0] for t in terms], np.int64)
        others = self.ids != own
        exact = lambda at: self.vectors[at, :size] @ query[: self.vectors.shape[1]]
        # The k-th best of some likely documents is a threshold that the true k-th best can't be below.
        likely = np.unique(np.concatenate([np.zeros(0, np.int64), *(t[3][0][: 2 * k] for t in terms[-6:])]))
        likely = likely[others[likely]]
        threshold = np.partition(exact(likely), len(likely) - k)[len(likely) - k] if len(likely) >= k else None
        if threshold is None or threshold <= 0:  # a document without any raising term may be among the best
            at = np.flatnonzero(others)
        else:
            below = np.cumsum(bounds)
            first = int(np.searchsorted(below, threshold, "left"))  # terms before it are non-essential
            score, rest = np.zeros(len(self.ids), np.int64), int(below[first - 1]) if first else 0
            for _, q, _, (places, impacts) in terms[first:]:
                score[places] += q * impacts
            at = np.flatnonzero((score + rest >= threshold) & others)
            for bound, q, d, _ in terms[first - 1 :: -1] if first else []:
                if not len(at):
                    break
                value = self.columns[d, at]
                score[at] += q * np.maximum(value if query[d] > 0 else -value, 0)
                rest -= bound
                at = at[score[at] + rest >= threshold]
        found = exact(at)
        order = np.lexsort((self.ids[at], -found))[:k]
        return self.ids[at][order], found[order]


def padded(lists: pa.Array) -> np.ndarray:
    """A list array of numbers as a matrix; shorter lists end in zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in size)])] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by shard: first the vectors, one a row, then blocks of queries. One shard is held at a time."""
    shard, ids, vectors, index = None, [], [], None
    for b in batches:
        at, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
        edges = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1]))) if len(at) else []
        for begin, end in zip(edges, [*edges[1:], len(at)], strict=True):
            rows = b.slice(begin, end - begin)
            if at[begin] != shard:
                shard, ids, vectors, index = at[begin], [], [], None
            if kind[begin] == 0:
                ids.append(rows.column("ids").flatten().to_numpy())
                vectors.append(padded(rows.column("weights").flatten()))
                continue
            if not ids:
                continue  # a shard without vectors
            index = index or Shard(np.concatenate(ids), stacked(vectors))
            for block_ids, block in zip(rows.column("ids"), rows.column("weights"), strict=True):
                found = [(q, *index.best(v, q, k)) for q, v in zip(block_ids.values.to_pylist(), padded(block.values), strict=True)]
                n = [len(x[1]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], n), pa.int64()), pa.array(np.concatenate([x[1] for x in found]), pa.int64()), pa.array(np.concatenate([x[2] for x in found]), pa.int64())], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 4096, block: int = 16) -> DataFrame:
    """For every row of vectors (vec_id, embedding) that is_query picks: its k highest inner products with all others, of
    components floor(scale * x): query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id; fewer rows give
    fewer results.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null vec_id; an empty
    vector scores 0 and a shorter one counts as ending in zeros. Repeated rows count once; rows of one vec_id are not
    each other's results. Vectors so long that a score might pass a long's end (the greatest squared length times the number
    of components reaches 2^62) are an error before anything is shuffled. Other columns are ignored. Vectors are shuffled once into shards of about shard_rows; blocks of
    queries visit every shard, and each task holds one shard and one block.
    """
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    weights = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("w")
    kept = vectors.where(fine & F.col("vec_id").isNotNull()).select("vec_id", weights, F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()
    kept = written(kept, "vectors")
    size = F.aggregate("w", F.lit(0.0), lambda a, w: a + w.cast("double") * w.cast("double"))
    n, longest, most = kept.agg(F.count(F.lit(1)), F.max(size), F.max(F.size("w"))).first()
    if n and longest * max(most, 1) >= 2.0**62:  # no score or bound of two vectors is beyond their squared length times its root
        raise ValueError(f"components are so large that scores may not fit a long: squared length {longest}, {most} components")
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-n // (100 * block)))
    stored = kept.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), F.array("w").alias("weights"))
    asked = kept.where("asks").groupBy(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("b")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "w"))).alias("q"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("q.vec_id").alias("ids"), F.col("q.w").alias("weights"))
    dealt = stored.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(lambda batches: search_batches(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
