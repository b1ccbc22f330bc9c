"""Merkle manifest of a dataset: a postorder append log, and proofs that are read from it.

Rows are leaves of a tree per group (`tree`), ordered by their key; every eight consecutive nodes have their digest as
parent until one is left, and the groups' roots are the leaves of one more tree. Aligned builders take 4096 leaves each and
write the subtree's nodes in the order in which they are completed: a node follows its last child at once. Where a node
stands in that order depends on its level and the leaves before its end alone (`position`), so a segment is addressed
without an index. The builders' top nodes are the leaves of the next tier's builders.

Proofs go the other way: a tier's segments meet the path of the node that each stands below, and siblings are taken from
the segment at their closed-form positions. No group of rows is larger than a builder's, whatever a tree holds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import written
from tideline.plans.shared import in_order, running

WAYS = 3  # bits of a place among siblings: eight children
DEPTH = 4  # levels that a builder completes, unless told otherwise
WIDTH = 64  # a digest as text

SEGMENT = "tree string, block long, size long, nodes binary, top binary"
PATH = "tree string, block long, places array<int>, siblings array<binary>, subroot binary, root binary"


def digest(data: bytes) -> bytes:
    """H of the manifest: lowercase hex."""
    return hashlib.sha256(data).hexdigest().encode()


def leaf_digest(*fields: Column) -> Column:
    """H of the fields: `-` for a null, else the UTF-8 byte count, `:` and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def position(level: int, end: np.ndarray) -> np.ndarray:
    """Place, from 0, in completion order of the node of that level whose subtree ends before leaf number `end`: the nodes
    up to its level that are complete with it, and those above that were complete before its last leaf came."""
    out, most = np.full(len(end), -1, np.int64), int(end.max(initial=1))
    for j in range(64 // WAYS):
        if j > level and most >> (WAYS * j) == 0:
            break
        out += -(-end >> (WAYS * j)) if j <= level else (end - 1) >> (WAYS * j)
    return out


def widths(size: int, block: int, depth: int) -> list[int]:
    """Nodes of each level in a segment. The first block stops where one node is left; a later one has its full height,
    as the tree goes on above it."""
    out = [size]
    while len(out) <= depth and (block or out[-1] > 1):
        out.append(-(-out[-1] >> WAYS))
    return out


def ends(level: int, count: int, size: int) -> np.ndarray:
    return np.minimum((np.arange(count, dtype=np.int64) + 1) << (WAYS * level), size)


def build_segment(key: tuple, rows: pa.Table, depth: int) -> pa.Table:
    """One builder: the segment of a block's leaves in completion order."""
    rows = rows.sort_by("place")
    tree, block = key[0].as_py(), key[1].as_py()
    level = [x.hex().encode() for x in rows.column("digest").to_pylist()]
    counts = widths(len(level), block, depth)
    out = np.empty((sum(counts), WIDTH // 2), np.uint8)
    for k, count in enumerate(counts):
        if k:
            level = [digest(b"".join(level[i : i + (1 << WAYS)])) for i in range(0, len(level), 1 << WAYS)]
        out[position(k, ends(k, count, counts[0]))] = np.frombuffer(bytes.fromhex(b"".join(level).decode()), np.uint8).reshape(-1, WIDTH // 2)
    return pa.table({"tree": pa.array([tree], pa.string()), "block": pa.array([block], pa.int64()), "size": pa.array([counts[0]], pa.int64()), "nodes": pa.array([out.tobytes()], pa.binary()), "top": pa.array([bytes.fromhex(level[0].decode())], pa.binary())})


def build_log(leaves: DataFrame, depth: int) -> list[DataFrame]:
    """The tiers of segments over leaves (tree, place, digest), places gapless from 0 in each tree. In the last tier each
    tree has one segment, whose top is its root. A tree that is complete earlier passes on as a segment of one node."""
    tiers, nodes = [], leaves
    while True:
        blocks = nodes.select("tree", F.shiftright("place", WAYS * depth).alias("block"), "place", "digest")
        tiers.append(written(blocks.groupBy("tree", "block").applyInArrow(lambda key, rows: build_segment(key, rows, depth), SEGMENT), f"manifest-tier{len(tiers)}"))
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        nodes = tiers[-1].select("tree", F.col("block").alias("place"), F.col("top").alias("digest"))


class Siblings:
    """A segment as sibling runs: of a leaf, level by level, its place in its run and the run's other digests."""

    def __init__(self, nodes: bytes, size: int, block: int, depth: int):
        table = np.frombuffer(nodes, np.uint8).reshape(-1, WIDTH // 2)
        counts = widths(size, block, depth)
        self.levels = [table[position(k, ends(k, c, size))].tobytes() for k, c in enumerate(counts[:-1])]
        self.counts = counts

    def path(self, leaf: int) -> list[tuple[int, bytes]]:
        out, half = [], WIDTH // 2
        for level, count in zip(self.levels, self.counts, strict=False):
            first = leaf >> WAYS << WAYS
            last, at = min(first + (1 << WAYS), count), leaf - first
            out.append((at, level[first * half : leaf * half] + level[(leaf + 1) * half : last * half]))
            leaf >>= WAYS
        return out


def fold(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf's digest (hex) and its siblings give."""
    for at, others in path:
        text = others.hex().encode()
        leaf = digest(text[: at * WIDTH] + leaf + text[at * WIDTH :])
    return leaf


def segment_paths(rows: pa.Table, above: pa.Table, depth: int) -> pa.Table:
    """Paths of all leaves of one segment: its own levels, then the path of its top."""
    seg, up = rows.to_pylist()[0], above.to_pylist()
    up = up[0] if up else {"places": [], "siblings": [], "subroot": seg["top"], "root": seg["top"]}
    runs, first = Siblings(seg["nodes"], seg["size"], seg["block"], depth), seg["block"] << (WAYS * depth)
    paths = [runs.path(i) for i in range(seg["size"])]
    return pa.table({
        "tree": pa.array([seg["tree"]] * len(paths), pa.string()), "block": pa.array(range(first, first + len(paths)), pa.int64()),
        "places": pa.array([[p for p, _ in x] + up["places"] for x in paths], pa.list_(pa.int32())), "siblings": pa.array([[s for _, s in x] + up["siblings"] for x in paths], pa.list_(pa.binary())),
        "subroot": pa.array([up["subroot"]] * len(paths), pa.binary()), "root": pa.array([up["root"]] * len(paths), pa.binary()),
    })


def paths_of(tier: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    return tier.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(lambda rows, up: segment_paths(rows, up, depth), PATH)


def paths_down(tiers: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """Paths (PATH) of the segments of the lowest tier, each a leaf of the tier over it; above: those of the trees' roots."""
    for k, tier in enumerate(reversed(tiers[1:])):
        above = written(paths_of(tier, above, depth), f"manifest-paths{k}")
    return above


@dataclass
class Manifest:
    """leaves (tree, place, digest and the columns carried), the tiers of their log, and those of the log over the trees'
    roots, whose leaves are `roots` (tree, place, digest, of)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    depth: int = DEPTH

    def paths(self) -> DataFrame:
        """PATH of each segment of the lowest tier."""
        whole = F.lit("").alias("tree")
        over = self.top[-1].select(whole, F.lit(0).cast("long").alias("block"), F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("siblings"), F.col("top").alias("subroot"), F.col("top").alias("root"))
        over = paths_down(self.top, over, self.depth)
        found = written(paths_of(self.top[0], over, self.depth), "manifest-root-paths")
        named = self.roots.select("place", F.col("of").alias("tree"), F.col("digest").alias("subroot")).join(found.select(F.col("block").alias("place"), "places", "siblings", "root"), "place")
        return paths_down(self.tiers, named.select("tree", F.lit(0).cast("long").alias("block"), "places", "siblings", "subroot", "root"), self.depth)

    def proofs(self, of: list[str], audit: bool = False) -> DataFrame:
        """For every leaf the columns `of`, leaf, subroot, root (hex) and its proof: per level its place among the siblings
        (places) and the others' digests, concatenated (siblings). audit: instead of these, proof_sha256 (H of the siblings,
        all levels) and folded_root, recomputed from the column `claimed` or, where that is null, from the leaf."""
        depth = self.depth
        kept = self.leaves.select(*of, "claimed", "digest", "place", "tree", F.shiftright("place", WAYS * depth).alias("block"))
        known = self.tiers[0].select("tree", "block", "size", "nodes").join(self.paths(), ["tree", "block"])
        schema = kept.select(*of).schema.add("leaf", "string").add("subroot", "string").add("root", "string")
        for name, kind in (("proof_sha256", "string"), ("folded_root", "string")) if audit else (("places", T.ArrayType(T.IntegerType())), ("siblings", T.ArrayType(T.StringType()))):
            schema = schema.add(name, kind)

        def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
            up = above.to_pylist()[0]
            runs, first = Siblings(up["nodes"], up["size"], up["block"], depth), up["block"] << (WAYS * depth)
            rest = list(zip(up["places"], up["siblings"], strict=True))
            leaves, claims = (rows.column(c).to_pylist() for c in ("digest", "claimed"))
            made: tuple[list, list] = ([], [])
            for place, leaf, claim in zip(rows.column("place").to_pylist(), leaves, claims, strict=True):
                path = runs.path(place - first) + rest
                made[0].append(digest(b"".join(s for _, s in path).hex().encode()).decode() if audit else [p for p, _ in path])
                made[1].append(fold((claim or leaf).hex().encode(), path).decode() if audit else [s.hex() for _, s in path])
            kinds = (pa.string(), pa.string()) if audit else (pa.list_(pa.int32()), pa.list_(pa.string()))
            same = lambda x: pa.array([x.hex()] * len(leaves), pa.string())
            columns = [*(rows.column(c) for c in of), pa.array([x.hex() for x in leaves], pa.string()), same(up["subroot"]), same(up["root"]), *map(pa.array, made, kinds)]
            return pa.table(columns, names=schema.names)

        return kept.groupBy("tree", "block").cogroup(known.groupBy("tree", "block")).applyInArrow(prove, schema)


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Adds place: the leaf's number from 0 in its tree, in that order, from one sort by range over all tasks."""
    return running(in_order(leaves, ["tree"], *order), ["tree"], F.lit(1)).withColumn("place", F.col("_sum") - 1).drop("_sum", "_part", "_at")


def build_manifest(docs: DataFrame, leaf: Column, group: str = "lang", key: str = "doc_id", claimed: Column | None = None, depth: int = DEPTH) -> Manifest:
    """The manifest of docs: leaves in a tree per value of `group` (null first, then bytewise), ordered by `key` (null first;
    ties by digest, so rows that are equal in all hashed fields change places without effect). leaf, claimed: digests as
    hex text; claimed may be null. Only digests and keys are shuffled, never texts. An empty table has no roots and no
    proofs; a tree of one leaf has that leaf as its root. Other columns of docs play no part, whatever their names."""
    raw = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"), F.col(key).alias("key"), F.unhex(leaf).alias("digest"), F.unhex(claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed"))
    leaves = written(numbered(raw.withColumn("tie", F.monotonically_increasing_id()), "key", "digest", "tie").drop("tie"), "manifest-leaves")
    tiers = build_log(leaves.select("tree", "place", "digest"), depth)
    roots = written(numbered(tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest")), "of"), "manifest-roots")
    return Manifest(leaves, tiers, roots, build_log(roots.select("tree", "place", "digest"), depth), depth)


#: Bytes' CRC-32 in DuckDB: {crc} over a list of bytes, with `crc_table` a one-row table of the list `t`.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _said(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_said, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT coalesce('=' || lang, '-') AS tree, doc_id, {_leaf('text')} AS leaf, CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS c FROM leaves),
low AS (SELECT tree, 0 AS l, idx, leaf AS d, c FROM placed UNION ALL SELECT tree, l + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (c + 7) // 8 FROM low WHERE c > 1 GROUP BY tree, l, idx // 8, c),
subroots AS (SELECT tree, d, l AS height, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS c FROM low WHERE c = 1),
high AS (SELECT 0 AS l, idx, d, c FROM subroots UNION ALL SELECT l + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (c + 7) // 8 FROM high WHERE c > 1 GROUP BY l, idx // 8, c),
steps AS (SELECT p.tree, p.idx AS leaf_idx, s.height + x.l AS l, x.l AS up, p.idx >> (3 * x.l) AS own, FALSE AS top FROM placed p JOIN subroots s USING (tree), range(22) x(l) WHERE x.l < s.height
  UNION ALL SELECT p.tree, p.idx, s.height + x.l, x.l, s.idx >> (3 * x.l), TRUE FROM placed p JOIN subroots s USING (tree), range(22) x(l) WHERE x.l < (SELECT max(l) FROM high)),
sides AS (SELECT t.tree, t.leaf_idx, CASE WHEN t.top THEN t.l ELSE t.up END AS l, coalesce(string_agg(n.d, '' ORDER BY n.idx) FILTER (n.idx < t.own), '') AS a, coalesce(string_agg(n.d, '' ORDER BY n.idx) FILTER (n.idx > t.own), '') AS b
  FROM steps t JOIN (SELECT tree, l, idx, d, FALSE AS top FROM low UNION ALL SELECT s.tree, h.l, h.idx, h.d, TRUE FROM high h, subroots s) n ON n.tree = t.tree AND n.top = t.top AND n.l = t.up AND n.idx // 8 = t.own // 8 GROUP BY t.tree, t.leaf_idx, t.l, t.up, t.top),
proof AS (SELECT tree, leaf_idx, sha256(string_agg(a || b, '' ORDER BY l)) AS proof_sha256, max(l) AS last FROM sides GROUP BY tree, leaf_idx),
folds AS (SELECT tree, idx AS leaf_idx, 0 AS l, coalesce(claimed, leaf) AS d FROM placed UNION ALL SELECT f.tree, f.leaf_idx, f.l + 1, sha256(s.a || f.d || s.b) FROM folds f JOIN sides s ON s.tree = f.tree AND s.leaf_idx = f.leaf_idx AND s.l = f.l),
folded AS (SELECT tree, leaf_idx, max_by(d, l) AS folded_root FROM folds GROUP BY tree, leaf_idx),
whole AS (SELECT d AS root FROM high WHERE c = 1)
SELECT p.doc_id, p.leaf, s.d AS subroot, root, coalesce(r.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = root AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN whole LEFT JOIN proof r ON r.tree = p.tree AND r.leaf_idx = p.idx JOIN folded f ON f.tree = p.tree AND f.leaf_idx = p.idx
"""
