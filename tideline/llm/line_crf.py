"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own statistics and those of the lines before and after it; the chain has
a score for each pair of neighbouring labels. Forward and backward sums give each line's chance of being bad, and the
mean of these, weighted by the lines' lengths, is brought to the scale of the labels by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import aside, back, chunks, flat, text_or_empty
from tideline.llm.text_stats import _PUNCT, _SYMBOL, _UPPER, _WHITE, codes, line_bounds, word_bounds

_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
OWN = 9  # a line's own features
WIDTH = 1 + 3 * OWN + 2  # bias, own, before, after, first line, last line


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH, float32), lengths in bytes, and the texts' offsets, for all lines that hold a word."""
    buf, offsets = flat(texts)
    starts, ends = word_bounds(buf, offsets)
    word = codes(buf, starts, ends)
    begin, end, text = line_bounds(buf, offsets)
    w0, w1 = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    own = w1 > w0
    begin, end, text, w0, w1 = begin[own], end[own], text[own], w0[own], w1[own]
    count = lambda mask: (c := np.concatenate(([0], np.cumsum(mask, dtype=np.int64))))[end] - c[begin]
    again = np.concatenate(([False], word[1:] == word[:-1])) if len(word) else np.zeros(0, bool)
    again[w0] = False
    repeats = (c := np.concatenate(([0], np.cumsum(again))))[w1] - c[w0]
    line = codes(buf, begin, end)
    seen = np.ones(len(line), bool)
    seen[np.unique(text * (line.max(initial=0) + 1) + line, return_index=True)[1]] = False
    n, chars = w1 - w0, np.maximum(count(~_WHITE[buf]), 1)
    f = np.zeros((len(begin), OWN), np.float32)
    for k, x in enumerate((np.log1p(n) / 3, np.log(chars / np.maximum(n, 1)), *(np.sqrt(count(m[buf]) / chars) for m in (_SYMBOL, _UPPER, _PUNCT, _DIGIT)), np.sqrt(repeats / np.maximum(n, 1)), seen, buf[end - 1] == 0x2E if len(end) else np.zeros(0))):
        f[:, k] = x
    first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
    last = np.concatenate((first[1:], [True])) if len(text) else first
    before, after = np.roll(f, 1, 0), np.roll(f, -1, 0)
    before[first], after[last] = f[first], f[last]
    x = np.concatenate([np.ones((len(f), 1), np.float32), f, before, after, first[:, None], last[:, None]], 1).astype(np.float32)
    return x, end - begin, np.searchsorted(text, np.arange(len(offsets)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # WIDTH: score of bad against good
    chain: np.ndarray  # 2 x 2: score of a label after another
    scale: np.ndarray  # logistic fit: constant, share of bad
    prior: float  # score of a text without lines

    def unary(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 2))
        out[:, 1] = ((x - self.mean) / self.spread) @ self.weights
        return out


def sweep(first: np.ndarray, unary: np.ndarray, chain: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Forward sums of many chains side by side: those of lines begin[k] ... begin[k] + size[k] - 1, the first line's being
    given. One step a line of the longest."""
    alpha = np.zeros_like(unary)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alpha[begin] = first[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # chains with more than t lines
    for t in range(1, len(live)):
        at = begin[: live[t]] + t
        p = alpha[at - 1]
        alpha[at] = unary[at] + np.logaddexp(p[:, :1] + chain[0], p[:, 1:] + chain[1])
    return alpha


def forward(unary: np.ndarray, chain: np.ndarray, begin: np.ndarray, size: np.ndarray, block: int) -> np.ndarray:
    """Forward sums of chains. Long ones are cut in blocks: what a block makes of either label of its first line is found
    for all blocks at once, a short loop over a chain's blocks gives each one's first line, and one sweep all lines."""
    if not len(size) or size.max() <= 2 * block:
        return sweep(unary[begin], unary, chain, begin, size)
    count = -(-size // block)
    chain_of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(chain_of)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[chain_of] + nth * block
    length = np.minimum(block, size[chain_of] - nth * block)
    never = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    with np.errstate(invalid="ignore"):
        ends = [sweep(np.tile(given, (len(start), 1)) + unary[start], unary, chain, start, length)[start + length - 1] for given in never]
    first = unary[start].copy()
    for k in np.flatnonzero(nth).tolist():  # a row a block
        p = [first[k - 1, y] - unary[start[k - 1], y] for y in (0, 1)]
        last = np.logaddexp(p[0] + ends[0][k - 1], p[1] + ends[1][k - 1])
        first[k] = unary[start[k]] + np.logaddexp(last[0] + chain[0], last[1] + chain[1])
    return sweep(first, unary, chain, start, length)


def forward_backward(unary: np.ndarray, chain: np.ndarray, offsets: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of each line's labels, summed chances of each pair of neighbouring labels, log of the partition functions' product."""
    size = np.diff(offsets)
    own = size > 0
    begin, size = offsets[:-1][own], size[own]
    alpha = forward(unary, chain, begin, size, block)
    n = len(unary)
    turned = forward(unary[::-1], chain.T, n - begin - size, size, block)[::-1]  # the same from the other end
    beta = turned - unary
    both = alpha + beta
    norm = np.logaddexp(both[:, 0], both[:, 1])
    chance = np.exp(both - norm[:, None])
    inner = np.ones(n, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + chain + (unary[at] + beta[at])[:, None, :] - norm[at, None, None]).sum(0)
    return chance, pair, float(norm[begin].sum())


def bad_share(model: Model, x: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The length-weighted mean chance of bad; -1 for texts without lines."""
    chance, _, _ = forward_backward(model.unary(x), model.chain, offsets)
    total = lambda v: (c := np.concatenate(([0.0], np.cumsum(v))))[offsets[1:]] - c[offsets[:-1]]
    weight = total(length.astype(float))
    return np.where(weight > 0, np.clip(total(chance[:, 1] * length) / np.maximum(weight, 1), 0, 1), -1.0)


def score(model: Model, texts: pa.Array) -> np.ndarray:
    share = bad_share(model, *line_features(texts))
    return np.where(share < 0, model.prior, 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * share))))


def train(x: np.ndarray, length: np.ndarray, offsets: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximum likelihood of the lines' labels, which start as their document's. Halfway, lines of bad documents that the
    model takes for good become good: a bad document may hold some."""
    spread = x.std(0) if len(x) else np.ones(WIDTH)
    mean = np.where(spread > 1e-6, x.mean(0) if len(x) else 0.0, 0.0)
    prior = (good.sum() + 1) / (len(good) + 2)
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0), np.zeros(WIDTH), np.zeros((2, 2)), np.array([np.log(prior / (1 - prior)), 0.0]), prior)
    if not len(x) or good.all() or not good.any():
        return model
    z = (x - model.mean) / model.spread
    label = np.repeat(~good, np.diff(offsets)).astype(np.int64)
    inner = np.ones(len(x), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    step = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    for i in range(1, rounds + 1):
        chance, pair, _ = forward_backward(model.unary(x), model.chain, offsets)
        if i == rounds // 2:
            label = np.where((label == 1) & (chance[:, 1] < 0.5), 0, label)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), 1)
        for k, (value, slope) in enumerate(((model.weights, z.T @ (label - chance[:, 1]) / len(x)), (model.chain, (seen - pair) / len(x)))):
            slope = slope - decay * value
            step[2 * k] = 0.9 * step[2 * k] + 0.1 * slope
            step[2 * k + 1] = 0.99 * step[2 * k + 1] + 0.01 * slope**2
            value += rate * (step[2 * k] / (1 - 0.9**i)) / (np.sqrt(step[2 * k + 1] / (1 - 0.99**i)) + 1e-6)
    share = bad_share(model, x, length, offsets)
    own = share >= 0
    design, target, c = np.stack([np.ones(own.sum()), share[own]], 1), good[own].astype(float), np.zeros(2)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(design @ c)))
        c = c + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (target - p) - 0.1 * c)
    model.scale = c
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 50_000, most_lines: int = 200) -> Model:
    """Fitted on the driver on at most `sample` labelled documents, those of least hash among the rows whose remainder
    isn't 2, as far as they have at most `longest` bytes and `most_lines` lines: under 75 MB of line features, and 400 MB
    while fitting, whatever the tables' sizes. Of rows that share a doc_id one is taken before they are collected."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = text_or_empty()
    fits = (F.octet_length(text) <= longest) & (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < most_lines)
    texts = docs.select("doc_id", "text").where(fits).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                x, length, at = line_features(b.column("text"))
                cut = lambda v: [v[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(cut(x), pa.binary()), pa.array(cut(length.astype(np.int32)), pa.binary())], ["doc_id", "quality", "x", "length"])

    rows = texts.mapInArrow(features, T.StructType([docs.schema["doc_id"], T.StructField("quality", known.schema["quality"].dataType), T.StructField("x", T.BinaryType()), T.StructField("length", T.BinaryType())])).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, WIDTH).astype(float)
    length = np.frombuffer(b"".join(r["length"] for r in rows), np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(r["length"]) // 4 for r in rows]))).astype(np.int64)
    return train(x, length, offsets, np.array([r["quality"] == 1 for r in rows], bool))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs' columns but the text, with held_out, score and predicted.

    Only the text makes the score. A null or empty text, or one without a word, gets the share of good documents among
    those learned from. Repeated rows score alike, long texts are read whole, an empty table gives no rows, a null doc_id
    isn't held out; columns with the added names are replaced. No shuffle.
    """
    kept = docs.drop("held_out", "score", "predicted")
    work = aside(kept, "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score(model, b.column("text")))], ["row", "score"])

    out = work.mapInArrow(scored, T.StructType([work.schema["row"], T.StructField("score", T.DoubleType())]))
    held = F.coalesce(remainder(F.col("row").getField("doc_id")) == 2, F.lit(False)).alias("held_out")
    return out.select(*back(out, [c for c in kept.columns if c != "text"]), held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
