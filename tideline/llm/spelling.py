"""Spelling variants of a corpus' words by reduced-alphabet generation.

Letters are hashed to a few symbols, so a word becomes a reduced word. Whatever single letter is inserted, deleted or
replaced in a word, the reduced word undergoes at most one such edit, so all reduced words within one edit (a few dozen,
as there are few symbols) are generated and joined with the reduced vocabulary; what meets is verified on the words
themselves. As neighbours are each other's, the longer of two reduced words makes the shorter one, and of equally long ones
that with the smaller symbol the other; links are then taken in both directions.

An edit lies in one half of the word that it leads to, so the other half is the same in both words, letter by letter. A
generated reduced word therefore carries the hash of that half, and a word of the vocabulary is found under each of its
two halves: words that agree in the reduced form alone don't meet, and groups stay small however large the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import chunks, written
from tideline.llm.manifest import CRC_TABLE, crc_sql

RUN = re.compile("[a-zÀ-ÿ]+")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: of reduced words, of letters
CELLS = 1 << 18  # letters worked on at once
HELD = 1 << 18  # distinct words of a task held before they are sent on


def words_of(doc_id: int | None, text: str, least: int, typo: int) -> Iterator[tuple[str, int]]:
    """The text's words of `least` letters or more, and how often each comes. typo: of a run whose CRC-32 with its document
    is a multiple of it, one letter is left out; 0 for none."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # of bytes, lower() takes A-Z alone
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), start)
        if typo and h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            yield run, n


def count_batches(batches: Iterator[pa.RecordBatch], least: int, typo: int) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    for whole in batches:
        for b in chunks(whole, "text"):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for word, n in words_of(doc_id, text or "", least, typo):
                    total[word] += n
            if len(total) > HELD:
                yield told()
                total.clear()
    yield told()


def vocabulary(docs: DataFrame, least: int = 7, count: int = 2, typo: int = 0) -> DataFrame:
    """(word, n): distinct words of docs (doc_id, text) with at least `least` code points that come `count` times or more.
    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case. A null text has none; repeated rows count
    each; a null doc_id is an empty one in the hash of `typo`."""
    counted = docs.select("doc_id", "text").mapInArrow(lambda batches: count_batches(batches, least, typo), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


def mixed(value: np.ndarray, half: np.ndarray, side: int, size: int) -> np.ndarray:
    """One number of a reduced word of that size, and of the letters of its first (0) or last (1) half."""
    x = value ^ (half + np.uint64((2 * size + side + 1) * BASES[0] & (1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(16)).view(np.int64)  # 48 bits, so that rows are short


class Words:
    """Words of one length as sums of letters times powers, of the reduced word and of the letters: an edit of a word, or a
    part of it, is a few operations on these, whatever its length."""

    def __init__(self, letters: np.ndarray, symbols: int):
        self.symbols, self.size = symbols, letters.shape[1]
        self.up = [powers(b, self.size + 1) for b in BASES]
        self.down = [powers(pow(b, -1, 1 << 64), self.size + 1) for b in BASES]
        self.reduced = (letters % symbols).astype(np.uint64) + np.uint64(1)
        zero = np.zeros((len(letters), 1), np.uint64)
        self.sums = [np.concatenate((zero, np.cumsum(x * self.up[i][: self.size], axis=1, dtype=np.uint64)), axis=1) for i, x in enumerate((self.reduced, letters.astype(np.uint64)))]

    def half(self, side: int, size: int) -> np.ndarray:
        """The letters that are the first or last half of a word of that size, if they lie in this one beside its edit."""
        first = size // 2
        if not side:
            return self.sums[1][:, first]
        at = self.size - (size - first)
        return (self.sums[1][:, -1] - self.sums[1][:, at]) * self.down[1][at]

    def own(self) -> Iterator[np.ndarray]:
        """Keys under which these words are found: one for each half."""
        for side in (0, 1):
            yield mixed(self.sums[0][:, -1], self.half(side, self.size), side, self.size)

    def split(self, values: np.ndarray, count: np.ndarray, places: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of edited words of that size, by the half that the edit at each of the places leaves alone."""
        for side, chosen in ((0, places >= size // 2), (1, places < size // 2)):
            if chosen.any():
                yield mixed(values[:, chosen], self.half(side, size)[:, None], side, size), count[:, chosen]

    def edited(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the reduced words within one edit, as (words, keys), and which of them count: of two reduced words that
        are each other's neighbours the longer one, or else the one with the smaller symbol, makes the other."""
        (sums, up, down), n = (self.sums[0], self.up[0], self.down[0]), self.size
        whole, places = sums[:, -1:], np.arange(n)
        for key in self.own():  # a letter replaced by one of the same symbol
            yield key[:, None], np.ones((len(key), 1), bool)
        every = np.ones(self.reduced.shape, bool)
        yield from self.split(sums[:, :-1] + (whole - sums[:, 1:]) * down[1], every, places, n - 1)
        for symbol in range(2, self.symbols + 1):
            yield from self.split(whole + (np.uint64(symbol) - self.reduced) * up[:n], self.reduced < symbol, places, n)


def keys(batches: Iterator[pa.RecordBatch], symbols: int, edits: bool) -> Iterator[pa.RecordBatch]:
    """batches: (id, word). (key, id) of all edits of each word's reduced form, or of the words as they are found."""
    for b in batches:
        ids, words = b.column("id").to_numpy(), b.column("word").to_pylist()
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            for part in np.array_split(same, -(-len(same) * int(size) // CELLS)):
                letters = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                made = Words(letters, symbols)
                for key, count in made.edited() if edits else ((k[:, None], np.ones((len(k), 1), bool)) for k in made.own()):
                    yield pa.RecordBatch.from_arrays([pa.array(key[count]), pa.array(np.repeat(ids[part], count.sum(axis=1)))], ["key", "id"])


def near_words(vocab: DataFrame, symbols: int = 8) -> DataFrame:
    """(id, near, n) for all pairs of words of vocab (id, word, n) that differ by one inserted, deleted or replaced code
    point, in both directions: a word's id, and the other word with its n. Only ids and 48-bit keys are shuffled for the candidates, so a very long word costs
    rows in proportion to its length; what meets by chance fails the test on the words."""
    pick = lambda edits, name: vocab.select("id", "word").mapInArrow(lambda batches: keys(batches, symbols, edits), "key long, id long").withColumnRenamed("id", name)
    met = pick(True, "one").join(pick(False, "other"), "key").where("one <> other")
    met = met.select(F.least("one", "other").alias("a_id"), F.greatest("one", "other").alias("b_id")).distinct()
    side = lambda s: vocab.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(s), F.col("n").alias(f"n_{s}"))
    found = met.join(side("a"), "a_id").join(side("b"), "b_id").where(F.levenshtein("a", "b", 1) == 1)
    ways = [F.struct(F.col(f"{x}_id").alias("id"), F.col(y).alias("near"), F.col(f"n_{y}").alias("n")) for x, y in ("ab", "ba")]
    return found.select(F.explode(F.array(*ways)).alias("way")).select("way.*")


def spelling_variants(words: DataFrame, ratio: int = 10, symbols: int = 8) -> DataFrame:
    """words (word, n, each word once) with n_near, its number of near words; form, the near word of largest n (ties: the
    smallest in code-point order) if that n is at least `ratio` (2 or more) times the word's, and form_n; else null; root,
    the last word that forms lead to, itself if it has none. Forms rise in n, so they end after a few steps. An empty
    table gives none."""
    vocab = written(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    best = near_words(vocab, symbols).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    found = vocab.join(best, "id", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "forms")
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # the way that is known doubles with each round
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        roots = stepped.select("word", "root")
        if not stepped.where("on").limit(1).count():
            break
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {crc_sql("doc_id || ':' || run")} AS h FROM counted, crc_table),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS (SELECT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT x.word AS w, y.word AS o FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, v.word FROM cuts c JOIN v ON v.word = c.a || c.b UNION SELECT v.word, c.word FROM cuts c JOIN v ON v.word = c.a || c.b),
best AS (SELECT w, count(*) AS n_near, arg_min(o, (-v.n, o)) AS o, max(v.n) AS o_n FROM near JOIN v ON v.word = o GROUP BY w),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 10 * n THEN o END AS form, CASE WHEN o_n >= 10 * n THEN o_n END AS form_n FROM v LEFT JOIN best ON w = word),
walk AS (SELECT word, form AS here, 1 AS steps FROM forms WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
