"""Token counts by a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens) keyed by two digests: that of the normalised content and
that of the tokenizer's file with the settings in use. Documents are joined to it by digest; only distinct contents that
it lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tideline.llm.common import aside, back, chunks, join_spread, new_path, text_or_empty, written
from tideline.llm.pretokens import LibraryWords

CACHE = "content binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the settings that counts depend on."""
    with open(path, "rb") as f:
        return hashlib.sha256(hashlib.file_digest(f, "sha256").digest() + b"no ends, no truncation, no padding").hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at `path`; an empty one if nothing is there yet. If two jobs appended one content, one row counts."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], CACHE)
    return found.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_misses(batches, path: str):
    """Counts of contents, each encoded once: rows of one content lie one after the other."""
    words, last = LibraryWords(path), None
    for whole in batches:
        for b in chunks(whole, "text"):
            content = b.column("content").to_pylist()
            new = np.array([c != before for c, before in zip(content, [last, *content], strict=False)], bool)
            b, last = b.filter(pa.array(new)), content[-1]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(words.counts(b.column("text")), pa.int64())], ["content", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row of docs (doc_id, text and any other columns).

    Content is normalised by taking a null text as the empty one; nothing else is safe for every vocabulary, as case
    and white space change counts. Repeated rows and copies are encoded once and each get their count. An empty table
    gives an empty result, an empty text 0 tokens. A column of docs with one of the added names is replaced.
    `cache_path`: a folder that all executors see, kept between runs; without it the cache lives in the shared folder
    for this call. The misses' texts are shuffled once, by content digest and document, copies of the most frequent ones
    left behind, and counts come back to rows
    over several tasks where many share one, so a text that a third of all rows share does not meet in one task.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or new_path(spark, "token-counts")
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    content = F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("content")
    keyed = docs.select("doc_id", text_or_empty().alias("text"), content)
    known = lambda: open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    sizes = written(keyed.groupBy("content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "contents")
    chosen = sizes.select("content", "first").join(known(), "content", "left_anti")
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    many = sizes.where(F.col("rows") >= max(2, total // 1000)).select("content", F.struct("first").alias("many"))  # a thousand or so
    once = keyed.join(F.broadcast(many), "content", "left").where(F.col("many").isNull() | F.col("doc_id").eqNullSafe(F.col("many.first"))).drop("many")
    same = (F.col("k.content") == F.col("c.content")) & F.col("k.doc_id").eqNullSafe(F.col("c.first"))
    misses = once.alias("k").join(chosen.alias("c"), same, "left_semi").select("content", "text")
    counted = misses.mapInArrow(lambda batches: count_misses(batches, tokenizer_path), "content binary, n_tokens long")
    counted.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    work = aside(docs, "text").select("row", "text", content, F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    found = join_spread(work, sizes.join(known(), "content").select("content", "rows", "n_tokens"), "content", ["row.doc_id"], "left")
    return found.select(*back(found, docs.columns, "text"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
