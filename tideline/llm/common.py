"""What the operators share: the cluster's shared folder, written tables that cut lineage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`. Where that is unset, a local session gets
    one of its own; on a cluster it is an error, as no machine's own folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def aside(docs: DataFrame, *own: str) -> DataFrame:
    """docs as `row`, a struct of all columns but `own`, and these beside it: no working column's name can clash with one
    of docs'. `back` takes it apart."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(F.struct(*rest or [F.lit(None).alias("none")]).alias("row"), *own)


def back(df: DataFrame, columns: list[str], *own: str) -> list[Column]:
    """These columns of the table that `aside(table, *own)` was made of, to be selected from df."""
    return [F.col(c) if c in own else F.col("row").getField(c).alias(c) for c in columns]


def join_spread(rows: DataFrame, known: DataFrame, keys: str | list[str], vary: list[str], how: str = "inner") -> DataFrame:
    """rows joined with known (keys, `rows`: how many rows have those, and more) on keys that a large part of all rows may
    share. Keys of over a thousandth of all rows are dealt over tasks of about a thousandth, by a hash of the columns
    `vary`; their row in known is repeated for each. There can be a thousand such keys at most, so they are broadcast, and
    two thousand repeated rows. known's column `rows` is left out; null keys meet nothing."""
    keys = [keys] if isinstance(keys, str) else keys
    total = known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    least = max(1, -(-total // 1000))
    parts = F.ceil(F.col("rows") / least).cast("int")
    hot = known.where(F.col("rows") >= least).select(*keys, parts.alias("_parts"))
    salt = F.pmod(F.xxhash64(*vary, F.spark_partition_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("rows") >= least, parts - 1).otherwise(0)))).drop("rows")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least; a long text is never cut."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after the other, and their len + 1 offsets. A null is an empty text."""
    if not isinstance(texts, pa.Array):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def binary_array(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of buf that follow one another, as an Arrow binary array without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values within offsets; empty ranges are 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
