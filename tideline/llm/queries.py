"""The queries of the operators in this package, over the tables of one folder, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import fingerprint, manifest, maxscore, spelling
from tideline.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.token_counts import count_tokens

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality_rules import STATS, quality_rules

    return quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", *STATS, "base_failed", "kept")


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.maxscore import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.sharding import shard_documents

    dealt = shard_documents(documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.secret_scan import BASE, listed, scan

    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    scanned = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return scanned.select("doc_id", *(count(b.kind) for b in BASE), F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.packing import pack_documents

    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.line_crf import fit, score_documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.bpe import encode_texts

    coded = encode_texts(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.suffix_dedup import remove_repeats

    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.leaf_digest(*fields, lowered))
    made = manifest.build_manifest(documents(spark, sf_dir), manifest.leaf_digest(*fields, F.col("text")), claimed=tampered)
    return made.proofs(["key"], audit=True).withColumnRenamed("key", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(documents(spark, sf_dir).select("doc_id", "text"))


def op13_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(documents(spark, sf_dir), least=7, count=2, typo=31)
    return spelling.spelling_variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_robust_outliers, op3_maxscore, op4_sampled_splitters, op5_entropy_secrets, op6_minimum_bin_slack, op7_simhash_ball, op8_line_crf, op9_bpe, op10_suffix_array, op11_postorder_manifest, op12_section_tree, op13_reduced_alphabet)}
ORACLES: dict[str, str] = {"op3_maxscore": maxscore.ORACLE, "op11_postorder_manifest": manifest.ORACLE, "op12_section_tree": fingerprint.ORACLE, "op13_reduced_alphabet": spelling.ORACLE}
