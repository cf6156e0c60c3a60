"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import bpe, geokmeans, hyperminhash, langcrf, mixing, oracles, packing, pii, pq, quality, spelling, substrings, tokencount, weaklinear
from webquarry.llm.common import held_out

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after four splices of each document, at places given by hashes of its id and length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    draw = lambda k, name, below: F.pmod(F.xxhash64(F.lit(name), F.lit(k), "doc_id"), F.coalesce(below, F.lit(0)) + 1)
    size = F.length("text")
    edits = F.array(*[
        F.struct(
            draw(k, "at", size).alias("at"), draw(k, "delete", F.lit(40)).alias("delete"),
            F.coalesce(F.substring("text", draw(k, "from", size).cast("int"), F.lit(30)), F.lit("")).alias("insert"),
        ) for k in range(4)
    ])
    return tokencount.recounted(docs.withColumn("edits", edits), BYTE_RANKS, public_tokenizers.PATTERN).drop("text_after")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(_table(spark, sf_dir, "documents"), WORD_BPE)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.drop_repeats(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.planned(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklinear.scored(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langcrf.fit(langcrf.sampled(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang"))
    rows = langcrf.predicted(docs, model)
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["lang"], r["first"], r["end"])), ",")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", runs.alias("word_runs"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(_table(spark, sf_dir, "documents")))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geokmeans.clustered(_table(spark, sf_dir, "embeddings"))
    centroid = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    centroids = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.lit(found.inertia).cast("long").alias("inertia"), centroid.alias("centroid_sha256"))
    return found.assigned.join(F.broadcast(centroids), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(_table(spark, sf_dir, "documents"), WORD_BPE)
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.occurrences(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language": op9_language,
    "op10_pii": op10_pii,
    "op11_clusters": op11_clusters,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}
ORACLE = oracles.ORACLE
