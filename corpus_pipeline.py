"""From raw documents to token ids: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import bpe, hyperminhash, mixing, pii, quality
from webquarry.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision rules keep."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 80 %) the document with the smallest id."""
    return hyperminhash.kept_rows(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text; n_chars follows the text."""
    clean = pii.masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source targets ask for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every copy."""
    rows = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("mix_sources", mix_sources), ("encode", encode),
]

#: EM, sketches and byte-pair merges are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
