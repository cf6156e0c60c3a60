"""Mixing sources to target weights with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.llm.common import WORD

WEIGHTS = (5, 2, 1)
PERCENT = 150
CAP = 2
SEED = "mix-1"
#: Tasks that the rows of one source are spread over.
SALTS = 64


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))


def _salt(key: str):
    return F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(SALTS)).cast("int")


def _salted(per_source: DataFrame) -> DataFrame:
    """A copy of each source's row for every salt, so that a hot source is no single task."""
    return per_source.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of each source of (source, size) rows.

    Sources in code-point order, null last, weigh `weights` in turn.  They share `percent` % of all sizes by weight;
    a source stops at `cap` times its size and the rest share what it leaves.  In the order of
    size by weight those that stop are a prefix: each stops if its cap is no more than its share of
    what the ones before it leave.  The aggregate combines before the shuffle; the windows see one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, before = W.partitionBy(), W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = per.withColumn("place", place).withColumn("weight", weight.cast("double")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    share = lambda used, left: (F.col("total") * percent / 100 - used * cap) * F.col("weight") / left
    summed = ranked.select(
        "*", F.sum("source_size").over(every).cast("double").alias("total"), F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double").alias("used"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("used_weight"),
    )
    full = F.col("source_size").cast("double") * cap
    stopped = summed.withColumn("stops", full <= share(F.col("used"), F.col("all_weight") - F.col("used_weight")))
    split = stopped.select(
        "*", F.sum(F.when(F.col("stops"), F.col("source_size")).otherwise(0)).over(every).cast("double").alias("gone"),
        F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(every).alias("left"),
    )
    return split.select("source", "source_size", F.when(F.col("stops"), full).otherwise(share(F.col("gone"), F.col("left"))).alias("target"))


def planned(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: str = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row; `copies` says how often the mix takes it.

    The rate is target / source_size: a document is taken floor(rate) times, and once more where the hash of seed
    and key falls below the fraction, so reruns agree.  Size counts words; null and blank texts have none and
    get rate 0 where their source has none at all.  A null source is a source.  Rows that
    repeat decide alike.  Other columns are left out.  One row per source and salt meets the documents, so a hot source is spread over SALTS tasks.
    """
    sized = _sized(docs, key, text, source)
    targets = _salted(source_targets(sized, weights, percent, cap).withColumnRenamed("source", "of"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return (
        sized.withColumn("__own", _salt("doc_id")).join(targets, F.col("source").eqNullSafe(F.col("of")) & (F.col("__own") == F.col("__salt")))
        .withColumn("rate", rate)
        .select("doc_id", "size", "source_size", "target", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as `planned` takes it.

    The targets are joined to the rows themselves, so a key that repeats does no harm.
    """
    cap, seed = options.get("cap", CAP), options.get("seed", SEED)
    targets = source_targets(_sized(docs, key, text, source), options.get("weights", WEIGHTS), options.get("percent", PERCENT), cap)
    rates = _salted(targets.select(F.col("source").alias("of"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")))
    id_, of, row = F.col(f"`{key}`"), F.col(f"`{source}`"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    times = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    # The rows travel as one struct, so that no name of theirs meets a name used here.
    rows = docs.select(row, id_.alias("id"), of.alias("from"), _salt(f"`{key}`").alias("own"))
    joined = rows.join(rates, F.col("from").eqNullSafe(F.col("of")) & (F.col("own") == F.col("__salt")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS place FROM per
), ranked AS (
  SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM placed
), summed AS (
  SELECT *, (SUM(source_size) OVER ())::DOUBLE AS total, SUM(weight) OVER () AS all_weight,
    COALESCE(SUM(source_size) OVER b, 0)::DOUBLE AS used, COALESCE(SUM(weight) OVER b, 0) AS used_weight
  FROM ranked WINDOW b AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, source_size::DOUBLE * 2 <= (total * {PERCENT} / 100 - used * 2) * weight / (all_weight - used_weight) AS stops FROM summed
), split AS (
  SELECT *, (SUM(CASE WHEN stops THEN source_size ELSE 0 END) OVER ())::DOUBLE AS gone,
    SUM(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS left_weight FROM stopped
), targets AS (
  SELECT source, source_size,
    CASE WHEN stops THEN source_size::DOUBLE * 2 ELSE (total * {PERCENT} / 100 - gone * 2) * weight / left_weight END AS target FROM split
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || md5('{SEED}:' || COALESCE(doc_id::VARCHAR, ''))[1:12])::BIGINT::DOUBLE / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
