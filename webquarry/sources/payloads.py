"""JSON payloads as record tables, on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.session import cut_lineage


def json_records(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, record (VARIANT): a top-level array, else .data, .results, .items when arrays, else the object."""
    v = F.try_parse_json(F.col(body))

    def as_list(path: str) -> Column:
        return F.when(
            F.startswith(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("ARRAY")),
            F.try_variant_get("v", path, "array<variant>"),
        )

    is_object = F.startswith(F.schema_of_variant(F.col("v")), F.lit("OBJECT"))
    records = F.coalesce(
        as_list("$"), as_list("$.data"), as_list("$.results"), as_list("$.items"), F.when(is_object, F.array("v"))
    )
    return df.select(key, v.alias("v")).filter("v is not null").select(key, F.posexplode(records).alias("pos", "record"))


LEVELS_PER_ROUND = 8


def json_find_items(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, title, price, discount, rating: objects under a key holding deal, product or item, at any level.

    The walk goes down level by level inside the partition until no node is left; nodes already visited are
    carried along, so nothing is read twice and nothing is shuffled.  After LEVELS_PER_ROUND levels the nodes are
    written to the shared folder, and deeper rounds only follow where a node is still open.
    """
    node = "struct<name:string,v:variant,done:boolean>"
    rows = df.select(
        key,
        F.struct(F.lit("").alias("name"), F.try_parse_json(F.col(body)).alias("v"), F.lit(False).alias("done")).alias("n"),
    ).filter("n.v is not null")

    def visited(n: Column) -> Column:
        return F.struct(n["name"].alias("name"), n["v"].alias("v"), F.lit(True).alias("done"))

    def below(rows: DataFrame) -> DataFrame:
        kind = F.substring(F.schema_of_variant(F.col("n.v")), 1, 5)
        fields = F.transform(
            F.map_entries(F.try_variant_get("n.v", "$", "map<string,variant>")),
            lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v"), F.lit(False).alias("done")),
        )
        items = F.transform(
            F.try_variant_get("n.v", "$", "array<variant>"),
            lambda e: F.struct(F.lit("").alias("name"), e.alias("v"), F.lit(False).alias("done")),
        )
        inner = F.when(kind == "OBJEC", fields).when(kind == "ARRAY", items).otherwise(F.array().cast(f"array<{node}>"))
        step = F.when(F.col("n.done"), F.array(F.col("n"))).otherwise(
            F.concat(F.array(visited(F.col("n"))), F.filter(inner, lambda e: e["v"].isNotNull()))
        )
        return rows.select(key, F.explode(step).alias("n"))

    while True:
        for _ in range(LEVELS_PER_ROUND):
            rows = below(rows)
        rows = cut_lineage(rows)
        if rows.filter("NOT n.done").isEmpty():
            break
    name = F.lower("n.name")
    wanted = (F.contains(name, F.lit("deal")) | F.contains(name, F.lit("product")) | F.contains(name, F.lit("item"))) & (
        F.startswith(F.schema_of_variant(F.col("n.v")), F.lit("OBJECT"))
    )

    def first_of(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get("n.v", f"$.{x}", "string"), F.lit("")) for x in names])

    found = rows.filter(wanted).select(
        key,
        first_of("title", "name").alias("title"),
        first_of("price", "priceDisplay").alias("price"),
        first_of("discount", "savings").alias("discount"),
        first_of("rating").alias("rating"),
    )
    return found.filter("coalesce(title, price, discount, rating) is not null")
