"""Joins and running values that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.session import cut_lineage

SALTS = 16
LOOKUP_PARTS = 200
PART_BYTES = 8 * 1024 * 1024
DENSE = 8
PART = "__part"
_parts: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_dense: WeakKeyDictionary[DataFrame, bool] = WeakKeyDictionary()
_placed: WeakKeyDictionary[DataFrame, dict[str, DataFrame]] = WeakKeyDictionary()


def parts_of(rows: DataFrame, text: str) -> int | None:
    """Tasks for texts that are taken apart: one for every PART_BYTES, as their pieces are many times as large and are sorted.

    Left to Spark, tasks are as large as the texts are compressed.  The sizes are summed once per frame; a stream has none.
    """
    if rows.isStreaming:
        return None
    if rows not in _parts:
        size, texts = rows.agg(F.sum(F.octet_length(text)), F.count(text)).first()
        _parts[rows] = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES))
        _dense[rows] = texts >= DENSE * _parts[rows]
    return _parts[rows]


def dense(rows: DataFrame) -> bool:
    """Whether `parts_of` found several texts for a task, so that many of them share their terms."""
    return _dense.get(rows, False)


def in_parts(rows: DataFrame, parts: int | None) -> DataFrame:
    """`rows`, of which `known_parts` says from now on how many tasks they are for."""
    if parts:
        _parts[rows] = parts
    return rows


def known_parts(rows: DataFrame) -> int | None:
    return _parts.get(rows)


def laid_out(rows: DataFrame, by: str, parts: int | None) -> DataFrame:
    """`rows` exchanged on `by`, in so many parts if given."""
    return rows.repartition(parts, by) if parts else rows.repartition(by)


def dealt(rows: DataFrame, by: str, parts: int) -> DataFrame:
    """`rows` with the number of their task, by a hash of `by`, and exchanged into it.

    Groups and joins on this number and other columns follow the layout and move nothing.
    """
    part = F.coalesce(F.pmod(F.hash(by), F.lit(parts)), F.lit(0))  # never null: joins add no filter, so all who read these rows share one exchange
    return rows.withColumn(PART, part).repartitionById(parts, F.col(PART))


def placed(rows: DataFrame, **frames: DataFrame) -> DataFrame:
    """`rows`, to which these frames of `dealt` rows belong from now on; `placed_of` gives them by name."""
    _placed[rows] = frames
    return rows


def placed_of(rows: DataFrame, name: str) -> DataFrame | None:
    return _placed.get(rows, {}).get(name)


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, on: str, by: str, how: str = "inner", salts: int = SALTS, count: str | None = None, parts: int | None = None
) -> DataFrame:
    """`rows` with the columns of `lookup` (one row per `on`), exchanged into so many `parts` if given.

    Rows of one key are spread over `salts` tasks by a hash of `by`; the lookup is
    repeated once per salt.  Where its column `count`, which is left out, holds how many rows a key has,
    only keys of more rows than an average part are spread, over as many tasks as they fill parts: these keys are fewer than the parts.
    """
    if count is None:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
        copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        fills = F.ceil(F.col(count) * (parts or LOOKUP_PARTS) / lookup.agg(F.sum(count)).scalar())
        sized = lookup.withColumn("__salts", F.greatest(fills, F.lit(1)).cast("int")).drop(count)
        hot = F.broadcast(sized.filter(F.col("__salts") > 1).select(on, "__salts"))
        salted = rows.join(hot, on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
        copies = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    if parts:
        salted, copies = salted.repartition(parts, on, "__salt"), copies.repartition(parts, on, "__salt")
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def carried(
    rows: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    last: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    before: bool = False,
) -> DataFrame:
    """Adds running values per key: `last` = latest non-null value, `sums` = running totals.

    `before=True` leaves the row itself out.  The work is split by (key, bucket), where
    `bucket` is a coarse, order-preserving piece of the order (a day, an hour): windows
    run inside a bucket, one summary row per bucket carries the result over.  A key with
    a third of all rows is as many tasks as it has buckets; the window over the summary
    sees one row per bucket, a number set by the time span and not by the rows.
    """
    last, sums = dict(last or {}), dict(sums or {})
    cut = rows.withColumns({"__b": bucket, **{f"__l_{n}": c for n, c in last.items()}, **{f"__s_{n}": c for n, c in sums.items()}})
    at = F.struct(*order)
    summary = cut.groupBy(*keys, "__b").agg(
        *[F.max_by(F.col(f"__l_{n}"), F.when(F.col(f"__l_{n}").isNotNull(), at)).alias(f"__l_{n}") for n in last],
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums],
        F.count("*").alias("__n"),
    )
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "__b",
        *[F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__cl_{n}") for n in last],
        *[F.sum(f"__s_{n}").over(earlier).alias(f"__cs_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    local = cut.withColumns({
        **{f"__l_{n}": F.last(f"__l_{n}", ignorenulls=True).over(inside) for n in last},
        **{f"__s_{n}": F.sum(f"__s_{n}").over(inside) for n in sums},
    })
    out = local.join(carry, [*keys, "__b"])
    return out.select(
        *rows.columns,
        *[F.coalesce(f"__l_{n}", f"__cl_{n}").alias(n) for n in last],
        *[(F.coalesce(f"__s_{n}", F.lit(0)) + F.coalesce(f"__cs_{n}", F.lit(0))).alias(n) for n in sums],
    )


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds `name`, the place of every row from 0 on in the given order, which must be unique.

    Rows are dealt to ranges of the order and sorted there; a row's place is its place in its range plus the rows of the
    ranges before.  So no task sees more than a range, and what meets is one count for each range.
    """
    at = F.monotonically_increasing_id()  # the number of the range and the place in it
    laid = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at.alias("__at")))
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for own, n in sorted(laid.groupBy(part.alias("part")).count().collect()):  # one row for each range
        offsets.append((own, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    placed = laid.withColumn("__part", part).join(F.broadcast(starts), "__part")  # as small as the number of ranges
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__before")
