"""Limiter, breaker, health and as-of reads against plain loops, with one key holding most rows and small buckets."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from webquarry.operators import timeline as L
from webquarry.operators.skew import carried, salted_lookup

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng, t, out = random.Random(7), 0.0, []
    for i in range(1500):
        t += rng.choice([0, 0.5, 1, 3, 9, 40, 90]) * rng.random()
        out.append((i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", START + dt.timedelta(seconds=round(t, 3)), rng.random() < 0.6, rng.random() * 10))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, source string, ts timestamp, ok boolean, ms double").withColumn("id", F.col("event_id"))


def by_key(rows):
    keyed = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        keyed.setdefault(r[1], []).append(r)
    return keyed


def test_sliding_count_is_exact_across_buckets(events, rows):
    got = {r.id: r.seen for r in L.rate_limit_all(events, F.col("source"), window_seconds=10, limit=3).collect()}
    for own in by_key(rows).values():
        for i, r in enumerate(own):
            assert got[r[0]] == sum(1 for o in own[: i + 1] if (r[2] - o[2]).total_seconds() < 10)


def test_open_left_bound_and_equal_times(spark):
    at = [0, 60, 60, 119.999]
    df = spark.createDataFrame([(i, "k", START + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "event_id long, k string, ts timestamp")
    got = {r.id: r.seen for r in L.rate_limit_all(df, F.col("k"), 60, 2).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3}


def test_admitted_only(events, rows):
    got = {r.id: (r.allowed, r.remaining) for r in L.rate_limit_admitted(events, F.col("source"), 10, 2).collect()}
    for own in by_key(rows).values():
        taken = []
        for r in own:
            inside = [t for t in taken if (r[2] - t).total_seconds() < 10]
            if len(inside) < 2:
                taken.append(r[2])
                assert got[r[0]] == (True, 1 - len(inside))
            else:
                assert got[r[0]] == (False, 0)


def test_failure_runs(events, rows):
    got = {r.source: r for r in L.source_health(events).collect()}
    for key, own in by_key(rows).items():
        run = 0
        for r in own:
            run = 0 if r[3] else run + 1
        assert got[key].consecutive == run
        assert got[key].status == ("UNHEALTHY" if run >= 5 else "ACTIVE")


def test_carried_and_salted(spark, events, rows):
    out = carried(events, ["source"], F.floor(F.unix_timestamp("ts") / 30), ["ts", "id"], sums={"n": F.lit(1)}, last={"good": F.when(F.col("ok"), F.col("id"))}, before=True)
    got = {r.id: (r.n, r.good) for r in out.collect()}
    for own in by_key(rows).values():
        good = None
        for i, r in enumerate(own):
            assert got[r[0]] == (i, good)
            good = r[0] if r[3] else good
    names = spark.createDataFrame([("hot", 1), ("k1", 2)], "source string, v int")
    assert salted_lookup(events, names, "source", "id").groupBy().sum("v").first()[0] == sum({"hot": 1, "k1": 2}.get(r[1], 0) for r in rows)


def test_ttl(spark):
    def at(s):
        return START + dt.timedelta(seconds=s)

    writes = spark.createDataFrame([("a", at(0), 1, "x", 10), ("a", at(5), 2, "y", 3)], "key string, ts timestamp, id long, value string, ttl_seconds long")
    reads = spark.createDataFrame([("a", at(4), 3), ("a", at(7), 4), ("a", at(8), 5), ("b", at(1), 6)], "key string, ts timestamp, id long")
    got = {r.id: (r.value, r.hit) for r in L.ttl_lookup(writes, reads).collect()}
    assert got == {3: ("x", True), 4: ("y", True), 5: (None, False), 6: (None, False)}


@pytest.mark.parametrize(("every", "limit", "seed"), [(1, 3, 0), (7, 5, 1), (30, 2, 2), (13, 1, 3)])
def test_unbroken_key_in_chunks(spark, every, limit, seed):
    """A key without pauses, where walks from a wrong state agree late or early, equals one walk over all."""
    from collections import deque

    draw = random.Random(seed)
    at, rows = 0, []
    for i in range(3000):
        at += draw.choice([0, 1, every, draw.randrange(2 * every + 1)])
        rows.append((i, at))
    rows += [(5000 + i, 10_000_000 + 61 * i) for i in range(5)]  # behind a pause, and pauses themselves
    events = spark.createDataFrame(rows, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
    times, want = deque(), {}
    for i, s in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = L.admit(times, s * 10**6, 60 * 10**6, limit)
    got = L.rate_limit_admitted(events.repartition(7), F.lit(None).cast("string"), window_seconds=60, limit=limit, chunk_seconds=300)
    rows = got.collect()
    assert {r.id: (r.allowed, r.remaining) for r in rows} == want and len(rows) == len(want) and {r.key for r in rows} == {None}


def test_chunks_of_one_key_are_many_tasks(spark):
    """Rows of one unbroken key are decided in many partitions."""
    events = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = L.rate_limit_admitted(events, F.lit("one"), window_seconds=60, limit=4, chunk_seconds=600)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 10_000
