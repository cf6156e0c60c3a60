"""Streams laid out by event time: they decide before their input ends, hold what is under way, and count what comes too late."""

import datetime as dt
import glob
import os
import uuid
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webquarry.operators import jobs as J
from webquarry.operators import links
from webquarry.operators import timeline as L
from webquarry.operators.skew import ranked
from webquarry.plans import stream_queries as Q
from webquarry.session import checkpoint_dir
from webquarry.streaming import jobs as S


@pytest.fixture(scope="module")
def steady(spark):
    """A request every minute of two keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)

    def make(n):
        return spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("user_id"))

    return make


def test_limits_come_before_the_input_ends_and_little_is_held(spark, steady, monkeypatch):
    monkeypatch.setattr(S._Ordered, "block", 1)  # an entry of the store is then one held row
    held = {}
    for n in (600, 1200):
        rows = Q.laid_out(steady(n), "event_id", n // 150, 1800)
        stream = S.rate_limit_stream(rows, F.col("user_id"), window_seconds=600, limit=2, watermark="1800 seconds")
        out, told = S.run_watched(stream)
        got = {r.id: r.allowed for r in out.collect()}
        want = {r.id: r.allowed for r in L.rate_limit_admitted(steady(n), F.col("user_id"), window_seconds=600, limit=2).collect()}
        assert got == want and len(got) == n
        batches = told.orderBy("batch").collect()
        assert sum(b.late for b in batches) == 0 and len([b for b in batches if b.rows_in]) == n // 150 + 1
        held[n] = max(b.held for b in batches)
    assert held[1200] <= 1.2 * held[600] and held[1200] < 1200 * 0.5


def test_output_before_the_end(spark, steady):
    rows = Q.laid_out(steady(600), "event_id", 4, 600)
    stream = S.rate_limit_stream(rows, F.col("user_id"), window_seconds=600, limit=2, watermark="600 seconds")
    seen = []
    base = f"{checkpoint_dir(spark)}/early-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", base).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, k: seen.append(batch.count())).start().awaitTermination()
    assert sum(seen) == 600 and sum(1 for n in seen if n) >= 4 and seen[-1] < 300


def test_rows_behind_the_watermark_are_counted(spark, steady):
    base = f"{checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    rows = steady(300)
    late = "event_id >= 100 AND event_id < 110"
    for k, part in enumerate((f"event_id < 200 AND NOT ({late})", f"event_id >= 200 AND event_id < 250", f"event_id >= 250 OR ({late})")):
        rows.where(part).coalesce(1).write.parquet(f"{base}/{k}")
    end = rows.limit(1).select(F.lit(None).cast("long").alias("event_id"), F.expr(Q.END).alias("ts"), F.lit(None).cast("long").alias("user_id"))
    end.coalesce(1).write.parquet(f"{base}/3")
    stream = S.rate_limit_stream(S.read_stream(spark, f"{base}/*", rows, 1), F.col("user_id"), window_seconds=60, limit=5, watermark="600 seconds")
    out, told = S.run_watched(stream)
    assert out.count() == 290 and told.agg(F.sum("late")).first()[0] == 10


class Cell:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return [] if self.value is None else self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


@pytest.mark.parametrize("make", [lambda: S._TtlValue(), lambda: S._Limiter(10 * L.SECOND, 3)])
def test_idle_keys_leave_no_state(make):
    cells, timers = {}, []
    cell = lambda name, *_: cells.setdefault(name, Cell())
    handle = SimpleNamespace(getMapState=lambda *_: SimpleNamespace(keys=lambda: iter(()), containsKey=lambda k: False), getValueState=cell, getListState=cell, registerTimer=timers.append)
    job = make()
    job.init(handle)
    us = 1_000_000 * L.SECOND
    job.fold(("k",), pd.DataFrame({"us": [us], "id": [1], "side": [0], "value": ["v"], "ttl": [10]}))
    (state,) = cells.values()
    assert state.exists() and max(timers) >= (us + 10 * L.SECOND) // 1000
    list(job.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1000 + 5_000), None))
    assert state.exists()
    list(job.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1000 + 10_001), None))
    assert not state.exists()


def test_urls_are_known_for_ever_or_for_a_while(spark, steady):
    rows = spark.createDataFrame([(i, f"http://e.com/{u}", dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for i, (u, d) in enumerate([("a", 0), ("b", 0), ("a", 1), ("a/", 30), ("c", 200), ("d", 400), ("a", 800)])], "page_id long, url string, ts timestamp")
    for remember, want in ((None, 4), ("90 days", 5)):
        base = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
        for i in range(7):
            rows.where(F.col("page_id") == i).coalesce(1).write.parquet(f"{base}/{i}")
        out = S.run_to_table(S.page_dedup_stream(S.read_stream(spark, f"{base}/*", rows, 1), remember=remember))
        assert out.count() == want, remember


def test_a_batch_that_fails_and_comes_again_is_stored_once(spark, steady):
    base = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    pages = spark.range(30).select(F.col("id").alias("page_id"), F.concat(F.lit("http://e.com/"), "id").alias("url"))
    for k in range(3):
        pages.where(F.col("page_id") % 3 == k).coalesce(1).write.parquet(f"{base}/in/{k}")
    stream = S.read_stream(spark, f"{base}/in/*", pages, 1)
    failed = []

    def breaks(batch, k):
        if k == 1 and not failed:
            failed.append(k)
            batch.write.mode("overwrite").parquet(f"{base}/store/batch={k}")  # written, but not committed
            raise RuntimeError("lost")
        S.commit_pages(batch, f"{base}/store", k)

    start = lambda: stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(breaks).start()
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    assert S.committed_pages(spark, f"{base}/store").count() == 10
    start().awaitTermination()
    S.store_pages_stream(stream, f"{base}/store", f"{base}/state").awaitTermination()  # nothing is left to do
    assert sorted(r.page_id for r in S.committed_pages(spark, f"{base}/store").collect()) == list(range(30))


# ---- ranks, deep pages, purges, budgets ----------------------------------------------------


def test_ranks_are_dense(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = ranked(rows.repartition(7), [F.desc("g"), F.asc("k")]).collect()
    want = {(r.k, r.g): i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.g, r.k)))}
    assert {(r.k, r.g): r["rank"] for r in got} == want
    assert ranked(rows.limit(0), [F.asc("k")]).count() == 0


def test_large_selections_need_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(J, "ONE_TASK", 10)
    rows = spark.range(3000).select((F.col("id") % 1000).alias("key"), F.timestamp_seconds(F.col("id") * 37 % 500).alias("ts"))
    got = J.keep_recent_keys(rows, 500)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    want = {}
    for r in rows.collect():
        want[r.key] = max(want.get(r.key, r.ts), r.ts)
    assert {(r.key, r.ts) for r in got.collect()} == set(sorted(want.items(), key=lambda x: (-x[1].timestamp(), x[0]))[:500])
    jobs = spark.range(100).select(F.col("id").alias("job_id"), F.lit(1).alias("user_id"), F.lit("s").alias("status"), (F.col("id") % 5).alias("created_at"))
    assert [r.job_id for r in J.jobs_page(jobs, 1, page=7, limit=7).orderBy(F.desc("created_at"), F.desc("job_id")).collect()] == [r.job_id for r in jobs.orderBy(F.desc("created_at"), F.desc("job_id")).collect()][42:49]


def test_purge_leaves_other_partitions_alone(spark):
    path = f"{checkpoint_dir(spark)}/expiring-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 50), (2, "c", 50), (2, "d", None), (3, "e", 1), (3, "f", 10)], "day int, k string, until int")
    rows.repartition(2, "day").write.partitionBy("day").parquet(path)
    files = lambda: {d: sorted(glob.glob(f"{path.removeprefix('file:')}/day={d}/*.parquet")) for d in (1, 2, 3)}
    before = files()
    report = {tuple(r) for r in J.purge_store(spark, path, F.lit(10), "until", "day").collect()}
    assert report == {(1, 1, 1), (3, 2, 0)}
    after = files()
    assert after[2] == before[2] and after[1] != before[1] and not os.path.exists(f"{path.removeprefix('file:')}/day=3")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["b", "c", "d"]
    assert J.purge_store(spark, path, F.lit(10), "until", "day").count() == 0


def test_a_crawl_ends_in_the_round_that_reaches_its_budget(spark, monkeypatch):
    edges = spark.createDataFrame([(f"u{i}", f"u{3 * i + k}", k) for i in range(400) for k in (1, 2, 3)], "src string, dst string, priority long")
    seeds = spark.createDataFrame([("u0",)], "url string")
    rounds = []
    cut = links.cut_lineage
    monkeypatch.setattr(links, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    whole = links.crawl_frontier(seeds, edges).collect()
    full, rounds[:] = len(rounds), []
    for budget in (1, 3, 13, 14, 100, 5000):
        rounds.clear()
        got = links.crawl_frontier(seeds, edges, max_pages=budget).collect()
        want = sorted(whole, key=lambda r: (r.depth, -r.priority, r.url))[:budget]
        assert sorted(got, key=lambda r: (r.depth, -r.priority, r.url)) == want
        if budget <= 14:
            assert len(rounds) <= 2 + max(r.depth for r in want) < full
