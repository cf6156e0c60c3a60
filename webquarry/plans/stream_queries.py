"""Registered queries over event timelines, in batch and as streams (with their SQL twins)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webquarry.operators import timeline as L
from webquarry.plans.derived import read
from webquarry.session import checkpoint_dir
from webquarry.streaming import jobs as S



def keyed_limits(spark, sf):
    return L.rate_limit_all(read(spark, sf, "events"), F.col("user_id") % 10, window_seconds=6 * 3600, limit=8)


def q_rate_limit_all(spark, sf):
    out = keyed_limits(spark, sf)
    return out.select("id", "key", "seen", F.col("allowed").cast("int").alias("allowed"), "remaining")


def q_rate_limit_admitted(spark, sf):
    out = L.rate_limit_admitted(read(spark, sf, "events"), F.col("user_id") % 10, window_seconds=6 * 3600, limit=3)
    return out.select("id", "key", F.col("allowed").cast("int").alias("allowed"), "remaining")


def q_rate_limit_unbroken(spark, sf):
    """Two keys that never pause, in chunks of a few days."""
    out = L.rate_limit_admitted(read(spark, sf, "events"), F.col("event_id") % 2, window_seconds=12 * 3600, limit=5, chunk_seconds=2 * 86400)
    return out.select("id", "key", F.col("allowed").cast("int").alias("allowed"), "remaining")


def q_limit_report(spark, sf):
    out = L.limit_report(keyed_limits(spark, sf))
    return out.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd"))


def outcomes(spark, sf):
    return as_outcomes(read(spark, sf, "events"))


def as_outcomes(events):
    """Events as results of sources; errors and signups count as failures."""
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source"), "ts",
        (~F.col("event_type").isin("error", "signup")).alias("ok"),
        F.col("value").alias("ms"))


def q_error_rate(spark, sf):
    out = L.error_rate(outcomes(spark, sf), window_seconds=6 * 3600, buckets=6)
    return out.select("source", F.unix_timestamp("window_start").alias("window_start"), "requests", "failures", F.round("error_percent", 6).alias("error_percent"))


def q_source_health(spark, sf):
    return L.source_health(outcomes(spark, sf)).withColumn("avg_ms", F.round("avg_ms", 6))


def q_source_summary(spark, sf):
    return L.source_summary(L.source_health(outcomes(spark, sf))).withColumns({"avg_ms": F.round("avg_ms", 6), "success_rate": F.round("success_rate", 6)})


def q_source_ranking(spark, sf):
    return L.least_used(L.source_health(outcomes(spark, sf)), 5).select("source", "used", F.round("rate", 6).alias("rate"))


def q_source_weights(spark, sf):
    out = L.weighted_shares(L.source_health(outcomes(spark, sf)))
    return out.withColumns({"weight": F.round("weight", 6), "share": F.round("share", 6)})


def q_round_robin(spark, sf):
    return L.round_robin(read(spark, sf, "events"), ["p1", "p2", "p3"]).select("event_id", "source")


def updates(events):
    return events.select(
        (F.col("event_id") % 400).alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"),
        (F.col("value") % 100).alias("progress"), F.concat(F.lit("step "), F.col("event_id").cast("string")).alias("message"))


def q_progress_latest(spark, sf):
    return L.progress_latest(updates(read(spark, sf, "events"))).withColumn("progress", F.round("progress", 6))


def q_action_counts(spark, sf):
    return L.actions_by_type(updates(read(spark, sf, "events")))


def ttl_line(events):
    side = F.when(F.col("event_type").isin("purchase", "signup"), 0).otherwise(1)
    return events.select((F.col("user_id") % 40).alias("key"), "ts", F.col("event_id").alias("id"), side.alias("side"),
                         F.when(side == 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"), F.lit(4 * 3600).alias("ttl"))


def q_ttl_lookup(spark, sf):
    line = ttl_line(read(spark, sf, "events"))
    writes = line.filter("side = 0").withColumnRenamed("ttl", "ttl_seconds").drop("side")
    out = L.ttl_lookup(writes, line.filter("side = 1").select("key", "ts", "id"))
    return out.withColumn("hit", F.col("hit").cast("int"))


# ---- streams ------------------------------------------------------------------------------

#: How long a row is under way at most; the watermark waits as long.
LATENESS = 6 * 3600
LATE = f"{LATENESS} seconds"
END = "timestamp '2100-01-01 00:00:00'"


def stream(spark, sf, table="events", end="ts", parts=6, lateness=LATENESS):
    """The table in the order in which its rows come in: each a while after its time `ts`, given by a hash of its key, and `lateness` seconds at most.

    It comes in `parts` slices of that order, a trigger each, of as many files as the table has partitions; with `end`, a row far in the
    future follows, which tells the end.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    rows = read(spark, sf, table)
    return laid_out(rows, rows.columns[0], parts, lateness, end)


def laid_out(rows, key, parts, lateness, end="ts"):
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/webquarry/input-{uuid.uuid4().hex}"
    files = max(1, rows.rdd.getNumPartitions())
    comes = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64(F.lit("late"), key), F.lit(lateness * 1_000_000 + 1))
    first, last = rows.agg(F.min(comes), F.max(comes)).first()
    part = F.coalesce(F.least(F.floor((comes - (first or 0)) * parts / ((last or 0) - (first or 0) + 1)), F.lit(parts - 1)), F.lit(0))
    for k in range(parts):  # one after the other, as a stream takes older files first
        rows.where(part == k).repartition(files, F.xxhash64(key)).write.mode("append").parquet(f"{folder}/{k}")
    if end:
        marker = rows.select(*[F.expr(END).cast(f.dataType).alias(f.name) if f.name == end else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        marker.limit(1).coalesce(1).write.parquet(f"{folder}/{parts}")
    return S.read_stream(spark, f"{folder}/*", rows, files_per_trigger=files)


def q_rate_limit_stream(spark, sf):
    out = S.run_to_table(S.rate_limit_stream(stream(spark, sf), F.col("user_id") % 10, window_seconds=6 * 3600, limit=3, watermark=LATE))
    return out.select("id", "key", F.col("allowed").cast("int").alias("allowed"), "remaining")


def _stream_outcomes(spark, sf):
    return as_outcomes(stream(spark, sf))


def q_health_stream(spark, sf):
    out = S.run_to_table(S.health_stream(_stream_outcomes(spark, sf), watermark=LATE), "update")
    last = out.groupBy("source").agg(F.max_by(F.struct("successes", "failures", "consecutive", "avg_ms", "status"), "batch").alias("h"))
    return last.select("source", "h.*").withColumn("avg_ms", F.round("avg_ms", 6))


def q_progress_stream(spark, sf):
    out = S.run_to_table(S.progress_stream(updates(stream(spark, sf, end=None))), "update")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "message", "updates"), "batch").alias("p"))
    return last.select("job_id", "p.*").withColumn("progress", F.round("progress", 6))


def fetched(spark, sf, parts=4):
    """Every page fetched three times: at a time given by its id, again a quarter of an hour later and thirty days later, the stream being laid out by time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    pages = read(spark, sf, "pages").select("page_id", "url")
    again = F.explode(F.array(F.lit(0), F.lit(900), F.lit(30 * 86400))).alias("after")
    times = pages.select("page_id", "url", again).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("page_id"), F.lit(86400)) + F.col("after")))
    rows = times.withColumn("fetch", F.concat_ws("/", "page_id", "after")).drop("after")
    return laid_out(rows, "fetch", parts, 0, end=None).select("page_id", "url", "ts")


def q_stream_page_dedup(spark, sf):
    out = S.run_to_table(S.page_dedup_stream(fetched(spark, sf)))
    return out.select("norm_url")


def q_store_pages_stream(spark, sf):
    """Pages streamed into the store, every batch tried twice, beside the remains of one that never ended."""
    pages = laid_out(read(spark, sf, "pages").withColumn("ts", F.timestamp_seconds("page_id")), "page_id", 3, 0, end=None).drop("ts")
    base = f"{checkpoint_dir(spark)}/webquarry/store-{uuid.uuid4().hex}"

    def twice(batch, batch_id):
        S.commit_pages(batch, base, batch_id)
        S.commit_pages(batch, base, batch_id)

    pages.writeStream.option("checkpointLocation", f"{base}-state").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    read(spark, sf, "pages").limit(5).write.parquet(f"{base}/batch=1000")
    return S.committed_pages(spark, base).select("page_id", "url", F.length("html").cast("long").alias("chars"))


def q_ttl_stream(spark, sf):
    out = S.run_to_table(S.ttl_stream(ttl_line(stream(spark, sf)), watermark=LATE))
    return out.withColumn("hit", F.col("hit").cast("int")).withColumn("key", F.col("key").cast("long"))


QUERIES = {
    "rate_limit_all": q_rate_limit_all, "rate_limit_admitted": q_rate_limit_admitted, "rate_limit_unbroken": q_rate_limit_unbroken, "limit_report": q_limit_report, "error_rate": q_error_rate,
    "source_health": q_source_health, "source_summary": q_source_summary,
    "source_ranking": q_source_ranking, "source_weights": q_source_weights, "round_robin": q_round_robin, "progress_latest": q_progress_latest,
    "action_counts": q_action_counts, "ttl_lookup": q_ttl_lookup, "rate_limit_stream": q_rate_limit_stream, 
    "health_stream": q_health_stream, "progress_stream": q_progress_stream, "stream_page_dedup": q_stream_page_dedup, "ttl_stream": q_ttl_stream, "store_pages_stream": q_store_pages_stream,
}

# ---- SQL twins ----------------------------------------------------------------------------

ALL = """rl as (select event_id id, (user_id % 10)::varchar as key, ts, count(*) over (partition by user_id % 10 order by ts range between interval '21599.999999' second preceding and current row)
   - count(*) over (partition by user_id % 10, ts) + row_number() over (partition by user_id % 10, ts order by event_id) seen from events)"""
def admitted(key, window_us, limit):
    """One request after the other, with the admissions that count."""
    alive = f"list_filter(st.keep, lambda t: t > n.us - {window_us})"
    return f"""with recursive n as (select event_id id, {key} k, epoch_us(ts) us, row_number() over (partition by {key} order by ts, event_id) rn from events),
st(k, rn, id, ok, keep) as (
  select k, rn, id, true, [us] from n where rn = 1
  union all
  select n.k, n.rn, n.id, len({alive}) < {limit}, case when len({alive}) < {limit} then list_append({alive}, n.us) else {alive} end
  from st join n on n.k = st.k and n.rn = st.rn + 1)
select id, k::varchar as key, ok::int as allowed, case when ok then {limit} - len(keep) else 0 end::bigint as remaining from st"""


ADMITTED = admitted("user_id % 10", 21600000000, 3)
OUT = "oc as (select event_id id, 's' || (user_id % 12) source, ts, event_type not in ('error', 'signup') ok, value ms from events)"
HEALTH = f"""{OUT}, g as (select *, sum(ok::int) over (partition by source order by ts, id) grp from oc),
r as (select *, case when ok then 0 else count(*) filter (where not ok) over (partition by source, grp order by ts, id) end run from g),
h as (select source, count(*) filter (where ok) successes, count(*) filter (where not ok) failures, arg_max(run, (ts, id)) consecutive,
   avg(ms) filter (where ok) avg_ms, case when arg_max(run, (ts, id)) >= 5 then 'UNHEALTHY' else 'ACTIVE' end status from r group by 1)"""
PROGRESS = """select event_id % 400 as job_id, arg_max(event_type, ts) as status, round(arg_max(value % 100, ts), 6) as progress,
'step ' || arg_max(event_id, ts) as message, count(*) as updates from events group by 1"""
TTL = """with w as (select user_id % 40 k, ts, event_id from events where event_type in ('purchase', 'signup')),
r as (select user_id % 40 k, ts, event_id from events where event_type not in ('purchase', 'signup'))
select r.event_id as id, r.k as key, case when r.ts < w.ts + interval 4 hour then 'v' || w.event_id end as value, coalesce(r.ts < w.ts + interval 4 hour, false)::int as hit
from r asof left join w on r.k = w.k and r.ts >= w.ts"""
ORACLE = {
    "rate_limit_all": f"with {ALL} select id, key, seen, (seen <= 8)::int as allowed, greatest(0, 8 - seen) as remaining from rl",
    "rate_limit_admitted": ADMITTED, "rate_limit_unbroken": admitted("event_id % 2", 43200000000, 5),
    "limit_report": f"with {ALL} select strftime(date_trunc('day', ts), '%Y-%m-%d') as period_start, count(*) as total, count(*) filter (where seen > 8) as refused, count(distinct key) as active_keys from rl group by 1",
    "error_rate": f"""with {OUT}, x as (select source, ok, time_bucket(interval 1 hour, ts) - unnest(range(6)) * interval 1 hour ws from oc)
select source, epoch(ws)::bigint as window_start, count(*) as requests, count(*) filter (where not ok) as failures, round(count(*) filter (where not ok) * 100 / count(*), 6) as error_percent from x group by 1, 2""",
    "source_health": f"with {HEALTH} select source, successes, failures, consecutive, round(avg_ms, 6) as avg_ms, status from h",
    "source_summary": f"with {HEALTH} select count(*) as sources, count(*) filter (where status = 'ACTIVE') as active, count(*) filter (where status = 'UNHEALTHY') as unhealthy, "
    "round(avg(avg_ms), 6) as avg_ms, sum(successes + failures)::bigint as requests, round(sum(successes) / sum(successes + failures), 6) as success_rate from h",
    "source_ranking": f"with {HEALTH} select source, successes + failures as used, round(successes / (successes + failures), 6) as rate from h order by used, successes / (successes + failures) desc, source desc limit 5",
    "source_weights": f"with {HEALTH} select source, round(successes / (successes + failures), 6) as weight, round(successes / (successes + failures) / sum(successes / (successes + failures)) over (), 6) as share from h",
    "round_robin": "select event_id, ['p1','p2','p3'][(row_number() over (order by ts, event_id) - 1) % 3 + 1] as source from events",
    "progress_latest": PROGRESS, "action_counts": "select event_type as status, count(*) as events from events group by 1",
    "ttl_lookup": TTL, "rate_limit_stream": ADMITTED,
    "health_stream": f"with {HEALTH} select source, successes, failures, consecutive, round(avg_ms, 6) as avg_ms, status from h",
    "progress_stream": PROGRESS, "ttl_stream": TTL, "store_pages_stream": "select page_id, url, length(html) as chars from pages",
    "stream_page_dedup": "select distinct regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as norm_url from pages",
}
