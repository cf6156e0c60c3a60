"""Registered queries over attempts, errors, jobs, reuse and conversations (with their SQL twins)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webquarry.operators import jobs as J
from webquarry.operators import selection as G
from webquarry.oracles import sql as O
from webquarry.plans.derived import cte, derive, read
from webquarry.session import checkpoint_dir

TIERS = "http cheerio jina smart browser".split()


def attempts(spark, sf):
    """Events as fetch attempts: four per item, over five tiers."""
    quality = F.get_json_object("props", "$.k").cast("double") / 100
    return read(spark, sf, "events").select(
        F.floor(F.col("event_id") / 4).alias("item_id"),
        F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("event_id") * 7 % 5 + 1).cast("int")).alias("tier"),
        (F.col("event_type") != "error").alias("success"), (F.col("value") > 5).alias("valid"), (quality >= 0.5).alias("sufficient"),
        quality.alias("quality"), F.col("value").alias("duration_ms"), "ts",
        F.when(F.col("user_id") % 3 == 0, "speed").when(F.col("user_id") % 3 == 1, "cost").otherwise("quality").alias("strategy"),
    )


def q_cascade_own_policy(spark, sf):
    book = G.Policies()
    book.register("careful", (G.Tier("browser", min_quality=0.6), G.Tier("http")))
    return G.cascade_select(attempts(spark, sf), book.get("careful"))


def q_cascade(policy):
    def run(spark, sf):
        return G.cascade_select(attempts(spark, sf), G.Policies().get(policy))

    return run


def q_route_by_pattern(spark, sf):
    return derive(spark, sf, "outbound_urls").select("event_id", F.array_join(G.route_by_pattern(F.col("url")), ">").alias("route"))


def q_attempt_stats(spark, sf):
    return G.attempt_stats(attempts(spark, sf)).withColumns({"success_rate": F.round("success_rate", 6), "avg_ms": F.round("avg_ms", 6)})


def q_request_intent(spark, sf):
    parts = G.request_intent(F.col("text"))
    flags = {c: parts[c].cast("int").alias(c) for c in ("refresh", "deep")}
    return derive(spark, sf, "asks").select("event_id", parts["url"].alias("url"), parts["question"].alias("question"), flags["refresh"], flags["deep"])


def q_conversation_intent(spark, sf):
    parts = G.request_intent(F.col("text"))
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", parts["url"].alias("url"), parts["question"].alias("question"), parts["deep"].cast("int").alias("deep"))


def errors(spark, sf):
    return derive(spark, sf, "fetch_errors").withColumn("kind", G.error_class(F.col("message"), F.col("status")))


def q_classify_errors(spark, sf):
    return errors(spark, sf).select("event_id", "kind", G.is_retryable(F.col("kind")).cast("int").alias("retryable"),
                                    G.retry_after(F.col("kind")).cast("long").alias("retry_after"))


def q_retry_delay(spark, sf):
    rows = errors(spark, sf)
    return rows.select(
        "event_id", F.round(G.retry_delay(F.col("kind"), F.col("attempt")), 3).alias("delay"),
        F.round(G.simple_delay(F.col("message"), F.col("attempt")), 3).alias("simple"),
    )


def fetches(spark, sf):
    return derive(spark, sf, "fetch_errors").select(
        F.col("status").isNull().alias("success"), F.coalesce("status", F.lit(200)).alias("status"), F.col("attempt").alias("retries"),
        F.col("value").alias("duration_ms"), "ts")


def q_fetch_stats(spark, sf):
    out = G.fetch_stats(fetches(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_finished_ms", "avg_failed_ms", "finished_per_minute", "failed_per_minute")})


def q_fetch_histograms(spark, sf):
    return G.fetch_histograms(fetches(spark, sf))


def jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 50).alias("session_id"),
        status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("duration_ms"))


def q_jobs_page(spark, sf):
    return J.jobs_page(jobs(spark, sf), 7, page=2, limit=3).select("job_id", "status", "created_at", "total")


def q_jobs_by_session(spark, sf):
    return J.jobs_by_session(jobs(spark, sf), 9).select("job_id", "user_id", "created_at")


def q_recent_jobs(spark, sf):
    return J.recent_jobs(jobs(spark, sf), 25).select("job_id", "status", "created_at")


def q_job_statistics(spark, sf):
    return J.job_statistics(jobs(spark, sf))


def q_user_job_statistics(spark, sf):
    return J.job_statistics(jobs(spark, sf), 7)


def updates(spark, sf):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "queued", "click", "running", "purchase", "completed", "error", "failed", "signup", "cancelled")])
    return read(spark, sf, "events").select(
        (F.col("event_id") % 1500).alias("job_id"), F.element_at(kinds, F.col("event_type")).alias("status"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("duration_ms"))


def q_job_state(spark, sf):
    out = J.job_state(updates(spark, sf))
    return out.withColumn("execution_ms", F.round("execution_ms", 3))


NOW = "timestamp '2024-01-20 00:00:00'"


def store(spark, sf):
    """Results by key: the last event of each key, valid for ten days."""
    rows = read(spark, sf, "events").groupBy((F.col("event_id") % 700).cast("string").alias("key")).agg(
        F.max_by("event_type", "ts").alias("value"), F.max("ts").alias("ts"))
    return rows.select("key", "value", (F.col("ts") + F.expr("interval '10' day") - F.expr("interval '11' day") * (F.col("key").cast("int") % 2)).alias("expires_at"))


def requests(spark, sf):
    return read(spark, sf, "events").select((F.col("event_id") % 900).cast("string").alias("key"))


def q_fresh_or_recompute(spark, sf):
    reused, todo, _ = J.fresh_or_recompute(requests(spark, sf), store(spark, sf), F.expr("timestamp '2024-01-30 12:00:00'"))
    return reused.withColumn("state", F.lit("reused")).unionByName(todo.select("key", "requests", F.lit(None).cast("string").alias("value"), F.lit("compute").alias("state")))


def q_session_reuse(spark, sf):
    rows = read(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 20).alias("session_id"), (F.col("event_id") % 3).cast("string").alias("url"), "event_type")
    done = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("job_id"), "session_id", "url", F.lit("completed").alias("status"), F.col("ts").alias("completed_at"))
    asked = rows.filter("event_type <> 'purchase'").select(F.col("event_id").alias("request_id"), "session_id", "url", "ts")
    return J.session_reuse(asked, done, max_age=86400 * 3)


def q_cache_key(spark, sf):
    task = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return read(spark, sf, "documents").select("doc_id", J.cache_key(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")), F.col("lang"), task).alias("key"))


def q_purge_expired(spark, sf):
    rows = read(spark, sf, "events").withColumn("expires_at", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("interval '1' day")))
    kept = J.drop_expired(rows, F.expr(NOW), F.col("expires_at")).groupBy("event_type").agg(F.count("*").alias("kept"))
    return kept


def q_purge_store(spark, sf):
    """The store after the expired rows are gone: rows by day and type."""
    path = f"{checkpoint_dir(spark)}/webquarry/expiring-{uuid.uuid4().hex}"
    rows = read(spark, sf, "events").withColumn("expires_at", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("interval '1' day")))
    rows.withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int")).write.partitionBy("day").parquet(path)
    J.purge_store(spark, path, F.expr(NOW), "expires_at", "day")
    return spark.read.parquet(path).groupBy("day", "event_type").agg(F.count("*").alias("rows"))


def q_keep_lru_half(spark, sf):
    """Half of very many keys, more than a top-n should put through one task."""
    keys = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_shipdate").alias("ts"))
    return J.keep_recent_keys(keys, keys.select("key").distinct().count() // 2)


def q_jobs_page_deep(spark, sf):
    """A page behind two thirds of the jobs of all users together."""
    rows = jobs(spark, sf).withColumn("user_id", F.lit(1))
    return J.jobs_page(rows, 1, page=2 * rows.count() // 3 // 50 + 1, limit=50).select("job_id", "status", "created_at", "total")


def q_count_expired(spark, sf):
    return J.count_expired(read(spark, sf, "events"), F.expr(NOW), F.col("ts") + F.expr("interval '1' day"))


def _keys(spark, sf):
    return read(spark, sf, "events").select((F.col("event_id") % 333).alias("key"), "ts")


def q_keep_lru(spark, sf):
    return J.keep_recent_keys(_keys(spark, sf), 40)


def q_keep_fifo(spark, sf):
    return J.keep_recent_keys(_keys(spark, sf), 40, "fifo")


def q_conversation_history(spark, sf):
    out = J.conversation_history(read(spark, sf, "conversations"))
    return out.select("conv_id", "part", F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "|").alias("history"))


def q_chat_context(spark, sf):
    return read(spark, sf, "documents").select("doc_id", J.chat_context(F.col("text")).alias("context"))


QUERIES = {
    "cascade_own_policy": q_cascade_own_policy, "cascade_speed": q_cascade("speed"), "cascade_cost": q_cascade("cost"), "cascade_quality": q_cascade("quality"),
    "route_by_pattern": q_route_by_pattern, "attempt_stats": q_attempt_stats, "request_intent": q_request_intent,
    "conversation_intent": q_conversation_intent, "classify_errors": q_classify_errors, "retry_delay": q_retry_delay,
    "fetch_stats": q_fetch_stats, "fetch_histograms": q_fetch_histograms, "jobs_page": q_jobs_page, "jobs_by_session": q_jobs_by_session,
    "recent_jobs": q_recent_jobs, "job_statistics": q_job_statistics, "user_job_statistics": q_user_job_statistics, "job_state": q_job_state,
    "fresh_or_recompute": q_fresh_or_recompute, "session_reuse": q_session_reuse, "cache_key": q_cache_key, "purge_expired": q_purge_expired, "purge_store": q_purge_store, "keep_lru_half": q_keep_lru_half, "jobs_page_deep": q_jobs_page_deep,
    "count_expired": q_count_expired, "keep_lru": q_keep_lru, "keep_fifo": q_keep_fifo, "conversation_history": q_conversation_history,
    "chat_context": q_chat_context,
}

# ---- SQL twins ----------------------------------------------------------------------------

ATT = """att as (select event_id // 4 item_id, ['http','cheerio','jina','smart','browser'][event_id * 7 % 5 + 1] tier, event_type <> 'error' ok,
  value > 5 valid, json_extract(props, '$.k')::double / 100 quality, value duration_ms, ts,
  case user_id % 3 when 0 then 'speed' when 1 then 'cost' else 'quality' end strategy from events)"""


def cascade(rank, test):
    return f"""with {ATT}, r as (select *, {rank} rk, ok and ({test}) good from att),
b as (select * from r where good and rk is not null qualify row_number() over (partition by item_id order by rk, ts) = 1),
n as (select item_id, count(rk) tried from r group by 1)
select n.item_id, b.tier, b.rk::bigint as rank, b.quality, b.duration_ms, n.tried, case when b.tier is null then 'failed' else 'selected' end as status from n left join b using (item_id)"""


DELAY = "when k = 'TIMEOUT' then 5000 when k = 'NETWORK_ERROR' then 3000 when k = 'RATE_LIMITED' then 60000 when k = 'SERVER_ERROR' then 10000 when k = 'UNKNOWN' then 5000"
ERR = """er as (select event_id, event_id % 5 attempt, event_id % 12 c, ['TIMEOUT','NETWORK_ERROR','RATE_LIMITED','BLOCKED','AUTH_REQUIRED','NOT_FOUND','SERVER_ERROR','CAPTCHA',
  'BLOCKED','PARSE_ERROR','UNKNOWN','UNKNOWN'][event_id % 12 + 1] k from events)"""
JOBS = """jb as (select o_orderkey job_id, o_custkey user_id, o_custkey % 50 session_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end status,
  o_orderdate created_at, o_totalprice duration_ms from orders)"""
STATS = "count(*) as jobs, floor(avg(duration_ms) + 0.5)::bigint as avg_duration"
FETCH = "fe as (select event_id % 12 in (0,1,7,8,9,10,11) ok, case event_id % 12 when 2 then 429 when 3 then 403 when 4 then 401 when 5 then 404 when 6 then 503 else 200 end st, event_id % 5 retries, value, ts from events)"
_W = r"(?i)\b(refresh|rescrape|force|new\s*scrape)\b"
_D = r"(?i)\b(all\s*details|explore|deep\s*scrape|click|visit\s*all|follow\s*links|learn\s*more|ai\s*agent)\b"


def intent(table, key):
    return f"""with {cte('asks')}, a as (select {key}, regexp_matches(text, {O.q(_W)}) refresh, {O.trim(f"regexp_replace(text, {O.q(_W)}, '')")} rest from {table}),
b as (select *, nullif(regexp_extract(rest, '(?i)(https?://[^\\s]+)', 1), '') url from a)
select {key}, url, {O.trim("case when url is null then rest else rest[1:position(url in rest) - 1] || rest[position(url in rest) + length(url):] end")} as question,
refresh::int as refresh, regexp_matches(rest, {O.q(_D)})::int as deep from b"""


ORACLE = {
    "cascade_own_policy": cascade("case tier when 'browser' then 0 when 'http' then 1 end", "tier <> 'browser' or quality >= 0.6"),
    "cascade_speed": cascade("case tier when 'http' then 0 when 'smart' then 1 when 'browser' then 2 end", "tier <> 'http' or (valid and quality >= 0.5)"),
    "cascade_cost": cascade("case tier when 'http' then 0 when 'cheerio' then 1 when 'jina' then 2 when 'browser' then 3 end",
                            "tier = 'browser' or (quality >= 0.5 and (tier = 'jina' or valid))"),
    "cascade_quality": cascade("case tier when 'smart' then 0 when 'jina' then 1 when 'http' then 2 end",
                               "tier = 'http' or (tier = 'smart' and quality >= 0.7) or (tier = 'jina' and quality >= 0.6)"),
    "route_by_pattern": "select event_id, case when event_id % 9 = 2 then 'playwright>jina>http' else 'http>jina>playwright' end as route from events",
    "attempt_stats": f"with {ATT} select strategy, tier, count(*) as runs, round(avg(ok::int), 6) as success_rate, round(avg(duration_ms), 6) as avg_ms from att group by rollup (strategy, tier)",
    "request_intent": intent("asks", "event_id"),
    "conversation_intent": "select conv_id, turn, url, question, deep from (" + intent("conversations", "conv_id, turn") + ")",
    "classify_errors": f"with {ERR} select event_id, k as kind, (k in ('TIMEOUT','NETWORK_ERROR','RATE_LIMITED','SERVER_ERROR','UNKNOWN'))::int as retryable, case {DELAY} end::bigint as retry_after from er",
    "retry_delay": f"with {ERR} select event_id, case when attempt >= 3 then null {DELAY} end::double as delay, "
    "case when c <> 11 and attempt < 2 then 1000 * 2 ** attempt end::double as simple from er",
    "fetch_stats": f"""with {FETCH}, m as (select (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 mi from fe)
select count(*) filter (where ok) as finished, count(*) filter (where not ok) as failed, sum(retries)::bigint as retries, min(value) filter (where ok) as min_ms, max(value) filter (where ok) as max_ms,
round(avg(value) filter (where ok), 6) as avg_finished_ms, round(avg(value) filter (where not ok), 6) as avg_failed_ms,
round(count(*) filter (where ok) / any_value(mi), 6) as finished_per_minute, round(count(*) filter (where not ok) / any_value(mi), 6) as failed_per_minute from fe, m""",
    "fetch_histograms": f"with {FETCH} select 'status' as kind, st::bigint as value, count(*) as fetches from fe group by all union all select 'retries', retries, count(*) from fe group by all",
    "jobs_page": f"with {JOBS} select job_id, status, created_at, count(*) over () as total from jb where user_id = 7 order by created_at desc, job_id desc limit 3 offset 3",
    "jobs_by_session": f"with {JOBS} select job_id, user_id, created_at from jb where session_id = 9",
    "recent_jobs": f"with {JOBS} select job_id, status, created_at from jb order by created_at desc, job_id desc limit 25",
    "job_statistics": f"with {JOBS} select status, {STATS} from jb group by 1",
    "user_job_statistics": f"with {JOBS} select status, {STATS} from jb where user_id = 7 group by 1",
    "job_state": """with u as (select event_id % 1500 job_id, case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'cancelled' end st,
  ts, event_id, value, row_number() over (partition by event_id % 1500 order by ts, event_id) n from events),
w as (select u.*, last_value(case when st <> 'cancelled' then st end ignore nulls) over (partition by job_id order by n) work from u),
f as (select *, case when st <> 'cancelled' then st when coalesce(work, 'queued') in ('queued', 'running') then 'cancelled' else work end eff from w),
z as (select job_id, arg_max(eff, n) status, max(ts) filter (where st = 'running') started_at, max(ts) filter (where st in ('completed', 'failed')) completed_at, arg_max(value, n) d from f group by 1)
select job_id, status, started_at, completed_at, round(coalesce((epoch_us(completed_at) - epoch_us(started_at)) / 1000.0, d), 3)::double as execution_ms from z""",
    "fresh_or_recompute": """with s as (select event_id % 700 k, arg_max(event_type, ts) v, max(ts) + interval 10 day - interval 11 day * (event_id % 700 % 2) x from events group by event_id % 700),
r as (select event_id % 900 k, count(*) n from events group by 1)
select r.k::varchar as key, n as requests, v as value, case when s.k is null then 'compute' else 'reused' end as state from r left join s on r.k = s.k and timestamp '2024-01-30 12:00:00' < x""",
    "session_reuse": """with e as (select event_id, ts, user_id % 20 s, event_id % 3 u, event_type from events),
r as (select q.event_id, arg_max(struct_pack(id := d.event_id, t := d.ts), d.ts) b, any_value(q.ts) qts from e q left join e d on d.event_type = 'purchase' and d.s = q.s and d.u = q.u and d.ts <= q.ts
  where q.event_type <> 'purchase' group by 1)
select event_id as request_id, case when qts - b.t < interval 3 day then b.id end as job_id from r""",
    "cache_key": "select doc_id, 'scrape:http://x/' || doc_id || ':' || lang || ':' || case when doc_id % 3 = 0 or text = '' then 'default' else sha256(text)[1:8] end as key from documents",
    "purge_expired": f"select event_type, count(*) as kept from events where event_type = 'view' or {NOW} < ts + interval 1 day group by 1",
    "purge_store": f"select strftime(ts, '%Y%m%d')::int as day, event_type, count(*) as rows from events where event_type = 'view' or {NOW} < ts + interval 1 day group by 1, 2",
    "keep_lru_half": "with k as (select l_orderkey * 10 + l_linenumber as key, max(l_shipdate) as ts from lineitem group by 1) select key, ts from k qualify row_number() over (order by ts desc, key) <= (select count(*) // 2 from k)",
    "jobs_page_deep": f"with {JOBS} select job_id, status, created_at, count(*) over () as total from jb qualify (row_number() over (order by created_at desc, job_id desc) - 1) // 50 = 2 * count(*) over () // 3 // 50",
    "count_expired": f"select count(*) filter (where {NOW} >= ts + interval 1 day) as expired, count(*) filter (where {NOW} < ts + interval 1 day) as kept from events",
    "keep_lru": "select event_id % 333 as key, max(ts) as ts from events group by 1 order by 2 desc, 1 limit 40",
    "keep_fifo": "select event_id % 333 as key, min(ts) as ts from events group by 1 order by 2 desc, 1 limit 40",
    "conversation_history": "select conv_id, turn // 1000 as part, string_agg(case when role = 'assistant' then 'model' else 'user' end || ':' || text, '|' order by turn, role, text) as history from conversations group by 1, 2",
    "chat_context": "select doc_id, text || ' ' as context from documents",
}
