"""Job tables, result reuse and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.operators.skew import carried, micros, ranked
from webquarry.session import cut_lineage

TTL_SECONDS, SESSION_REUSE_SECONDS = 3600, 300
#: Rows that a top-n may put through one task; beyond, rows are ranked by ranges of the order.
ONE_TASK = 10_000
CACHE_MODES = ("enabled", "disabled", "bypass", "read_only")


def jobs_page(jobs: DataFrame, user: object, status: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """One page of a user's jobs, newest first, with the total in `total`.

    A bounded top-n for the first pages; pages far down are cut from ranks, as a top-n would put all pages before through one task.
    """
    mine = jobs.filter(F.col("user_id") == F.lit(user))
    if status is not None:
        mine = mine.filter(F.col("status") == status)
    total = mine.agg(F.count("*")).scalar()
    order, start = [F.desc("created_at"), F.desc("job_id")], (page - 1) * limit
    return first_rows(mine, order, start + limit, start).withColumn("total", total)


def first_rows(rows: DataFrame, order: list[Column], n: int, start: int = 0) -> DataFrame:
    """The rows from place `start` up to place `n` of a unique order: a top-n while that is bounded, by ranks beyond."""
    if n <= ONE_TASK:
        return rows.orderBy(*order).offset(start).limit(n - start)
    return ranked(rows, order, "__rank").where((F.col("__rank") >= start) & (F.col("__rank") < n)).drop("__rank")


def jobs_by_session(jobs: DataFrame, session: object) -> DataFrame:
    return jobs.filter(F.col("session_id") == F.lit(session)).orderBy(F.desc("created_at"), F.desc("job_id"))


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def job_statistics(jobs: DataFrame, user: object | None = None) -> DataFrame:
    """status, jobs, avg_duration (rounded half up)."""
    rows = jobs if user is None else jobs.filter(F.col("user_id") == F.lit(user))
    mean = F.floor(F.coalesce(F.avg("duration_ms"), F.lit(0.0)) + 0.5)
    return rows.groupBy("status").agg(F.count("*").alias("jobs"), mean.cast("long").alias("avg_duration"))


def job_state(updates: DataFrame) -> DataFrame:
    """job_id, status, started_at, completed_at, execution_ms from job_id, status, ts, seq, duration_ms.

    A cancellation counts only while the job is queued or running.  It then suffices to
    know the last other update and the last cancellation, so this is one aggregate and
    a job with very many updates is combined before the shuffle.
    """
    status, at = F.col("status"), F.struct("ts", "seq")
    cancel = status == "cancelled"
    folded = updates.groupBy("job_id").agg(
        F.max_by(F.when(~cancel, status), F.when(~cancel, at)).alias("work"),
        F.max(F.when(~cancel, at)).alias("work_at"), F.max(F.when(cancel, at)).alias("cancel_at"),
        F.max(F.when(status == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(status.isin("completed", "failed"), F.col("ts"))).alias("completed_at"),
        F.max_by("duration_ms", F.when(F.col("duration_ms").isNotNull(), at)).alias("duration_ms"),
    )
    open_work = F.coalesce("work", F.lit("queued")).isin("queued", "running")
    later = F.col("cancel_at").isNotNull() & (F.col("work_at").isNull() | (F.col("cancel_at") > F.col("work_at")))
    spent = (micros(F.col("completed_at")) - micros(F.col("started_at"))) / 1000
    return folded.select(
        "job_id", F.when(later & open_work, F.lit("cancelled")).otherwise(F.col("work")).alias("status"),
        "started_at", "completed_at", F.coalesce(spent, "duration_ms").alias("execution_ms"),
    )


def with_execution_time(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("execution_ms", F.coalesce((micros(F.col("completed_at")) - micros(F.col("started_at"))) / 1000, "duration_ms"))


# ---- reuse of results ---------------------------------------------------------------------

def cache_key(url: Column, kind: Column, task: Column) -> Column:
    hashed = F.when(F.coalesce(task, F.lit("")) == "", F.lit("default")).otherwise(F.substring(F.sha2(task, 256), 1, 8))
    return F.concat(F.lit("scrape:"), url, F.lit(":"), kind, F.lit(":"), hashed)


def fresh_or_recompute(
    requests: DataFrame, store: DataFrame, now: Column, mode: str = "enabled", local: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, bool]:
    """(reused: key, requests, value), (to compute: key, requests), write results back?

    Requests are counted per key before anything is joined, so a key asked for very
    often costs one row.  `store` and `local`: key, value, expires_at, one row per key.
    'bypass' skips the shared store but not the process-local one; 'read_only' never writes.
    """
    if mode not in CACHE_MODES:
        raise ValueError(f"unknown cache mode {mode}")
    wanted = requests.groupBy("key").agg(F.count("*").alias("requests"))
    stores = [] if mode == "disabled" else ([local] if local is not None else []) + ([] if mode == "bypass" else [store])
    if not stores:
        return wanted.withColumn("value", F.lit(None).cast("string")).limit(0), wanted, mode in ("enabled", "bypass")
    valid = [s.filter(now < F.col("expires_at")).select("key", "value", F.lit(i).alias("nearest")) for i, s in enumerate(stores)]
    merged = valid[0].drop("nearest")
    if len(valid) > 1:
        both = valid[0].unionByName(valid[1])
        merged = both.groupBy("key").agg(F.min_by("value", "nearest").alias("value"))
    reused = wanted.join(merged, "key")
    return reused, wanted.join(merged.select("key"), "key", "left_anti"), mode in ("enabled", "bypass")


def session_reuse(requests: DataFrame, jobs: DataFrame, max_age: int = SESSION_REUSE_SECONDS, bucket_seconds: int = 86400) -> DataFrame:
    """request_id, job_id: the newest completed job of the same session and URL, null when older than `max_age`.

    An as-of join on one timeline of jobs and requests; long timelines are split by day.
    """
    done = jobs.filter(F.col("status") == "completed").select(
        "session_id", "url", F.col("completed_at").alias("ts"), F.lit(0).alias("side"), F.col("job_id").alias("id"))
    asked = requests.select("session_id", "url", "ts", F.lit(1).alias("side"), F.col("request_id").alias("id"))
    line = done.unionByName(asked).withColumn("us", micros(F.col("ts")))
    job = F.when(F.col("side") == 0, F.struct("id", "us"))
    out = carried(line, ["session_id", "url"], F.floor(F.col("us") / (bucket_seconds * 1000000)), ["us", "side", "id"], last={"job": job})
    fresh = F.col("us") - F.col("job.us") < max_age * 1000000
    return out.filter("side = 1").select(F.col("id").alias("request_id"), F.when(fresh, F.col("job.id")).alias("job_id"))


def drop_expired(rows: DataFrame, now: Column, expires: Column) -> DataFrame:
    """Rows still valid; one without an expiry never expires."""
    return rows.filter(expires.isNull() | (now < expires))


def purge_store(spark: SparkSession, path: str, now: Column, expires: str, part: str) -> DataFrame:
    """Rewrites a store, partitioned by `part`, without its expired rows; returns part, expired, kept of the partitions touched.

    The least expiry of each partition tells which hold expired rows.  Only those are read whole and replaced, by a dynamic partition
    overwrite from a table in the shared folder; those with nothing left are removed.  The others keep their files, and a
    run that is repeated after a failure ends in the same store.
    """
    rows = spark.read.parquet(path)
    gone = F.coalesce(now >= F.col(expires), F.lit(False))
    least = rows.groupBy(part).agg(F.min(expires).alias("least"))
    touched = [r[0] for r in least.where(now >= F.col("least")).select(part).collect()]  # one value for each partition
    inside = rows.where(F.col(part).isin(touched))
    report = cut_lineage(inside.groupBy(part).agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("kept")))
    kept = cut_lineage(inside.where(~gone))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for r in report.where("kept = 0").collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={r[0]}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    return report


def count_expired(rows: DataFrame, now: Column, expires: Column) -> DataFrame:
    gone = expires.isNotNull() & (now >= expires)
    return rows.agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("kept"))


def keep_recent_keys(accesses: DataFrame, n: int, policy: str = "lru") -> DataFrame:
    """key, ts of the n keys that stay: latest access (lru) or latest insertion (fifo).  One aggregate, and ranks by ranges for large n."""
    last = F.max("ts") if policy == "lru" else F.min("ts")
    return first_rows(accesses.groupBy("key").agg(last.alias("ts")), [F.desc("ts"), F.asc("key")], n)


# ---- conversations ------------------------------------------------------------------------

def history_rows(turns: DataFrame) -> DataFrame:
    """Turns with the role names a model expects; nothing moves."""
    return turns.withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise("user"))


def conversation_history(turns: DataFrame, part_turns: int = 1000) -> DataFrame:
    """conv_id, part, history ARRAY<STRUCT<turn, role, text>> in order, in parts of at most `part_turns` turn numbers."""
    rows = history_rows(turns).withColumn("part", F.floor(F.col("turn") / part_turns).cast("long"))
    return rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))


def chat_context(text: Column, limit: int | None = None) -> Column:
    """The text as context, cut after `limit` characters, if given."""
    if limit is None:
        return F.concat(text, F.lit(" "))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ...[truncated]"))).otherwise(F.concat(text, F.lit(" ")))
