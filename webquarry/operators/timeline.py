"""Rate limits, error rates, source health and time-to-live reads over event tables.

Every operator splits a busy key by time: windows see one (key, bucket) at a time and
only one summary row per bucket is carried on.  Where a decision truly depends on the
one before it, the timeline is cut at quiet gaps, behind which the past has no effect,
and each piece is walked in sorted order with constant memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.operators.skew import carried, micros
from webquarry.session import cut_lineage

WINDOW_SECONDS, MAX_REQUESTS = 60, 100
RATE_BUCKETS = 10
MAX_FAILURES = 5
SECOND = 1_000_000


# ---- rate limits --------------------------------------------------------------------------

def rate_limit_all(
    events: DataFrame, key: Column, window_seconds: int = WINDOW_SECONDS, limit: int = MAX_REQUESTS,
    id_col: str = "event_id", bucket_seconds: int | None = None,
) -> DataFrame:
    """id, key, ts, seen, allowed, remaining: requests in (ts - window, ts], refused ones included.

    A key's timeline is cut into buckets at least one window long; the last window of a
    bucket is repeated in the next one as context, so buckets are counted on their own.
    """
    width, size = window_seconds * SECOND, max(bucket_seconds or 0, 8 * window_seconds) * SECOND
    rows = events.select(F.col(id_col).alias("id"), key.cast("string").alias("key"), "ts", micros(F.col("ts")).alias("us"))
    b = F.floor(F.col("us") / size)
    own = F.struct(b.alias("b"), F.lit(False).alias("context"))
    next_one = F.struct((b + 1).alias("b"), F.lit(True).alias("context"))
    reaches_over = F.col("us") > (b + 1) * size - width
    rows = rows.select("*", F.explode(F.when(reaches_over, F.array(own, next_one)).otherwise(F.array(own))).alias("p"))
    rows = rows.select("id", "key", "ts", "us", "p.b", "p.context")
    within = W.partitionBy("key", "b").orderBy("us").rangeBetween(-(width - 1), 0)
    same = W.partitionBy("key", "b", "us")
    rows = rows.withColumn("seen", F.count("*").over(within) - F.count("*").over(same) + F.row_number().over(same.orderBy("id")))
    return rows.filter("not context").select(
        "id", "key", "ts", "seen", (F.col("seen") <= limit).alias("allowed"),
        F.greatest(F.lit(0).cast("long"), limit - F.col("seen")).alias("remaining"),
    )


def pieces(rows: DataFrame, key: str, gap_micros: int, order: Sequence[str], bucket_seconds: int = 86400) -> DataFrame:
    """Adds `piece`: start time of the stretch of events without a gap of `gap_micros` the row belongs to."""
    bucket = F.floor(F.col("us") / (bucket_seconds * SECOND))
    rows = carried(rows, [key], bucket, order, last={"prev_us": F.col("us")}, before=True)
    starts = F.col("prev_us").isNull() | (F.col("us") - F.col("prev_us") >= gap_micros)
    return carried(rows, [key], bucket, order, last={"piece": F.when(starts, F.col("us"))}).drop("prev_us")


def admit(times: deque, us: int, width: int, limit: int) -> tuple[bool, int]:
    """One step of the limiter: is the request at `us` admitted, and how many are left."""
    while times and times[0] <= us - width:
        times.popleft()
    if len(times) >= limit:
        return False, 0
    times.append(us)
    return True, limit - len(times)


def _alive(times: deque, us: int, width: int) -> list[int]:
    """Admissions that still count for requests at `us` or later."""
    return [t for t in times if t > us - width]


_CHUNK = ("key", "piece", "chunk")
NO_KEY = "\0"


def _groups(batch: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
    """(chunk, start, end) of the runs of rows of one chunk in a sorted batch."""
    keys = batch[list(_CHUNK)]
    cuts = np.flatnonzero(np.append(True, (keys.ne(keys.shift())).any(axis=1).to_numpy()[1:])) if len(batch) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
        yield tuple(keys.iloc[a]), a, b


def _guessed(width: int, limit: int, size: int):
    """Walks every chunk from the rows that lead up to it: with which admissions it was entered, and which it leaves behind."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times, enter = None, deque(), None

        def closed() -> pd.DataFrame:
            end = current[1] + (current[2] + 1) * size
            return pd.DataFrame({"key": [current[0]], "piece": [current[1]], "chunk": [current[2]], "enter": [enter], "exit": [_alive(times, end, width)]})

        for batch in batches:
            us, own = batch["us"].to_numpy(), ~batch["context"].to_numpy(bool)
            for chunk, a, b in _groups(batch):
                if chunk != current:
                    if enter is not None:
                        yield closed()
                    current, times, enter = chunk, deque(), None
                for i in range(a, b):
                    if own[i] and enter is None:
                        enter = _alive(times, chunk[1] + chunk[2] * size, width)
                    admit(times, int(us[i]), width, limit)
        if enter is not None:
            yield closed()

    return walk


def _corrected(width: int, limit: int, size: int):
    """Walks chunks again from the admissions they are really entered with, beside the earlier walk and only until both agree."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, now, then, left, agreed = None, deque(), deque(), [], False

        def closed() -> pd.DataFrame:
            end = current[1] + (current[2] + 1) * size
            return pd.DataFrame({"key": [current[0]], "piece": [current[1]], "chunk": [current[2]], "exit": [left if agreed else _alive(now, end, width)]})

        for batch in batches:
            us = batch["us"].to_numpy()
            for chunk, a, b in _groups(batch):
                if chunk != current:
                    if current is not None:
                        yield closed()
                    current, agreed = chunk, False  # the first row of a chunk brings its states
                    now, then, left = deque(batch["due"].iloc[a]), deque(batch["enter"].iloc[a]), list(batch["exit"].iloc[a])
                    a += 1
                for i in range(a, b if not agreed else a):
                    admit(now, int(us[i]), width, limit)
                    admit(then, int(us[i]), width, limit)
                    if now == then:
                        agreed = True
                        break
        if current is not None:
            yield closed()

    return walk


def _decided(width: int, limit: int):
    """Decisions of every chunk, walked from the admissions that its first row brings, where it does."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, deque()
        for batch in batches:
            allowed, left = np.empty(len(batch), bool), np.empty(len(batch), np.int64)
            us, asks = batch["us"].to_numpy(), batch["asks"].to_numpy(bool)
            for chunk, a, b in _groups(batch):
                if chunk != current:
                    current, times = chunk, deque()
                for i in range(a, b):
                    if asks[i]:
                        allowed[i], left[i] = admit(times, int(us[i]), width, limit)
                    else:
                        times = deque(batch["enter"].iloc[i])
            out = pd.DataFrame({"id": batch["id"], "key": batch["key"], "ts": batch["ts"], "allowed": allowed, "remaining": left})
            yield out[asks]

    return walk


def _boundaries(line: DataFrame, width: int, limit: int, size: int, context: int) -> DataFrame:
    """key, piece, chunk, enter: the admissions that count at the start of every chunk.

    All chunks are walked side by side, each with the requests of some windows before it, from an empty state; mostly that
    ends in the true state.  Where a chunk was not entered as the one before it was left, it is walked again from there, until
    the two walks agree; a chunk that is left differently then concerns the next one, until nothing changes.  That
    takes one round where walks agree within a chunk, and never more rounds than a piece has chunks.
    """
    at = F.col("us") - F.col("piece")
    own = F.struct("chunk", F.lit(False).alias("context"))
    ahead = F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(True).alias("context"))
    lead = F.when(at >= (F.col("chunk") + 1) * size - context, F.array(own, ahead)).otherwise(F.array(own))
    rows = line.select("key", "piece", "us", "id", F.explode(lead).alias("p")).select("key", "piece", "us", "id", "p.*")
    rows = rows.repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "us", "id").select(*_CHUNK, "us", "context")
    kind = "key string, piece long, chunk long"
    states = cut_lineage(rows.mapInPandas(_guessed(width, limit, size), f"{kind}, enter array<long>, exit array<long>"))
    while True:
        left = states.select("key", "piece", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("due"))
        wrong = cut_lineage(states.join(left, list(_CHUNK)).where("due <> enter"))
        if wrong.isEmpty():
            return states.select(*_CHUNK, "enter")
        again = line.join(wrong.select(*_CHUNK), list(_CHUNK), "left_semi").select(*_CHUNK, "us", "id", F.lit(1).alias("side"))
        heads = wrong.withColumns({"side": F.lit(0), "us": F.lit(0).cast("long"), "id": F.lit(0).cast("long")})
        both = again.unionByName(heads, allowMissingColumns=True).repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "side", "us", "id")
        fixed = both.select(*_CHUNK, "us", "due", "enter", "exit").mapInPandas(_corrected(width, limit, size), f"{kind}, exit array<long>")
        fixed = fixed.withColumnRenamed("exit", "now").join(wrong.select(*_CHUNK, "due"), list(_CHUNK))
        states = cut_lineage(states.join(fixed, list(_CHUNK), "left").select(*_CHUNK, F.coalesce("due", "enter").alias("enter"), F.coalesce("now", "exit").alias("exit")))


def rate_limit_admitted(
    events: DataFrame, key: Column, window_seconds: int = WINDOW_SECONDS, limit: int = MAX_REQUESTS, id_col: str = "event_id", chunk_seconds: int | None = None,
) -> DataFrame:
    """id, key, ts, allowed, remaining when refused requests do not count.

    After a gap of one window nothing is remembered, so a key's pieces between gaps are independent.  A piece longer than
    `chunk_seconds` (64 windows if not given) is cut into chunks of that length, whose states at the start are found by
    `_boundaries`; so a key that never pauses is as many tasks as it has chunks.  Rows of a chunk stream through in order; the
    memory is the `limit` latest admissions.  Requests without a key share one limit; those without a time are left out.
    """
    width = window_seconds * SECOND
    size = max(chunk_seconds or 64 * window_seconds, 2 * window_seconds) * SECOND
    rows = events.select(F.col(id_col).cast("long").alias("id"), F.coalesce(key.cast("string"), F.lit(NO_KEY)).alias("key"), F.col("ts").cast("timestamp").alias("ts"),
                         micros(F.col("ts")).alias("us"))
    cut = pieces(rows.where("us IS NOT NULL"), "key", width, ["us", "id"])
    line = cut_lineage(cut.withColumn("chunk", F.floor((F.col("us") - F.col("piece")) / size)))
    asks = line.select(*_CHUNK, "us", "id", "ts", F.lit(True).alias("asks"))
    long_pieces = line.where("chunk > 0").select("key", "piece").distinct()
    if not long_pieces.isEmpty():
        starts = _boundaries(line.join(long_pieces, ["key", "piece"], "left_semi"), width, limit, size, min(8 * width, size))
        heads = starts.withColumns({"asks": F.lit(False), "us": F.lit(0).cast("long"), "id": F.lit(0).cast("long")})
        asks = asks.unionByName(heads, allowMissingColumns=True)
    else:
        asks = asks.withColumn("enter", F.lit(None).cast("array<long>"))
    sorted_chunks = asks.repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "asks", "us", "id")
    out = sorted_chunks.mapInPandas(_decided(width, limit), "id long, key string, ts timestamp, allowed boolean, remaining long")
    return out.withColumn("key", F.nullif("key", F.lit(NO_KEY)))


def limit_report(decisions: DataFrame, period: str = "1 day") -> DataFrame:
    """period_start, total, refused, active_keys per tumbling period."""
    return decisions.groupBy(F.window("ts", period).alias("w")).agg(
        F.count("*").alias("total"), F.count_if(~F.col("allowed")).alias("refused"), F.countDistinct("key").alias("active_keys")
    ).select(F.col("w.start").alias("period_start"), "total", "refused", "active_keys")


# ---- error rate ---------------------------------------------------------------------------

def error_rate(outcomes: DataFrame, window_seconds: int = WINDOW_SECONDS, buckets: int = RATE_BUCKETS) -> DataFrame:
    """source, window_start, requests, failures, error_percent over sliding windows."""
    sliding = F.window("ts", f"{window_seconds} seconds", f"{window_seconds // buckets} seconds")
    out = outcomes.groupBy("source", sliding.alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"))
    return out.select("source", F.col("w.start").alias("window_start"), "requests", "failures",
                      (F.col("failures") * 100 / F.col("requests")).alias("error_percent"))


# ---- source health ------------------------------------------------------------------------

def source_health(outcomes: DataFrame, max_failures: int = MAX_FAILURES, bucket_seconds: int = 86400) -> DataFrame:
    """source, successes, failures, consecutive, avg_ms, status from id, source, ts, ok, ms.

    One summary per source and day: its counts and the failures at its end.  The days of a source are then
    folded in order, so a busy source is as many tasks as it has days, and its fold sees one row per day.
    """
    day = F.floor(micros(F.col("ts")) / (bucket_seconds * SECOND))
    backwards = W.partitionBy("source", "day").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = outcomes.withColumn("day", day).withColumn("later_ok", F.count_if("ok").over(backwards))
    days = rows.groupBy("source", "day").agg(
        F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.count_if(F.col("later_ok") == 0).alias("tail"),
        F.sum(F.when(F.col("ok"), F.col("ms"))).alias("ms"), F.count(F.when(F.col("ok"), F.col("ms"))).alias("timed"),
    )
    out = days.groupBy("source").agg(
        F.sum("good").alias("successes"), F.sum("bad").alias("failures"),
        F.array_sort(F.collect_list(F.struct("day", "good", "bad", "tail"))).alias("days"),
        (F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_ms"),
    )
    run = F.aggregate("days", F.lit(0).cast("long"), lambda acc, d: F.when(d.good > 0, d.tail).otherwise(acc + d.bad))
    return out.select(
        "source", "successes", "failures", run.alias("consecutive"), "avg_ms",
        F.when(run >= max_failures, "UNHEALTHY").otherwise("ACTIVE").alias("status"),
    )


def source_summary(health: DataFrame) -> DataFrame:
    """One row over all sources; a source never measured counts as 0 in the mean time."""
    used = F.sum(F.col("successes") + F.col("failures"))
    return health.agg(
        F.count("*").alias("sources"), F.count_if(F.col("status") == "ACTIVE").alias("active"),
        F.count_if(F.col("status") == "UNHEALTHY").alias("unhealthy"), F.avg(F.coalesce("avg_ms", F.lit(0.0))).alias("avg_ms"),
        used.alias("requests"), F.when(used > 0, F.sum("successes") / used).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def least_used(health: DataFrame, n: int = 1) -> DataFrame:
    """The n least used sources; ties go to the better success rate, then to the later one."""
    used = F.col("successes") + F.col("failures")
    rate = F.when(used > 0, F.col("successes") / used).otherwise(F.lit(0.0))
    return health.withColumns({"used": used, "rate": rate}).orderBy("used", F.desc("rate"), F.desc("source")).limit(n)


def weighted_shares(health: DataFrame) -> DataFrame:
    """source, weight, share: success rate (1 when unused) over the sum of all."""
    used = F.col("successes") + F.col("failures")
    weighed = health.withColumn("weight", F.when(used > 0, F.col("successes") / used).otherwise(F.lit(1.0)))
    total = weighed.agg(F.sum("weight")).scalar()
    return weighed.select("source", "weight", (F.col("weight") / total).alias("share"))


def round_robin(requests: DataFrame, sources: Sequence[str], id_col: str = "event_id", bucket_seconds: int = 3600) -> DataFrame:
    """Adds `source`: the pool in turn, in time order.  The running number is carried over time buckets, not counted in one task."""
    rows = requests.withColumn("us", micros(F.col("ts")))
    rows = carried(rows, [], F.floor(F.col("us") / (bucket_seconds * SECOND)), ["us", id_col], sums={"n": F.lit(1).cast("long")})
    pool = F.array(*[F.lit(s) for s in sources])
    return rows.withColumn("source", F.get(pool, ((F.col("n") - 1) % len(sources)).cast("int"))).drop("us", "n")


# ---- progress and cached values -----------------------------------------------------------

def progress_latest(updates: DataFrame) -> DataFrame:
    """job_id, status, progress, message, updates: the newest update of each job."""
    at = F.struct("ts", "seq")
    return updates.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.max_by("progress", at).alias("progress"),
        F.max_by("message", at).alias("message"), F.count("*").alias("updates"),
    )


def actions_by_type(updates: DataFrame) -> DataFrame:
    return updates.groupBy("status").agg(F.count("*").alias("events"))


def ttl_lookup(writes: DataFrame, reads: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """id, key, value, hit: every read finds the last write before it, unless that has expired.

    writes: key, ts, id, value, ttl_seconds.  reads: key, ts, id.
    """
    w = writes.select("key", "ts", "id", F.lit(0).alias("side"), "value", F.col("ttl_seconds").cast("long").alias("ttl"))
    r = reads.select("key", "ts", "id", F.lit(1).alias("side"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("ttl"))
    line = w.unionByName(r).withColumn("us", micros(F.col("ts")))
    entry = F.when(F.col("side") == 0, F.struct("value", (F.col("us") + F.col("ttl") * SECOND).alias("until")))
    out = carried(line, ["key"], F.floor(F.col("us") / (bucket_seconds * SECOND)), ["us", "side", "id"], last={"entry": entry})
    hit = F.coalesce(F.col("us") < F.col("entry.until"), F.lit(False))
    return out.filter("side = 1").select("id", "key", F.when(hit, F.col("entry.value")).alias("value"), hit.alias("hit"))
