"""The time-based operators on streams.  Each has a batch twin in operators.timeline.

Where the order of events matters, rows are held in state until the watermark has passed them and are then
decided in event order by a timer, so the result does not depend on how rows fall into micro-batches.
The end of a bounded input is told by a row far in the future, which moves the watermark past all others.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from webquarry.functions import urls as U
from webquarry.operators import timeline as L
from webquarry.operators.skew import micros
from webquarry.session import checkpoint_dir

WATERMARK = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 64) -> DataFrame:
    """A parquet folder (or glob) as a stream with the schema of `like`; a trigger takes so many files at most."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def run_watched(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """Run over all available input into a table in the shared folder: the table, and what the query told of its batches.

    The second is batch, rows_in, held (entries of the state store), late (rows behind the watermark, which are counted and
    not held) and watermark, one row a batch, of the last batches that Spark keeps.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/webquarry/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/part={batch_id}")

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    told = [
        (p["batchId"], p["numInputRows"], sum(o["numRowsTotal"] for o in p["stateOperators"]), sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), p["eventTime"].get("watermark"))
        for p in query.recentProgress
    ]
    schema = stream.schema if mode == "append" else StructType(stream.schema.fields + [StructField("batch", IntegerType())])
    table = spark.read.schema(schema).parquet(f"{base}/out" if mode == "append" else f"{base}/out/*")
    return table, spark.createDataFrame(told, "batch long, rows_in long, held long, late long, watermark string")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over all available input into a table in the shared folder, and read it back."""
    return run_watched(stream, mode)[0]


# ---- declarative --------------------------------------------------------------------------

def limit_report_stream(decisions: DataFrame, period: str = "1 day") -> DataFrame:
    """Totals and refusals per period; distinct keys are counted from one row per key and period."""
    per_key = decisions.groupBy(F.window("ts", period).alias("w"), "key").agg(
        F.count("*").alias("total"), F.count_if(~F.col("allowed")).alias("refused"))
    return per_key.select(F.col("w.start").alias("period_start"), "key", "total", "refused")


def error_rate_stream(outcomes: DataFrame, window_seconds: int = L.WINDOW_SECONDS, buckets: int = L.RATE_BUCKETS) -> DataFrame:
    return L.error_rate(outcomes, window_seconds, buckets)


def progress_stream(updates: DataFrame) -> DataFrame:
    """Latest state per job; run in update mode."""
    return L.progress_latest(updates)


def page_dedup_stream(pages: DataFrame, ts: str = "ts", remember: str | None = None) -> DataFrame:
    """First sight of every normalised URL, given out at once.

    `remember` is how long a URL stays known at least behind the newest page, such as "90 days"; the state then holds the URLs of about that time.
    Without it a URL is known for ever: the state is one entry of about the URL's length for every URL, spread by URL, which the
    RocksDB store keeps on disk.
    """
    named = U.with_normalized(pages, F.col("url"), "norm_url")
    return named.dropDuplicates(["norm_url"]) if remember is None else named.withWatermark(ts, remember).dropDuplicatesWithinWatermark(["norm_url"])


def commit_pages(batch: DataFrame, path: str, batch_id: int) -> None:
    """Writes a batch of pages as its own part of the store, then its commit; a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    batch.sparkSession.range(batch_id, batch_id + 1, 1, 1).select(F.col("id").alias("batch")).write.mode("overwrite").parquet(f"{path}/_commits/{batch_id}")


def committed_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of committed batches; what a batch left that did not end is passed over."""
    commits = spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(f"{path}/_commits")
    pages = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
    return pages.join(commits, "batch", "left_semi").drop("batch")


def store_pages_stream(pages: DataFrame, path: str, checkpoint: str):
    """A stream of pages into the store at `path`, each batch once, however often it is tried."""
    writer = pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, batch_id: commit_pages(batch, path, batch_id)).start()


# ---- keyed state --------------------------------------------------------------------------

class _Ordered(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then decides over them in event order.

    A subclass names the columns it holds and folds the released rows.  State beyond the held rows
    and the fold's own is not kept; a key without either has none.  Rows are held by spans of event time, in blocks;
    a timer reads passed spans only, one after the other.  Spark drops rows that come behind the watermark and counts them, so
    what is held is bounded by the lateness that the watermark allows, times the rate of the input.
    """

    held_schema = ""
    #: Microseconds of a span, and rows of a block.
    span = 3600 * L.SECOND
    block = 4096
    #: Only the last fold of a timer is given out.
    last_only = False
    order: tuple[str, ...] = ("us", "id")

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Opens the fold's own state."""

    def fold(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self, mark: int) -> None:
        """Empties what no later row can ask for, as all rows before `mark` have passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "span long", "n long")
        self.held = handle.getMapState("held", "span long, block long", f"rows array<struct<{self.held_schema.replace(' ', ': ')}>>".replace(",: ", ", "))
        self.start(handle)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(int(us) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            for at, part in batch[self.columns()].groupby(batch["us"] // self.span):
                self._hold(int(at), part)
            low = int(batch["us"].min())
            least = low if least is None else min(least, low)
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs() * 1000, None
        spans = sorted(int(k[0]) for k in self.blocks.keys())
        for at in spans:
            if at * self.span >= mark:
                self._wake(at * self.span)
                break
            rows = self._release(at)
            passed = rows["us"] < mark
            rest = rows[~passed]
            if len(rest):
                self._hold(at, rest)
                self._wake(rest["us"].min())
            if passed.any():
                out = self.fold(key, rows[passed].sort_values(list(self.order), kind="stable"))
                if not self.last_only:
                    yield out
        self.forget(mark)
        if self.last_only and out is not None:
            yield out

    def _hold(self, at: int, rows: pd.DataFrame) -> None:
        n = int(self.blocks.getValue((at,))[0]) if self.blocks.containsKey((at,)) else 0
        listed = list(rows.itertuples(index=False, name=None))
        for lo in range(0, len(listed), self.block):
            self.held.updateValue((at, n), (listed[lo : lo + self.block],))
            n += 1
        self.blocks.updateValue((at,), (n,))

    def _release(self, at: int) -> pd.DataFrame:
        """All rows of a span, which is held no longer."""
        listed = []
        for k in range(int(self.blocks.getValue((at,))[0])):
            listed += [tuple(r) for r in self.held.getValue((at, k))[0]]
            self.held.removeKey((at, k))
        self.blocks.removeKey((at,))
        return pd.DataFrame(listed, columns=self.columns())

    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.held_schema.split(", ")]

    def close(self) -> None:
        pass


class _Limiter(_Ordered):
    """Times of the latest admissions of a key."""

    held_schema = "us long, id long"

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "at long")

    def fold(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        times = deque(int(x[0]) for x in self.admitted.get())
        decided = [L.admit(times, int(us), self.width, self.limit) for us in rows["us"]]
        self.admitted.put([(t,) for t in times]) if times else self.admitted.clear()
        if times:
            self._wake(times[-1] + self.width)
        return pd.DataFrame({
            "id": rows["id"], "key": key[0], "ts": pd.to_datetime(rows["us"], unit="us"),
            "allowed": [d[0] for d in decided], "remaining": [d[1] for d in decided]})

    def forget(self, mark: int) -> None:
        if self.admitted.exists() and max(int(x[0]) for x in self.admitted.get()) <= mark - self.width:
            self.admitted.clear()


def rate_limit_stream(
    events: DataFrame, key: Column, window_seconds: int = L.WINDOW_SECONDS, limit: int = L.MAX_REQUESTS, id_col: str = "event_id",
    watermark: str = WATERMARK,
) -> DataFrame:
    """id, key, ts, allowed, remaining, given out once the watermark has passed a row."""
    rows = event_time(events, watermark).select(
        F.col(id_col).cast("long").alias("id"), key.cast("string").alias("key"), "ts", micros(F.col("ts")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(
        _Limiter(window_seconds * L.SECOND, limit), "id long, key string, ts timestamp, allowed boolean, remaining long", "Append", "EventTime")


class _Health(_Ordered):
    """Counts and failure run of a source."""

    held_schema = "us long, id long, ok boolean, ms double"
    last_only = True

    def __init__(self, max_failures: int):
        self.max_failures = max_failures

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "successes long, failures long, run long, ms double")

    def fold(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        good, bad, run, ms = self.totals.get() if self.totals.exists() else (0, 0, 0, 0.0)
        ok = rows["ok"].to_numpy(bool)
        tail = len(ok) if not ok.any() else len(ok) - 1 - ok.nonzero()[0][-1]
        run = int(tail) + (int(run) if not ok.any() else 0)
        good, bad, ms = int(good) + int(ok.sum()), int(bad) + int((~ok).sum()), float(ms) + float(rows["ms"].to_numpy(float)[ok].sum())
        self.totals.update((good, bad, run, ms))
        return pd.DataFrame([{
            "source": key[0], "successes": good, "failures": bad, "consecutive": run, "avg_ms": ms / good if good else None,
            "status": "UNHEALTHY" if run >= self.max_failures else "ACTIVE"}])


def health_stream(outcomes: DataFrame, max_failures: int = L.MAX_FAILURES, watermark: str = WATERMARK) -> DataFrame:
    """Health of the sources whose rows the watermark has just passed; run in update mode."""
    rows = event_time(outcomes, watermark).select(
        F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), "ts", "ok", F.col("ms").cast("double").alias("ms"), micros(F.col("ts")).alias("us"))
    return rows.groupBy("source").transformWithStateInPandas(
        _Health(max_failures), "source string, successes long, failures long, consecutive long, avg_ms double, status string", "Update", "EventTime")


class _TtlValue(_Ordered):
    """The last value written under a key and until when it holds."""

    held_schema = "us long, id long, side int, value string, ttl long"
    order = ("us", "side", "id")

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string, until long")

    def fold(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        value, until = self.entry.get() if self.entry.exists() else (None, 0)
        until, out = int(until), []
        for row in rows.itertuples():
            if row.side == 0:
                value, until = row.value, int(row.us + row.ttl * L.SECOND)
            else:
                hit = row.us < until
                out.append((row.id, key[0], value if hit else None, hit))
        if until > int(rows["us"].max()):
            self.entry.update((value, until))
            self._wake(until)
        else:
            self.entry.clear()  # ran out: no later read can see it
        return pd.DataFrame(out, columns=["id", "key", "value", "hit"])

    def forget(self, mark: int) -> None:
        if self.entry.exists() and int(self.entry.get()[1]) <= mark:
            self.entry.clear()


def ttl_stream(line: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Reads answered from a stream of writes (side 0: value, ttl) and reads (side 1): key, ts, id, side, value, ttl."""
    rows = event_time(line, watermark).select(
        F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("side").cast("int").alias("side"),
        "ts", "value", F.col("ttl").cast("long").alias("ttl"), micros(F.col("ts")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(_TtlValue(), "id long, key string, value string, hit boolean", "Append", "EventTime")
