"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_BYTES = 128 * 1024 * 1024


def build_session(app: str = "webquarry", master: str | None = None, input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    `input_bytes` sets how wide shuffles start, about 128 MB each (page rows double when
    cut into tokens); AQE merges small partitions at run time.  `master` is only given
    on a laptop; on a cluster spark-submit supplies it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if input_bytes:
        width = max(200, -(-2 * input_bytes // SHUFFLE_BYTES))
        builder = builder.config("spark.sql.shuffle.partitions", str(width))
        builder = builder.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLE_BYTES))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, else the warehouse, which all executors share too.

    Files below it belong to the caller, who names a folder for the run and removes it afterwards.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back, so lost executors cost one level only."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/webquarry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
