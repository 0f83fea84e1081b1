"""Streams of events: windowed counters, sessions, late duplicates. An extension beyond batch parity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read(spark: SparkSession, path: str) -> DataFrame:
    """events as a stream of files: a folder's, or the one file of that name, which the stream reader takes as a pattern only."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def unique(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of an id that arrive within the delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counters(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows."""
    per = events.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): a session ends when its user is idle for the gap."""
    per = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or where that is unset (local tests) a fresh one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodequery-"))
    return spark.sparkContext.getCheckpointDir()


def drain(stream: DataFrame, *keys: str) -> DataFrame:
    """Runs an aggregated stream over what is there and returns its rows, also those of windows that are still open.

    Every batch writes the groups that it changed to the shared folder; the last version of a group, by its keys, counts.
    """
    path = f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    written = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    others = [c for c in stream.columns if c not in keys]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in stream.columns])
