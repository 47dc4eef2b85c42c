"""Structured Streaming: running demand counts, windowed counts with late data, an event funnel, keyed judging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import store


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def query_counts(log: DataFrame, query: str = "query", count: str = "cnt") -> DataFrame:
    """Running demand: counts by normalised query, in complete or update mode."""
    return log.groupBy(T.norm(F.col(query)).alias("query")).agg(F.sum(F.col(count).cast("long")).alias("cnt"))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by event type and window; rows later than the watermark are dropped."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_steps(events: DataFrame) -> DataFrame:
    """Each user's steps taken so far: the state of an ordered funnel."""
    steps = ["view", "click", "signup", "purchase"]
    return events.groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == s, 1).otherwise(0)).alias(s) for s in steps))


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there, to the end, and return its sink: a table in the shared folder.

    complete: the last batch's result stands. append: a batch has a folder of its own, so one that is run again
    after a failure replaces itself. Nothing passes through the driver.
    """
    spark = stream.sparkSession
    path = f"{store.shared_dir(spark)}/lexforge/{name}-{uuid.uuid4().hex}"
    checkpoint = checkpoint or f"{path}-checkpoint"

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/_batch={0 if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/_batch=-1")  # a stream without rows has a sink too
    stream.writeStream.outputMode(mode).foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return spark.read.parquet(path).drop("_batch")


def judged(cases: DataFrame, done_path: str, verdict: Column, fingerprint: str, spark: SparkSession) -> DataFrame:
    """Resumable keyed judging: cases (key, ...) without a complete verdict under this fingerprint are judged and
    appended; a folder of another fingerprint, or with verdicts on keys that aren't among the cases, is refused. Returns all verdicts."""
    try:
        old = spark.read.parquet(done_path)
    except Exception as e:  # a first run has no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        others = old.where(F.col("fingerprint") != fingerprint).limit(1).count()
        if others:
            raise ValueError("verdicts of another protocol")
        if old.join(cases.select("key").distinct(), "key", "left_anti").limit(1).count():
            raise ValueError("verdicts of other cases")
        whole = old.where("verdict in ('keep', 'uncertain', 'drop')")
        cases = cases.join(whole.select("key").distinct(), "key", "left_anti")
    cases.select("key", verdict.alias("verdict"), F.lit(fingerprint).alias("fingerprint")).write.mode("append").parquet(done_path)
    both = spark.read.parquet(done_path).where("verdict in ('keep', 'uncertain', 'drop')")
    w = Window.partitionBy("key").orderBy("verdict")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def judge_stream(stream: DataFrame, done_path: str, verdict: Column, fingerprint: str, checkpoint: str | None = None) -> None:
    """The same as a stream: every micro-batch goes through judged()."""

    def batch(df: DataFrame, _: int) -> None:
        judged(df, done_path, verdict, fingerprint, df.sparkSession)

    q = stream.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{store.shared_dir(stream.sparkSession)}/lexforge/judge-{uuid.uuid4().hex}")
    q.start().awaitTermination()
