"""Streaming queries as batch answers: each drains a stream over the table's file and must equal the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.registry import Tables, query
from lexforge.streaming import queries as S


def table_stream(t: Tables, name: str) -> DataFrame:
    path = f"{t.sf_dir}/{name}.parquet"
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(path)


@query("SELECT event_type AS query, CAST(count(*) AS BIGINT) AS cnt FROM events GROUP BY event_type")
def stream_counts(t: Tables) -> DataFrame:
    """Running demand counts of an append-only log."""
    log = table_stream(t, "events").select(F.col("event_type").alias("query"), F.lit(1).alias("cnt"))
    return S.drain(S.query_counts(log), "lexforge_counts")


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT user_id, CAST(v AS INTEGER) AS view, CAST(c AS INTEGER) AS click, CAST(s AS INTEGER) AS signup, CAST(p AS INTEGER) AS purchase FROM u""")
def stream_funnel(t: Tables) -> DataFrame:
    """Each user's steps of the funnel, from the stream of events."""
    return S.drain(S.first_steps(table_stream(t, "events")), "lexforge_funnel")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    """Counts by hour and event type with a watermark (one file, so nothing comes late)."""
    return S.drain(S.windowed_counts(table_stream(t, "events")), "lexforge_windows").withColumn("start", F.col("start").cast("timestamp_ntz"))
