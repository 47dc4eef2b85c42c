"""Two-pass external shuffle into shards.

Pass 1 scatters whole records uniformly over buckets by a seeded hash; there are as many buckets as keep
one at about `bucket_bytes`, so a bucket fits in memory. Pass 2 draws a Fisher-Yates permutation of each
bucket (SQL's seeded shuffle) and writes the buckets to a table in the shared folder. Buckets one after
the other are a random permutation of the corpus; shard k takes its k-th equal part. Counts differ by one
at most (law `rows`) and slots follow the permutation.

The permutation is drawn once: what a task commits to the table is never drawn again, so an executor
lost later can't mix two permutations. Equal texts and repeated rows are scattered apart, since a row's
hash covers its place in the scan too; no group of copies gathers in a bucket.

Everything is a DataFrame expression. The buckets' table of row counts is the only thing ever summed up
in one place: a row per bucket.

Defined results
- null text: size 1, checksum of no bytes (0), kept; null doc_id and repeated rows: kept, one slot each;
- no rows: no rows; further columns travel along (`grown_shard` is null under the law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import staged, table

BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
#: Tasks of the second pass; each draws its buckets one after the other.
MOST_TASKS = 20_000


def shuffled(rows: DataFrame, size: Column, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(bucket, place from 0 in the bucket, size, row struct) of every row, in a written table. size: bytes of a row."""
    total = rows.agg(F.sum(size)).head()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-int(total) // bucket_bytes))
    scatter = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), size), F.lit(buckets)).cast("int")
    keyed = rows.select(scatter.alias("bucket"), F.struct(size.alias("size"), F.struct("*").alias("row")).alias("r"))
    drawn = keyed.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").agg(F.collect_list("r").alias("rs")).select("bucket", F.shuffle("rs", seed).alias("rs"))
    return staged(drawn.select("bucket", F.posexplode("rs").alias("place", "r")).select("bucket", "place", "r.size", "r.row"), "buckets")


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with size, shard and slot; columns of docs by these names are replaced."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long") + 1
    out = shuffled(docs, size, seed, bucket_bytes)
    counts = out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    placed = out.join(starts, "bucket").withColumn("at", F.col("first") + F.col("place"))
    k = F.expr(f"((at + 1) * {shards} - 1) div rows")  # shard k holds the places from k * rows div shards on
    placed = placed.withColumn("shard", k.cast("int")).withColumn("slot", F.expr(f"at - (shard * rows) div {shards}"))
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")), "size", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 42) -> None:
    """The shards as folders of Parquet files, rows by slot."""
    shard(docs, shards, seed).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
