"""What the operators of this subpackage share: staging, sizes, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, LF, VT, FF, CR. ``bytes.split()`` splits on these six.
SPACE = " \t\n\x0b\x0c\r"
#: Rows that Python takes from an Arrow batch at once, and MB of a batch: both bound what a task holds beside its executor's heap.
ROWS, BATCH_MB = 500, 4
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running stage only, and what a task has committed is
    never computed again in another order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """What Python and Arrow have freed goes back to the system: workers live on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = ROWS):
    """run for mapInArrow, given all rows in slices of at most `rows`; its tasks leave no freed memory behind."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what other stages have left
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        trim()

    return sliced


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in here passes to Python in batches of about BATCH_MB; the session's own setting comes back."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH_MB << 20))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is one partial
    aggregation and one equi-join, so a hub costs as many rows as it has edges, and adaptive skew
    joins can split it. Every round is staged.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = staged(cur, "cc")
    seen = _fingerprint(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # (u, m) also follows from v <> m rows, where u itself keeps its edge to m through the row with v = m
        cur = staged(small.where("u <> v").distinct(), "cc")
        now = _fingerprint(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
