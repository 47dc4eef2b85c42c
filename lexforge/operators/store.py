"""Tables that are compiled once and read by many queries, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on one machine, where the session names none, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: computed once, however often it is used."""
    path = f"{shared_dir(df.sparkSession)}/lexforge/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(source: DataFrame, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` compiled from source: built by its first reader in an application, read by all later ones.

    It belongs to the application and the files of source; a table of other files is another one. An unfinished
    one (no _SUCCESS file) is built anew.
    """
    spark = source.sparkSession
    path = _place(source, name)
    if not built(source, name):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _place(source: DataFrame, name: str) -> str:
    spark = source.sparkSession
    digest = hashlib.sha256("\n".join([spark.sparkContext.applicationId, name, *sorted(source.inputFiles())]).encode()).hexdigest()[:24]
    return f"{shared_dir(spark)}/lexforge/{name}-{digest}"


def built(source: DataFrame, name: str) -> bool:
    """Whether the table `name` of source is there, whole."""
    context = source.sparkSession.sparkContext
    done = context._jvm.org.apache.hadoop.fs.Path(f"{_place(source, name)}/_SUCCESS")
    return done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done)


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
