"""Readers and writers: JSON lines, JSON documents, zstd, ZIP members, pinned files, byte budgets, assets."""

from __future__ import annotations

import hashlib
import io
import codecs
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, anything that is no such object fails. Reads .zst as well."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_counting(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, but lines that don't parse are kept in `_bad`; count them instead of failing."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType, rows: str) -> DataFrame:
    """Whole-file JSON with the rows in an array at a dotted path, such as `data.concepts`."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode(rows).alias("row")).select("row.*")


def read_pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(path, content) of a file that must have this hash; drift fails the read."""
    files = spark.read.format("binaryFile").load(path)
    same = F.sha2("content", 256) == sha256
    return files.select("path", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("content drift: "), "path")).cast("binary")).alias("content"))


def read_zip_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, line): the lines of the one JSON or JSONL member of every archive; none or several fail."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.endswith((".json", ".jsonl"))]
                    if len(names) != 1:
                        raise ValueError(f"{where}: {len(names)} JSON members")
                    text = archive.read(names[0]).decode("utf-8")
                lines = [x for x in text.splitlines() if x.strip()] if names[0].endswith("l") else [json.dumps(json.loads(text))]
                yield pd.DataFrame({"path": where, "member": names[0], "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, line string")


def read_array_prefix(spark: SparkSession, path: str, budget: int, chunk: int = 1 << 16) -> DataFrame:
    """(path, item, status): the objects of a JSON array that lie whole inside the first `budget` bytes; status
    complete_array or byte_budget_reached. Holds one unfinished object at a time."""

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                rest, found, done = "", [], False
                text = codecs.getincrementaldecoder("utf-8")("replace")  # a character may lie across two chunks
                for at in range(0, min(len(content), budget), chunk):
                    rest += text.decode(content[at : min(at + chunk, budget)])
                    while not done:
                        rest = rest.lstrip(" \t\r\n,[") if not found or rest[:1] in " \t\r\n,[" else rest
                        if rest.startswith("]"):
                            done = True
                            break
                        try:
                            value, end = decoder.raw_decode(rest)
                        except ValueError:
                            break
                        if end == len(rest) and not isinstance(value, (dict, list, str)):
                            break  # a number or a word at the edge may go on
                        found.append(json.dumps(value, sort_keys=True))
                        rest = rest[end:]
                yield pd.DataFrame({"path": where, "item": found, "status": "complete_array" if done else "byte_budget_reached"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(items, "path string, item string, status string")


def merge_by_id(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several answers once each; two different rows of one key fail."""
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    rest = [c for c in union.columns if c != key]
    one = union.groupBy(key).agg(F.count_distinct(F.struct(*rest)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("inconsistent "), F.col(key).cast("string"))))
    return one.select(key, checked.alias("_row")).select(key, "_row.*")


def first_valid(rows: DataFrame, group: list[str], order: list[Column], valid: Column, n: int) -> DataFrame:
    """The first n valid rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.where(valid).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def shape(value: object, depth: int = 3) -> object:
    """The types of a JSON value, keys sorted, down to `depth`."""
    if depth == 0:
        return "..."
    if isinstance(value, dict):
        return {k: shape(v, depth - 1) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [shape(value[0], depth - 1)] if value else []
    return type(value).__name__


def leaves(texts: DataFrame, column: str) -> DataFrame:
    """(key columns, path, value): every leaf of a column of JSON texts with its path."""

    def walk(value: object, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")
        else:
            yield path, value if isinstance(value, str) else json.dumps(value)

    keys = [c for c in texts.columns if c != column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(r[k] for k in keys), p, v) for r in b.to_dict("records") if r[column] is not None for p, v in walk(json.loads(r[column]), "")]
            yield pd.DataFrame(rows, columns=[*keys, "path", "value"])

    schema = T.StructType([f for f in texts.schema if f.name != column] + [T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    return texts.mapInPandas(run, schema)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with sorted keys, sorted by `order` over the files."""
    df.select(*sorted(df.columns)).orderBy(*order).write.mode("overwrite").json(path)


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """The compiled index as Parquet, partitioned by a hash of the term, so that a query reads its terms' buckets."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """The index; with terms only their buckets are read (partition pruning)."""
    df = spark.read.parquet(path)
    if terms is None:
        return df
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets))).collect()]
    return df.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))


def content_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
