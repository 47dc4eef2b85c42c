"""Fusion of ranked lists (query_id, doc_id, rank): slots, quotas, reciprocal ranks, ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_union(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """The lists one after the other, a document at its first place only, ranked anew from 1."""
    placed = [x.select("query_id", "doc_id", F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, placed).groupBy("query_id", "doc_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.list", "at.rank", "doc_id")
    out = both.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "rank", F.col("at.list").alias("list"))
    return out.where(F.col("rank") <= k) if k else out


def slots(first: DataFrame, second: DataFrame, n: int, k: int = 5) -> DataFrame:
    """The first list's best, then up to n new ones of the second, then the rest of the first, cut at k; a
    query without a first list gets the second."""
    have = first.select("query_id").distinct()
    head = first.where("rank = 1")
    new = second.join(head.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(have, "query_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    picked = new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    alone = second.join(have, "query_id", "left_anti")
    return ordered_union([head, picked, first, alone], k)


def quotas(first: DataFrame, second: DataFrame, third: DataFrame, n2: int, n3: int, k: int = 5) -> DataFrame:
    """One of the first list, n2 new ones of the second, n3 of the third; then filled up from the third, the
    second and the first; cut at k. A quota of zero admits none."""

    def fresh(source: DataFrame, taken: DataFrame, n: int) -> DataFrame:
        new = source.join(taken.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        return new.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= n)

    a = first.where("rank = 1").select("query_id", "doc_id", "rank")
    b = fresh(second.select("query_id", "doc_id", "rank"), a, n2)
    c = fresh(third.select("query_id", "doc_id", "rank"), a.unionByName(b), n3)
    return ordered_union([a, b, c, third, second, first], k)


def reciprocal_ranks(lists: list[DataFrame], k: int = 60, digits: int = 9) -> DataFrame:
    """score = sum of 1 / (k + rank); ties by the first list's rank, then doc_id."""
    placed = [x.select("query_id", "doc_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    total = reduce(DataFrame.unionByName, placed).groupBy("query_id", "doc_id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.when(F.col("list") == 0, F.col("rank"))).alias("canonical")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), F.asc_nulls_last("canonical"), "doc_id")
    return total.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "score", "rank")


def guarded(first: DataFrame, second: DataFrame, exact_queries: DataFrame) -> DataFrame:
    """The first list for queries that equal a surface, the second for all others."""
    return first.join(exact_queries, "query_id", "left_semi").unionByName(second.join(exact_queries, "query_id", "left_anti"))


def either_hits(hits: list[Column]) -> Column:
    """Whether any of the lists has the target."""
    return reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in hits))
