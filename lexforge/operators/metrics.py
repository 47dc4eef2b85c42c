"""Ranking metrics, confidence intervals and paired comparisons as Column expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the 97.5 % quantile of the normal distribution.
Z = 1.959963984540054


def target_ranks(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query_id, rank): the best rank of a relevant document; null if none is ranked. Every judged query has a row."""
    hits = judgments.join(results.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.min("rank").alias("rank"))


def hit_rates(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """cases, top1, hit5, hit10 (rates) and mrr (0 where nothing is ranked)."""
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("cases"), F.round(at(1), 6).alias("top1"), F.round(at(5), 6).alias("hit5"), F.round(at(10), 6).alias("hit10"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def recall_ndcg(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """query_id, relevant, recall and binary nDCG of the first k results."""
    found = results.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = judgments.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")).join(found, "query_id", "left")
    return out.select("query_id", "relevant", F.round(F.coalesce("found", F.lit(0)) / F.col("relevant"), 6).alias("recall"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def wilson(k: Column, n: Column, empty: float | None = None) -> Column:
    """struct(low, high): the 95 % interval of k of n; both `empty` where n is zero (two contracts: None, 0.0)."""
    n = n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    mid = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    bound = lambda x: F.when(n > 0, F.round(x, 6)).otherwise(F.lit(empty).cast("double"))
    return F.struct(bound(F.greatest(F.lit(0.0), mid - half)).alias("low"), bound(F.least(F.lit(1.0), mid + half)).alias("high"))


def exact_mcnemar(gained: Column, lost: Column) -> Column:
    """Two-sided exact binomial p of gained against lost pairs."""
    n, k = (gained + lost).cast("int"), F.least(gained, lost).cast("int")
    # terms C(n, i) / 2^n, each from the one before
    tail = F.aggregate(
        F.sequence(F.lit(0), k), F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")), lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc: the chance that a positive scores above a negative, ties half; from counts by distinct score."""
    levels = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = levels.select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("wins"))
    return wins.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.round(F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc"))


def average_precision(df: DataFrame, by: list[str], order: list[Column], positive: Column) -> DataFrame:
    """by..., average precision over the ordered rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    hit = F.when(positive, 1).otherwise(0)
    rows = df.withColumn("i", F.row_number().over(w)).withColumn("hit", hit).withColumn("upto", F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by).agg(F.round(F.sum(F.col("hit") * F.col("upto") / F.col("i")) / F.nullif(F.sum("hit"), F.lit(0)), 6).alias("ap"))


def paired(base: DataFrame, candidate: DataFrame, k: int = 5) -> DataFrame:
    """Counts over queries ranked by both: rescues and regressions at 1 and k, better and worse ranks, and McNemar's p.

    base and candidate: (query_id, rank), rank null where the target isn't ranked. Keys of one side only count
    as unpaired."""
    far = F.lit(1_000_000)
    j = base.select("query_id", F.coalesce("rank", far).alias("a")).join(candidate.select("query_id", F.coalesce("rank", far).alias("b")), "query_id", "full")
    a, b = F.col("a"), F.col("b")
    gained, lost = F.count_if((a > k) & (b <= k)), F.count_if((a <= k) & (b > k))
    out = j.agg(
        F.count_if(a.isNull() | b.isNull()).alias("unpaired"), gained.alias("rescues"), lost.alias("regressions"), F.count_if((a > 1) & (b <= 1)).alias("rescues_top1"), F.count_if((a <= 1) & (b > 1)).alias("regressions_top1"),
        F.count_if(b < a).alias("better"), F.count_if(b > a).alias("worse"), F.count_if((a <= k) & (b <= k)).alias("both"), F.count_if((a > k) & (b > k)).alias("neither"),
    )
    return out.withColumn("mcnemar_p", F.round(exact_mcnemar(F.col("rescues"), F.col("regressions")), 6))
