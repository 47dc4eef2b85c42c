"""Inverted BM25 index: term statistics, postings, scoring, exact surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.store import small

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
EXACT_BOOST = 1_000_000.0


def term_frequencies(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(doc_id, term, tf) of docs (doc_id, tokens), with the columns `by` in front."""
    keys = by or []
    return docs.select(*keys, "doc_id", F.explode("tokens").alias("term")).groupBy(*keys, "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_docs (empty documents count) and avgdl: one row, or one for each value of `by`."""
    size = F.size("tokens")
    return docs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_docs"), (F.sum(size) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def contribution(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1e-9))))


def postings(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., term, doc_id, tf, df, dl, weight): a document's score for a query is the sum of its weights.

    A document's length travels with its tokens, so one shuffle groups tokens by document; document frequencies
    are added up before the shuffle by term and come back by an equi-join on the term, which adaptive
    execution can split for frequent ones. The statistics are one row (or one per lane) and are broadcast.
    """
    keys = by or []
    tf = docs.select(*keys, "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(*keys, "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    out = tf.join(df, [*keys, "term"])
    stats = corpus_statistics(docs, keys)
    out = out.join(F.broadcast(stats), keys) if keys else out.crossJoin(F.broadcast(stats))  # one row
    weight = contribution(idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return out.select(*keys, "term", "doc_id", "tf", "df", "dl", weight.alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): distinct terms of queries (query_id, tokens)."""
    return queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))


def scores(queries: DataFrame, index: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(query_id, by..., doc_id, score) of all documents that share a term with a query."""
    keys = by or []
    hits = index.select(*keys, "term", "doc_id", "weight").join(small(query_terms(queries)), "term")
    return hits.groupBy("query_id", *keys, "doc_id").agg(F.sum("weight").alias("score"))


def exact_hits(queries: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(query_id, doc_id): queries (query_id, surface) that equal a surface (surface, doc_id); once for each pair."""
    return queries.join(surfaces, "surface").select("query_id", "doc_id").distinct()


def with_exact(scored: DataFrame, exact: DataFrame, boost: float = EXACT_BOOST) -> DataFrame:
    """Scores with the boost for exact surfaces; an exact document without a shared term ranks too."""
    return scored.unionByName(exact.withColumn("score", F.lit(boost))).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def ranked(scored: DataFrame, k: int | None = None, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Positive scores with rank by falling score and rising doc_id, the first k of each query."""
    w = Window.partitionBy("query_id", *(by or [])).orderBy(F.desc(F.round("score", digits)), "doc_id")
    out = scored.where("score > 0").withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def diagnostics(queries: DataFrame, index: DataFrame) -> DataFrame:
    """unique_terms, matched_terms, postings_visited, candidates of every query."""
    terms = query_terms(queries)
    hits = terms.join(index.select("term", "doc_id"), "term").groupBy("query_id").agg(
        F.countDistinct("term").alias("matched_terms"), F.count(F.lit(1)).alias("postings_visited"), F.countDistinct("doc_id").alias("candidates")
    )
    own = queries.select("query_id", F.size(F.array_distinct("tokens")).cast("long").alias("unique_terms"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("matched_terms", "postings_visited", "candidates")]
    return own.join(hits, "query_id", "left").select("query_id", "unique_terms", *zero)


def support_terms(queries: DataFrame, index: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, doc_id, terms): the shared terms behind each result, sorted."""
    hits = results.select("query_id", "doc_id").join(query_terms(queries), "query_id").join(index.select("term", "doc_id", "weight"), ["term", "doc_id"])
    return hits.where("weight > 0").groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
