"""Evaluation of ranked lists, display gates and calibration.

Judgments: a document is relevant to a benchmark passage if both share a run of four tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.counts import count_rows
from lexforge.functions import text as T
from lexforge.operators import index, metrics, store
from lexforge.plans.registry import Tables, query
from lexforge.plans.retrieval import DOCS_SQL, FUSE_SQL, TOP_SQL, bm25_topk, char_gram_bm25, documents, posted, questions, rounded
from lexforge.plans.text_pack import FOUR_SQL, four_grams

JUDGED_SQL = f"{FOUR_SQL}, jd AS (SELECT DISTINCT item_id AS query_id, doc_id FROM g JOIN b USING (gram))".replace("b AS (SELECT DISTINCT item_id", "b4 AS (SELECT DISTINCT item_id").replace("JOIN b USING", "JOIN b4 USING").replace("v AS (SELECT item_id", "v4 AS (SELECT item_id").replace("FROM v WHERE", "FROM v4 WHERE").replace("w AS (SELECT doc_id,", "w4 AS (SELECT doc_id,").replace("FROM w WHERE", "FROM w4 WHERE").replace("g AS (SELECT DISTINCT doc_id", "g4 AS (SELECT DISTINCT doc_id").replace("FROM g JOIN", "FROM g4 JOIN")


def judgments(t: Tables) -> DataFrame:
    asked = four_grams(t.benchmark, "item_id").withColumnRenamed("item_id", "query_id")
    return four_grams(t.documents, "doc_id").join(store.small(asked), "gram").select("query_id", "doc_id").distinct()


RANKS_SQL = f"{FUSE_SQL}, {JUDGED_SQL}, ra AS (SELECT jd.query_id, min(a.rank) AS rank FROM jd LEFT JOIN a ON a.query_id = jd.query_id AND a.doc_id = jd.doc_id GROUP BY jd.query_id), rb AS (SELECT jd.query_id, min(b.rank) AS rank FROM jd LEFT JOIN b ON b.query_id = jd.query_id AND b.doc_id = jd.doc_id GROUP BY jd.query_id)"


@query(f"{RANKS_SQL} SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ra")
def hit_rates(t: Tables) -> DataFrame:
    """Top-1, hits at 5 and 10, and mean reciprocal rank of the word ranking."""
    return metrics.hit_rates(metrics.target_ranks(bm25_topk(t), judgments(t)))


@query(f"""{RANKS_SQL}, f AS (SELECT jd.query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM jd JOIN a ON a.query_id = jd.query_id AND a.doc_id = jd.doc_id GROUP BY jd.query_id), n AS (SELECT query_id, count(*) AS relevant FROM jd GROUP BY query_id)
SELECT n.query_id, relevant, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= relevant), 6) AS ndcg FROM n LEFT JOIN f ON f.query_id = n.query_id""")
def recall_and_ndcg(t: Tables) -> DataFrame:
    """Recall and binary nDCG at 10 of each query."""
    return metrics.recall_ndcg(bm25_topk(t), judgments(t))


@query(f"""{RANKS_SQL}, p AS (SELECT coalesce(ra.rank, 1000000) AS x, coalesce(rb.rank, 1000000) AS y FROM ra FULL JOIN rb ON ra.query_id = rb.query_id),
c AS (SELECT 0 AS unpaired, count(*) FILTER (x > 5 AND y <= 5) AS rescues, count(*) FILTER (x <= 5 AND y > 5) AS regressions, count(*) FILTER (x > 1 AND y <= 1) AS rescues_top1, count(*) FILTER (x <= 1 AND y > 1) AS regressions_top1, count(*) FILTER (y < x) AS better, count(*) FILTER (y > x) AS worse, count(*) FILTER (x <= 5 AND y <= 5) AS "both", count(*) FILTER (x > 5 AND y > 5) AS neither FROM p)
SELECT *, round(CASE WHEN rescues + regressions = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(rescues + regressions + 1) - lgamma(i + 1) - lgamma(rescues + regressions - i + 1) + (rescues + regressions) * ln(0.5))) FROM range(0, 1000) r(i) WHERE i <= least(rescues, regressions))) END, 6) AS mcnemar_p FROM c""")
def paired_rankings(t: Tables) -> DataFrame:
    """Words against character 4-grams, case by case, with the exact McNemar test."""
    j = store.written(judgments(t), "judged")
    return metrics.paired(metrics.target_ranks(bm25_topk(t), j), metrics.target_ranks(char_gram_bm25(t), j))


@query("""WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), w AS (SELECT lang, n, k, k / CAST(n AS DOUBLE) AS p, 1.959963984540054 AS z FROM c)
SELECT lang, n, k, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM w""")
def wilson_intervals(t: Tables) -> DataFrame:
    """Shares by stratum with their 95 % intervals."""
    c = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(count_rows().alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return c.withColumn("w", metrics.wilson(F.col("k"), F.col("n"))).select("lang", "n", "k", "w.low", "w.high")


SCORED_SQL = "x AS (SELECT doc_id, lang, quality, toxic, length(text) AS score FROM documents JOIN labels USING (doc_id))"


def scored(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", F.length("text").cast("long").alias("score")).join(t.labels, "doc_id")


@query(f"""WITH {SCORED_SQL}, r AS (SELECT toxic, avg(rn) OVER (PARTITION BY score) AS rk FROM (SELECT toxic, score, row_number() OVER (ORDER BY score) AS rn FROM x)), s AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n, sum(rk) FILTER (toxic = 1) AS rs FROM r)
SELECT p AS positives, n AS negatives, round((rs - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""")
def auc(t: Tables) -> DataFrame:
    """Area under the curve by counting pairs, ties half, from counts by distinct score."""
    return metrics.rank_auc(scored(t), "score", "toxic")


@query(f"""WITH {SCORED_SQL}, r AS (SELECT lang, toxic, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS i, sum(toxic) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS u FROM x) SELECT lang, round(sum(toxic * u / i) / nullif(sum(toxic), 0), 6) AS ap FROM r GROUP BY lang""")
def average_precisions(t: Tables) -> DataFrame:
    """Average precision of a ranking by score in every stratum, ties by id."""
    return metrics.average_precision(scored(t), ["lang"], [F.desc("score"), F.col("doc_id")], F.col("toxic") == 1)


@query(f"""{RANKS_SQL}, s AS (SELECT ra.query_id, ra.rank, d.w FROM ra JOIN (SELECT item_id, length(text) AS w FROM benchmark) d ON d.item_id = ra.query_id), e AS (SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM jd))
SELECT round(sum(CASE WHEN rank <= 5 THEN w ELSE 0 END) / sum(w), 6) AS weighted_hit5, (SELECT count(*) FROM e) AS no_match, (SELECT count(*) FROM e WHERE query_id NOT IN (SELECT query_id FROM s0)) AS abstained, (SELECT count(*) FROM e WHERE query_id IN (SELECT query_id FROM s0)) AS false_confident FROM s""".replace("e AS (SELECT item_id", "s0 AS (SELECT DISTINCT query_id FROM a WHERE rank = 1 AND (SELECT max(score) FROM s WHERE s.query_id = a.query_id) >= 100), e AS (SELECT item_id").replace(", s AS (SELECT ra.query_id", ", s1 AS (SELECT ra.query_id").replace("FROM s\"\"\"", "FROM s1\"\"\"").replace("AS false_confident FROM s", "AS false_confident FROM s1"))
def weighted_and_abstention(t: Tables) -> DataFrame:
    """Hits weighted by volume (length), and how often a query without a relevant document gets a confident result."""
    results, j = bm25_topk(t), judgments(t)
    volume = t.benchmark.select(F.col("item_id").alias("query_id"), F.length("text").alias("w"))
    hits = metrics.target_ranks(results, j).join(volume, "query_id").agg(F.round(F.sum(F.when(F.col("rank") <= 5, F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("weighted_hit5"))
    confident = results.where("rank = 1 and score >= 100").select("query_id", F.lit(True).alias("confident"))
    none = volume.join(j, "query_id", "left_anti").join(confident, "query_id", "left")
    shown = F.coalesce("confident", F.lit(False))
    return hits.crossJoin(none.agg(count_rows().alias("no_match"), F.count_if(~shown).alias("abstained"), F.count_if(shown).alias("false_confident")))  # one row each


FEATURES_SQL = f"""{DOCS_SQL}, {JUDGED_SQL}, top AS (SELECT query_id, doc_id, round(score, 6) AS score, {TOP_SQL} AS rank FROM sc WHERE score > 0 QUALIFY rank <= 5),
qi AS (SELECT q.query_id, q.term, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), ln(1 + (n + 0.5) / 0.5)) AS idf FROM q CROSS JOIN st LEFT JOIN df ON df.term = q.term),
qs AS (SELECT query_id, count(*) AS n_terms, sum(idf) AS idf FROM qi GROUP BY query_id),
sh AS (SELECT top.query_id, top.doc_id, count(*) AS shared, sum(idf) AS idf FROM top JOIN qi ON qi.query_id = top.query_id JOIN tf ON tf.doc_id = top.doc_id AND tf.term = qi.term GROUP BY top.query_id, top.doc_id),
fe AS (SELECT top.query_id, top.doc_id, CAST(top.rank AS INTEGER) AS rank, round(score / max(score) OVER (PARTITION BY top.query_id), 6) AS ratio, shared, round(shared / n_terms, 6) AS coverage, round(sh.idf / qs.idf, 6) AS idf_coverage, jd.doc_id IS NOT NULL AS relevant
  FROM top JOIN sh ON sh.query_id = top.query_id AND sh.doc_id = top.doc_id JOIN qs ON qs.query_id = top.query_id LEFT JOIN jd ON jd.query_id = top.query_id AND jd.doc_id = top.doc_id)"""


def features(t: Tables) -> DataFrame:
    """Features of the first five candidates of each query: score ratio, shared tokens, coverage, coverage by idf."""
    docs, asked = documents(t), questions(t)
    own = posted(t)
    top = store.written(rounded(index.ranked(index.scores(asked, own), 5), "score"), "top")
    stats = index.corpus_statistics(docs)
    df = own.groupBy("term").agg(F.first("df").alias("df"))
    terms = index.query_terms(asked).join(df, "term", "left").crossJoin(F.broadcast(stats))  # one row
    weigh = terms.select("query_id", "term", index.idf(F.col("n_docs"), F.coalesce("df", F.lit(0))).alias("idf"))
    whole = weigh.groupBy("query_id").agg(count_rows().alias("n_terms"), F.sum("idf").alias("all_idf"))
    shared = top.select("query_id", "doc_id").join(weigh, "query_id").join(own.select("term", "doc_id"), ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(count_rows().alias("shared"), F.sum("idf").alias("idf"))
    j = judgments(t).withColumn("relevant", F.lit(True))
    out = top.join(shared, ["query_id", "doc_id"]).join(whole, "query_id").join(j, ["query_id", "doc_id"], "left")
    ratio = F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6)
    return out.select("query_id", "doc_id", "rank", ratio.alias("ratio"), "shared", F.round(F.col("shared") / F.col("n_terms"), 6).alias("coverage"), F.round(F.col("idf") / F.col("all_idf"), 6).alias("idf_coverage"), F.coalesce("relevant", F.lit(False)).alias("relevant"))


@query(f"WITH {FEATURES_SQL} SELECT * FROM fe")
def candidate_features(t: Tables) -> DataFrame:
    """What a display gate sees of each candidate; unknown tokens weigh as the rarest."""
    return features(t)


@query(f"""WITH {FEATURES_SQL}, gr AS (SELECT r.r / 10.0 AS min_ratio, c.c / 10.0 AS min_coverage, s.s AS min_shared FROM range(0, 10) r(r), range(0, 10) c(c), range(1, 7) s(s)),
ev AS (SELECT min_ratio, min_coverage, min_shared, count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant AND keep) AS kept_relevant, count(*) FILTER (NOT relevant AND keep) AS kept_other, count(*) FILTER (keep) AS kept
  FROM (SELECT *, rank = 1 OR (ratio >= min_ratio AND idf_coverage >= min_coverage AND shared >= min_shared) AS keep FROM fe CROSS JOIN gr) GROUP BY min_ratio, min_coverage, min_shared)
SELECT CAST(min_ratio AS DOUBLE) AS min_ratio, CAST(min_coverage AS DOUBLE) AS min_coverage, CAST(min_shared AS INTEGER) AS min_shared, relevant, kept_relevant, kept_other, kept FROM ev WHERE kept_relevant >= 0.98 * relevant""")
def threshold_grid(t: Tables) -> DataFrame:
    """600 rules over the candidates, those that keep 98 % of the relevant ones; the grid is fixed and broadcast."""
    grid = t.spark.createDataFrame([(r / 10, c / 10, s) for r in range(10) for c in range(10) for s in range(1, 7)], "min_ratio double, min_coverage double, min_shared int")
    keep = (F.col("rank") == 1) | ((F.col("ratio") >= F.col("min_ratio")) & (F.col("idf_coverage") >= F.col("min_coverage")) & (F.col("shared") >= F.col("min_shared")))
    cells = features(t).crossJoin(F.broadcast(grid)).withColumn("keep", keep)  # 600 fixed rows, aggregated at once
    rel = F.col("relevant")
    out = cells.groupBy("min_ratio", "min_coverage", "min_shared").agg(F.count_if(rel).alias("relevant"), F.count_if(rel & F.col("keep")).alias("kept_relevant"), F.count_if(~rel & F.col("keep")).alias("kept_other"), F.count_if("keep").alias("kept"))
    return out.where("kept_relevant >= 0.98 * relevant")


@query(f"""WITH {FEATURES_SQL}, co AS (SELECT query_id, doc_id, relevant, rank, unnest(['lexical', 'mean', 'product', 'weakest']) AS formula, unnest([idf_coverage, (ratio + idf_coverage) / 2, ratio * idf_coverage, least(ratio, idf_coverage, coverage)]) AS confidence FROM fe)
SELECT formula, round(min(confidence) FILTER (relevant), 6) AS threshold, count(*) FILTER (relevant) AS relevant, count(*) FILTER (NOT relevant AND confidence >= (SELECT min(confidence) FROM co c2 WHERE c2.formula = co.formula AND c2.relevant)) AS others_kept FROM co GROUP BY formula""")
def confidence_formulas(t: Tables) -> DataFrame:
    """Four confidence formulas and the threshold of each that loses no relevant candidate."""
    r, i, c = F.col("ratio"), F.col("idf_coverage"), F.col("coverage")
    named = {"lexical": i, "mean": (r + i) / 2, "product": r * i, "weakest": F.least(r, i, c)}
    rows = features(t).select("relevant", F.explode(F.array(*(F.struct(F.lit(k).alias("formula"), v.alias("confidence")) for k, v in named.items()))).alias("x")).select("relevant", "x.*")
    low = rows.where("relevant").groupBy("formula").agg(F.min("confidence").alias("low"), count_rows().alias("relevant"))
    kept = rows.where("not relevant").join(low.select("formula", "low"), "formula").groupBy("formula").agg(F.count_if(F.col("confidence") >= F.col("low")).alias("others_kept"))
    return low.join(kept, "formula", "left").select("formula", F.round("low", 6).alias("threshold"), "relevant", F.coalesce("others_kept", F.lit(0)).alias("others_kept"))


@query(f"""WITH {FEATURES_SQL}, lt AS (SELECT top.query_id, top.doc_id, qi.term, qi.idf, count(*) OVER (PARTITION BY top.query_id, qi.term) AS local_df FROM top JOIN qi ON qi.query_id = top.query_id JOIN tf ON tf.doc_id = top.doc_id AND tf.term = qi.term)
SELECT query_id, doc_id, round(sum(idf * ln(6.0 / (1 + local_df))), 6) AS contrast, round(sum(idf / local_df), 6) AS shared_out, round(sum(CASE WHEN local_df = 1 THEN idf ELSE 0 END), 6) AS exclusive FROM lt GROUP BY query_id, doc_id""")
def local_contrast(t: Tables) -> DataFrame:
    """What of a candidate's evidence the other four lack: document counts inside the first five."""
    docs, asked = documents(t), questions(t)
    own = posted(t)
    top = index.ranked(index.scores(asked, own), 5).select("query_id", "doc_id")
    hits = top.join(index.query_terms(asked), "query_id").join(own.select("term", "doc_id", "df"), ["term", "doc_id"]).crossJoin(F.broadcast(index.corpus_statistics(docs)))  # one row
    idf = index.idf(F.col("n_docs"), F.col("df"))
    local = hits.select("query_id", "doc_id", idf.alias("idf"), count_rows().over(Window.partitionBy("query_id", "term")).alias("local_df"))
    s = lambda x: F.round(F.sum(x), 6)
    return local.groupBy("query_id", "doc_id").agg(s(F.col("idf") * F.log(6 / (1 + F.col("local_df")))).alias("contrast"), s(F.col("idf") / F.col("local_df")).alias("shared_out"), s(F.when(F.col("local_df") == 1, F.col("idf")).otherwise(0.0)).alias("exclusive"))


@query(f"""WITH {FEATURES_SQL}, fm AS (SELECT fe.*, lang, first_value(lang) OVER (PARTITION BY query_id ORDER BY rank) AS first_lang, sum(ratio) OVER (PARTITION BY query_id, lang) / sum(ratio) OVER (PARTITION BY query_id) AS mass FROM fe JOIN documents USING (doc_id))
SELECT query_id, doc_id, rank, lang = first_lang AS same_family, round(mass, 6) AS mass, CASE WHEN rank = 1 OR lang = first_lang OR idf_coverage >= 0.5 THEN 'keep' WHEN idf_coverage >= 0.3 THEN 'uncertain' ELSE 'drop' END AS verdict FROM fm""")
def family_gate(t: Tables) -> DataFrame:
    """Candidates of the first one's family (language) stay, others need confidence; each family's share of the mass."""
    f = features(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    by = Window.partitionBy("query_id")
    first = F.first("lang").over(by.orderBy("rank"))
    mass = F.sum("ratio").over(Window.partitionBy("query_id", "lang")) / F.sum("ratio").over(by)
    same = F.col("lang") == F.col("first_lang")
    verdict = F.when((F.col("rank") == 1) | same | (F.col("idf_coverage") >= 0.5), "keep").when(F.col("idf_coverage") >= 0.3, "uncertain").otherwise("drop")
    return f.withColumn("first_lang", first).withColumn("mass", F.round(mass, 6)).select("query_id", "doc_id", "rank", same.alias("same_family"), "mass", verdict.alias("verdict"))


@query(f"""WITH {FEATURES_SQL}, k AS (SELECT *, rank = 1 OR idf_coverage >= 0.3 AS shown FROM fe), pq AS (SELECT query_id, bool_or(relevant) AS hit_before, bool_or(relevant AND shown) AS hit_after, count(*) FILTER (shown) AS n_shown, count(*) FILTER (NOT relevant AND shown) AS negatives, min(rank) FILTER (relevant AND shown) AS first_acceptable FROM k GROUP BY query_id)
SELECT count(*) AS cases, count(*) FILTER (hit_before) AS hit5, count(*) FILTER (hit_after) AS hit5_kept, round(avg(n_shown), 6) AS mean_shown, CAST(sum(negatives) AS BIGINT) AS negatives_shown, count(*) FILTER (negatives = 0) AS clean_lists, round(avg(first_acceptable), 6) AS first_acceptable FROM pq""")
def retention_summary(t: Tables) -> DataFrame:
    """What a gate keeps: hits, list length, negatives shown, lists without any, first acceptable rank."""
    rel, shown = F.col("relevant"), F.col("shown")
    per = features(t).withColumn("shown", (F.col("rank") == 1) | (F.col("idf_coverage") >= 0.3)).groupBy("query_id").agg(
        F.bool_or("relevant").alias("before"), F.bool_or(rel & shown).alias("after"), F.count_if("shown").alias("n_shown"), F.count_if(~rel & shown).alias("negatives"), F.min(F.when(rel & shown, F.col("rank"))).alias("first")
    )
    return per.agg(count_rows().alias("cases"), F.count_if("before").alias("hit5"), F.count_if("after").alias("hit5_kept"), F.round(F.avg("n_shown"), 6).alias("mean_shown"), F.sum("negatives").alias("negatives_shown"), F.count_if(F.col("negatives") == 0).alias("clean_lists"), F.round(F.avg("first"), 6).alias("first_acceptable"))


@query(f"""WITH {FEATURES_SQL} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY sha256('blind:' || query_id || ':' || doc_id)) AS payload FROM fe GROUP BY query_id""")
def blinded_payload(t: Tables) -> DataFrame:
    """Candidates of a query in an order that hides the ranking, the same each time."""
    key = F.sha2(F.concat(F.lit("blind:"), F.col("query_id").cast("string"), F.lit(":"), F.col("doc_id").cast("string")), 256)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("h"), "doc_id"))), lambda s: s["doc_id"].cast("string"))
    return features(t).groupBy("query_id").agg(F.array_join(rows, ",").alias("payload"))


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (v) AS viewed, count(*) FILTER (v AND c) AS clicked, count(*) FILTER (v AND c AND s) AS signed, count(*) FILTER (v AND c AND s AND p) AS bought, round(count(*) FILTER (v AND c AND s AND p) / nullif(count(*) FILTER (v), 0), 6) AS conversion FROM u""")
def funnel(t: Tables) -> DataFrame:
    """An ordered funnel: each step counts those that took all steps before it."""
    steps = ["view", "click", "signup", "purchase"]
    u = t.events.groupBy("user_id").agg(*(F.bool_or(F.col("event_type") == s).alias(s) for s in steps))
    upto: list[Column] = []
    for s in steps:
        upto.append(upto[-1] & F.col(s) if upto else F.col(s))
    counts = [F.count_if(c).alias(n) for c, n in zip(upto, ["viewed", "clicked", "signed", "bought"])]
    return u.agg(count_rows().alias("users"), *counts).withColumn("conversion", F.round(F.col("bought") / F.nullif("viewed", F.lit(0)), 6))


@query("""WITH f AS (SELECT turn % 4 AS fold, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY turn % 4, role), s AS (SELECT role, sum(n) AS n, sum(chars) AS chars FROM f GROUP BY role)
SELECT f.fold, f.role, f.n AS held_out, CAST(s.n - f.n AS BIGINT) AS trained_on, round((s.chars - f.chars) / nullif(s.n - f.n, 0), 6) AS mean_chars FROM f JOIN s ON s.role = f.role""")
def leave_one_fold_out(t: Tables) -> DataFrame:
    """Statistics of all folds but one: totals less the fold's own share, no second scan."""
    f = t.conversations.groupBy((F.col("turn") % 4).alias("fold"), "role").agg(count_rows().alias("n"), F.sum(F.length("text")).alias("chars"))
    s = f.groupBy("role").agg(F.sum("n").alias("all_n"), F.sum("chars").alias("all_chars"))
    rest = F.col("all_n") - F.col("n")
    return f.join(s, "role").select("fold", "role", F.col("n").alias("held_out"), rest.alias("trained_on"), F.round((F.col("all_chars") - F.col("chars")) / F.nullif(rest, F.lit(0)), 6).alias("mean_chars"))


@query(f"""{RANKS_SQL}, l AS (SELECT ra.query_id, coalesce(ra.rank <= 5, false) AS w, coalesce(rb.rank <= 5, false) AS g FROM ra JOIN rb ON ra.query_id = rb.query_id)
SELECT count(*) FILTER (w AND g) AS "both", count(*) FILTER (w AND NOT g) AS words_only, count(*) FILTER (g AND NOT w) AS grams_only, count(*) FILTER (NOT w AND NOT g) AS neither, count(*) FILTER (w OR g) AS either, round(100.0 * (count(*) FILTER (g) - count(*) FILTER (w)) / count(*), 6) AS delta_points FROM l""")
def lane_complement(t: Tables) -> DataFrame:
    """Overlap of two lanes' hits, what each rescues alone, their union, and the difference in points."""
    j = store.written(judgments(t), "judged")
    hit = F.coalesce(F.col("rank") <= 5, F.lit(False))
    a, b = (metrics.target_ranks(r, j).select("query_id", hit.alias(n)) for r, n in ((bm25_topk(t), "w"), (char_gram_bm25(t), "g")))
    w, g = F.col("w"), F.col("g")
    return a.join(b, "query_id").agg(
        F.count_if(w & g).alias("both"), F.count_if(w & ~g).alias("words_only"), F.count_if(g & ~w).alias("grams_only"), F.count_if(~w & ~g).alias("neither"), F.count_if(w | g).alias("either"),
        F.round(100.0 * (F.count_if(g) - F.count_if(w)) / count_rows(), 6).alias("delta_points"),
    )
