"""Retrieval over documents: BM25 and its lanes, expansions and fusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import fusion, index, matched, store
from lexforge.plans.registry import Tables, query

ALPHABET = T.TOKEN
#: tok, tf, dl, st, df and post over documents; q over benchmark.
DOCS_SQL = f"""
tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{ALPHABET}'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / greatest(count(*), 1) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
post AS (SELECT tf.term, tf.doc_id, tf, df, dl, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9))) AS weight
  FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st),
q AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_extract_all(text, '{ALPHABET}'))) AS term FROM benchmark),
sc AS (SELECT query_id, doc_id, sum(weight) AS score FROM q JOIN post ON q.term = post.term GROUP BY query_id, doc_id)
"""
NORM_SQL = "replace(lower(trim(regexp_replace({0}, '[\\s\\x{{00A0}}]+', ' ', 'g'))), 'ß', 'ss')"
TOP_SQL = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)"


def documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", T.tokens(F.col("text")).alias("tokens"), T.norm(F.col("text")).alias("surface"))


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"), T.norm(F.col("text")).alias("surface"))


def posted(t: Tables) -> DataFrame:
    """The compiled index of documents, read from the store."""
    return store.stored(t.documents, "postings", lambda: index.postings(documents(t)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {DOCS_SQL},
x AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id, 1000000.0 AS score FROM benchmark b JOIN documents d ON {NORM_SQL.format('b.text')} = {NORM_SQL.format('d.text')}),
s AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM x) GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, {TOP_SQL} AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def bm25_topk(t: Tables) -> DataFrame:
    """BM25 top 10 of every benchmark passage over all documents, with the boost for exact surfaces."""
    docs, asked = documents(t), questions(t)
    if (found := matched.top(docs, asked, 10, exact=True, source=t.documents)) is not None:
        return found
    scored = index.with_exact(index.scores(asked, posted(t)), index.exact_hits(asked, docs))
    return rounded(index.ranked(scored, 10), "score")


@query(f"WITH {DOCS_SQL} SELECT term, doc_id, tf, df, dl, round(weight, 6) AS weight FROM post")
def bm25_postings(t: Tables) -> DataFrame:
    """The compiled index: the share of every term in every document's score."""
    return rounded(posted(t), "weight").withColumn("dl", F.col("dl").cast("long"))


@query(f"WITH {DOCS_SQL} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM tf) AS n_postings, (SELECT max(df) FROM df) AS max_df FROM st")
def bm25_statistics(t: Tables) -> DataFrame:
    """Corpus statistics and the size of the index."""
    docs = documents(t)
    df = index.term_frequencies(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = df.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"))
    return rounded(index.corpus_statistics(docs), "avgdl").crossJoin(sizes)  # one row each


@query(f"""WITH {DOCS_SQL}, a AS (SELECT item_id AS query_id, doc_id FROM benchmark CROSS JOIN documents),
s AS (SELECT a.query_id, a.doc_id, coalesce(score, 0) AS score FROM a LEFT JOIN sc ON a.query_id = sc.query_id AND a.doc_id = sc.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, CAST({TOP_SQL} AS INTEGER) AS rank FROM s""")
def bm25_rank_all(t: Tables) -> DataFrame:
    """Unfiltered ranking: documents without a shared term rank behind, by doc_id."""
    docs, asked = documents(t), questions(t)
    every = asked.select("query_id").crossJoin(docs.select("doc_id"))  # a stated query set against all documents
    scored = every.join(index.scores(asked, posted(t)), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return rounded(scored.withColumn("rank", F.row_number().over(w)), "score").select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {DOCS_SQL}, h AS (SELECT query_id, count(DISTINCT q.term) AS matched_terms, count(*) AS postings_visited, count(DISTINCT doc_id) AS candidates FROM q JOIN post ON q.term = post.term GROUP BY query_id),
u AS (SELECT item_id AS query_id, (SELECT count(*) FROM q WHERE q.query_id = item_id) AS unique_terms FROM benchmark)
SELECT u.query_id, unique_terms, coalesce(matched_terms, 0) AS matched_terms, coalesce(postings_visited, 0) AS postings_visited, coalesce(candidates, 0) AS candidates FROM u LEFT JOIN h ON u.query_id = h.query_id""")
def query_diagnostics(t: Tables) -> DataFrame:
    """What answering each query touches."""
    return index.diagnostics(questions(t), posted(t))


@query(f"""WITH {DOCS_SQL}, r AS (SELECT query_id, doc_id, {TOP_SQL} AS rank FROM sc WHERE score > 0)
SELECT r.query_id, r.doc_id, string_agg(q.term, ' ' ORDER BY q.term) AS terms FROM r JOIN q ON r.query_id = q.query_id JOIN post ON q.term = post.term AND r.doc_id = post.doc_id WHERE rank <= 5 GROUP BY r.query_id, r.doc_id""")
def support_terms(t: Tables) -> DataFrame:
    """The terms behind each of the first five results."""
    docs, asked = documents(t), questions(t)
    own = posted(t)
    top = index.ranked(index.scores(asked, own), 5)
    return index.support_terms(asked, own, top).withColumn("terms", F.array_join("terms", " "))


@query(f"""WITH {DOCS_SQL}, r AS (SELECT query_id, doc_id, {TOP_SQL} AS rank FROM sc WHERE score > 0)
SELECT r.query_id, r.doc_id, q.term, round(weight, 6) AS weight FROM r JOIN q ON r.query_id = q.query_id JOIN post ON q.term = post.term AND r.doc_id = post.doc_id WHERE rank = 1""")
def term_contributions(t: Tables) -> DataFrame:
    """The score of each first result, term by term."""
    docs, asked = documents(t), questions(t)
    own = posted(t)
    top = index.ranked(index.scores(asked, own), 1).select("query_id", "doc_id")
    out = top.join(index.query_terms(asked), "query_id").join(own.select("term", "doc_id", "weight"), ["term", "doc_id"])
    return rounded(out, "weight").select("query_id", "doc_id", "term", "weight")


LANES_SQL = f"""
tok AS (SELECT lang AS lane, doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{ALPHABET}'))) AS term FROM documents),
tf AS (SELECT lane, doc_id, term, count(*) AS tf FROM tok GROUP BY lane, doc_id, term),
dl AS (SELECT d.lang AS lane, d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.lang, d.doc_id),
st AS (SELECT lane, count(*) AS n, CAST(sum(dl) AS DOUBLE) / greatest(count(*), 1) AS avgdl FROM dl GROUP BY lane),
df AS (SELECT lane, term, count(*) AS df FROM tf GROUP BY lane, term),
post AS (SELECT tf.lane, tf.term, tf.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9))) AS weight
  FROM tf JOIN df ON tf.term = df.term AND tf.lane = df.lane JOIN dl ON tf.doc_id = dl.doc_id AND tf.lane = dl.lane JOIN st ON st.lane = tf.lane),
q AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_extract_all(text, '{ALPHABET}'))) AS term FROM benchmark),
sc AS (SELECT query_id, lane, doc_id, sum(weight) AS score FROM q JOIN post ON q.term = post.term GROUP BY query_id, lane, doc_id),
r AS (SELECT query_id, lane, doc_id, score, row_number() OVER (PARTITION BY query_id, lane ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc WHERE score > 0)
"""


def lanes(t: Tables, k: int) -> DataFrame:
    docs = documents(t).withColumnRenamed("lang", "lane")
    return index.ranked(index.scores(questions(t), store.stored(t.documents, "lane-postings", lambda: index.postings(docs, ["lane"])), ["lane"]), k, ["lane"])


@query(f"WITH {LANES_SQL} SELECT query_id, lane, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def lane_bm25(t: Tables) -> DataFrame:
    """Lanes with statistics of their own (here a lane per language), never mixed."""
    return rounded(lanes(t, 5), "score").select("query_id", "lane", "doc_id", "score", "rank")


@query(f"""WITH {LANES_SQL} SELECT query_id, doc_id, CAST(max(rank) FILTER (lane = 'de') AS INTEGER) AS rank_de, CAST(max(rank) FILTER (lane = 'en') AS INTEGER) AS rank_en,
CAST(max(rank) FILTER (lane = 'es') AS INTEGER) AS rank_es, CAST(max(rank) FILTER (lane = 'fr') AS INTEGER) AS rank_fr, round(max(score), 6) AS best FROM r WHERE rank <= 5 GROUP BY query_id, doc_id""")
def lane_provenance(t: Tables) -> DataFrame:
    """Every result with its rank in each lane."""
    top = lanes(t, 5)
    ranks = [F.max(F.when(F.col("lane") == x, F.col("rank"))).alias(f"rank_{x}") for x in ("de", "en", "es", "fr")]
    return top.groupBy("query_id", "doc_id").agg(*ranks, F.round(F.max("score"), 6).alias("best"))


GRAM_SQL = f"""
w0 AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{ALPHABET}'))) AS w FROM documents),
w1 AS (SELECT doc_id, w, unnest(range(1, length(w) - 2)) AS p FROM w0 WHERE length(w) >= 4),
tok AS (SELECT doc_id, substr(w, p, 4) AS term FROM w1),
""" + DOCS_SQL[DOCS_SQL.index("tf AS (") : DOCS_SQL.index("q AS (")] + f"""
q0 AS (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '{ALPHABET}'))) AS w FROM benchmark),
q1 AS (SELECT query_id, w, unnest(range(1, length(w) - 2)) AS p FROM q0 WHERE length(w) >= 4),
q AS (SELECT DISTINCT query_id, substr(w, p, 4) AS term FROM q1),
sc AS (SELECT query_id, doc_id, sum(weight) AS score FROM q JOIN post ON q.term = post.term GROUP BY query_id, doc_id)
"""


@query(f"WITH {GRAM_SQL}, r AS (SELECT query_id, doc_id, round(score, 6) AS score, {TOP_SQL} AS rank FROM sc WHERE score > 0) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def char_gram_bm25(t: Tables) -> DataFrame:
    """The same ranking over the character 4-grams of tokens."""

    def grams(df: DataFrame) -> DataFrame:
        return df.withColumn("tokens", F.flatten(F.transform("tokens", lambda w: T.char_ngrams(w, 4))))

    if (found := matched.top(documents(t), questions(t), 10, lambda w: [w[i : i + 4] for i in range(len(w) - 3)], source=t.documents)) is not None:
        return found
    return rounded(index.ranked(index.scores(grams(questions(t)), store.stored(t.documents, "gram-postings", lambda: index.postings(grams(documents(t))))), 10), "score")


PHRASE_SQL = f"""
ph AS (SELECT conv_id, turn, conv_id * 1000 + turn AS doc_id, text FROM conversations),
tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{ALPHABET}'))) AS term FROM ph),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM (SELECT DISTINCT doc_id FROM ph) d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
""" + DOCS_SQL[DOCS_SQL.index("st AS (") :]


@query(f"""WITH {PHRASE_SQL}, m AS (SELECT query_id, doc_id // 1000 AS doc_id, max(score) AS score FROM sc GROUP BY query_id, doc_id // 1000),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, {TOP_SQL} AS rank FROM m WHERE score > 0) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def phrase_max(t: Tables) -> DataFrame:
    """Every phrase (a turn) is a document; its owner (the conversation) takes the best phrase's score."""
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), T.tokens(F.col("text")).alias("tokens"))
    best = index.scores(questions(t), store.stored(t.conversations, "turn-postings", lambda: index.postings(turns))).groupBy("query_id", F.expr("doc_id div 1000").alias("doc_id")).agg(F.max("score").alias("score"))
    return rounded(index.ranked(best, 10), "score")


FLAT_SQL = f"""
tok AS (SELECT conv_id AS doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{ALPHABET}'))) AS term FROM conversations),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
""" + DOCS_SQL[DOCS_SQL.index("st AS (") :]


@query(f"WITH {FLAT_SQL}, r AS (SELECT query_id, doc_id, round(score, 6) AS score, {TOP_SQL} AS rank FROM sc WHERE score > 0) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def flattened_owner(t: Tables) -> DataFrame:
    """The other document unit: all phrases of an owner as one document."""
    owners = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.flatten(F.collect_list(T.tokens(F.col("text")))).alias("tokens"))
    return rounded(index.ranked(index.scores(questions(t), store.stored(t.conversations, "owner-postings", lambda: index.postings(owners))), 10), "score")


@query(f"""WITH {DOCS_SQL}, r AS (SELECT query_id, doc_id, score, {TOP_SQL} AS rank FROM (SELECT query_id, doc_id, sum(weight) AS score FROM q JOIN post ON q.term = post.term WHERE NOT regexp_full_match(q.term, '[0-9]+') GROUP BY query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def bm25_query_without_numbers(t: Tables) -> DataFrame:
    """Pure numbers leave the query only, not the index."""
    asked = questions(t).withColumn("tokens", T.without_numbers(F.col("tokens")))
    if (found := matched.top(documents(t), asked, 10, source=t.documents, also=questions(t))) is not None:
        return found
    return rounded(index.ranked(index.scores(asked, posted(t)), 10), "score")


@query()
def stem_bm25(t: Tables) -> DataFrame:
    """BM25 top 10 over stems, and over tokens and stems together (tested on a small case)."""
    from lexforge.plans.text_pack import stemmed

    out = None
    for raw, name in ((False, "stem"), (True, "raw_stem")):
        top = matched.top(documents(t), questions(t), 10, lambda w, raw=raw: [w] * raw + [f"m:{T.swedish_stem(w)}"], source=t.documents)
        if top is None:
            own = store.stored(t.documents, f"{name}-postings", lambda raw=raw: index.postings(stemmed(documents(t), "doc_id", raw)))
            top = rounded(index.ranked(index.scores(stemmed(questions(t), "query_id", raw), own), 10), "score")
        top = top.withColumn("features", F.lit(name))
        out = top if out is None else out.unionByName(top)
    return out


def two_lists(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three ranked lists to fuse: words, character 4-grams and phrases of conversations (by owner), ten each."""
    return words_list(t), grams_list(t), store.written(bm25_query_without_numbers(t), "list")


def words_list(t: Tables) -> DataFrame:
    return store.written(bm25_topk(t), "list")


def grams_list(t: Tables) -> DataFrame:
    return store.written(char_gram_bm25(t), "list")


FUSE_SQL = f"""WITH {DOCS_SQL},
x AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id, 1000000.0 AS score FROM benchmark b JOIN documents d ON {NORM_SQL.format('b.text')} = {NORM_SQL.format('d.text')}),
s AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM x) GROUP BY query_id, doc_id),
a AS (SELECT query_id, doc_id, {TOP_SQL} AS rank FROM s WHERE score > 0 QUALIFY rank <= 10),
gw1 AS (SELECT doc_id, w, unnest(range(1, length(w) - 2)) AS p FROM (SELECT doc_id, term AS w FROM tok) WHERE length(w) >= 4),
gtf AS (SELECT doc_id, substr(w, p, 4) AS term, count(*) AS tf FROM gw1 GROUP BY doc_id, substr(w, p, 4)),
gdl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN gtf ON d.doc_id = gtf.doc_id GROUP BY d.doc_id),
gst AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / greatest(count(*), 1) AS avgdl FROM gdl),
gdf AS (SELECT term, count(*) AS df FROM gtf GROUP BY term),
gq1 AS (SELECT query_id, w, unnest(range(1, length(w) - 2)) AS p FROM (SELECT query_id, term AS w FROM q) WHERE length(w) >= 4),
gq AS (SELECT DISTINCT query_id, substr(w, p, 4) AS term FROM gq1),
gsc AS (SELECT query_id, gtf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9)))) AS score
  FROM gq JOIN gtf ON gq.term = gtf.term JOIN gdf ON gdf.term = gtf.term JOIN gdl ON gdl.doc_id = gtf.doc_id CROSS JOIN gst GROUP BY query_id, gtf.doc_id),
b AS (SELECT query_id, doc_id, {TOP_SQL} AS rank FROM gsc WHERE score > 0 QUALIFY rank <= 10)
"""


@query(f"""{FUSE_SQL}, u AS (SELECT query_id, doc_id, rank, 0 AS list FROM a UNION ALL SELECT query_id, doc_id, rank, 1 FROM b),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(rank) FILTER (list = 0) AS canonical FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, canonical ASC NULLS LAST, doc_id) AS INTEGER) AS rank FROM f""")
def fuse_reciprocal(t: Tables) -> DataFrame:
    """Reciprocal rank fusion of words and character 4-grams."""
    return rounded(fusion.reciprocal_ranks([words_list(t), grams_list(t)]), "score", digits=9)


@query(f"""{FUSE_SQL}, n AS (SELECT b.query_id, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY rank) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.rank = 1) AND EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id)),
u AS (SELECT query_id, doc_id, 0 AS list, rank FROM a WHERE rank = 1 UNION ALL SELECT query_id, doc_id, 1, rank FROM n WHERE rank <= 2 UNION ALL SELECT query_id, doc_id, 2, rank FROM a
  UNION ALL SELECT query_id, doc_id, 3, rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id)),
m AS (SELECT query_id, doc_id, min(list * 1000 + rank) AS pos FROM u GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS INTEGER) AS rank, CAST(pos // 1000 AS INTEGER) AS list FROM m)
SELECT query_id, doc_id, rank, list FROM r WHERE rank <= 5""")
def fuse_slots(t: Tables) -> DataFrame:
    """The words' best result, two new ones by 4-grams, then the words' rest."""
    return fusion.slots(words_list(t), grams_list(t), 2)


@query(f"""{FUSE_SQL}, c AS (SELECT query_id, doc_id, {TOP_SQL} AS rank FROM (SELECT query_id, doc_id, sum(weight) AS score FROM q JOIN post ON q.term = post.term WHERE NOT regexp_full_match(q.term, '[0-9]+') GROUP BY query_id, doc_id) QUALIFY rank <= 10),
a1 AS (SELECT query_id, doc_id FROM a WHERE rank = 1),
b1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM b WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE a1.query_id = b.query_id AND a1.doc_id = b.doc_id) QUALIFY nth <= 1),
c1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM c WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE a1.query_id = c.query_id AND a1.doc_id = c.doc_id) AND NOT EXISTS (SELECT 1 FROM b1 WHERE b1.query_id = c.query_id AND b1.doc_id = c.doc_id) QUALIFY nth <= 3),
u AS (SELECT query_id, doc_id, 0 AS list, 1 AS rank FROM a1 UNION ALL SELECT query_id, doc_id, 1, nth FROM b1 UNION ALL SELECT query_id, doc_id, 2, nth FROM c1 UNION ALL SELECT query_id, doc_id, 3, rank FROM c
  UNION ALL SELECT query_id, doc_id, 4, rank FROM b UNION ALL SELECT query_id, doc_id, 5, rank FROM a),
m AS (SELECT query_id, doc_id, min(list * 1000 + rank) AS pos FROM u GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS INTEGER) AS rank, CAST(pos // 1000 AS INTEGER) AS list FROM m)
SELECT query_id, doc_id, rank, list FROM r WHERE rank <= 5""")
def fuse_quotas(t: Tables) -> DataFrame:
    """One by words, one by 4-grams, three by words without numbers, filled up in reverse."""
    return fusion.quotas(*two_lists(t), 1, 3)


@query(f"""{FUSE_SQL}, e AS (SELECT DISTINCT query_id FROM x)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM a WHERE query_id IN (SELECT query_id FROM e) UNION ALL SELECT query_id, doc_id, CAST(rank AS INTEGER) FROM b WHERE query_id NOT IN (SELECT query_id FROM e)""")
def fuse_guarded(t: Tables) -> DataFrame:
    """Words for queries that equal a document, 4-grams for the others."""
    exact = index.exact_hits(store.small(questions(t)), documents(t)).select("query_id").distinct()
    return fusion.guarded(words_list(t).select("query_id", "doc_id", "rank"), grams_list(t).select("query_id", "doc_id", "rank"), exact)
