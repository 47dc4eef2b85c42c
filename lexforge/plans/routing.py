"""Short-query routing, fuzzy fallback, expansions and pruning over a vocabulary of named concepts.

The concepts are the distinct names of part (doc_id: the smallest key of a name); queries are their
misspelt or shortened forms, so that every branch is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.counts import count_rows
from lexforge.functions import text as T
from lexforge.operators import fusion, index
from lexforge.plans.registry import Tables, query
from lexforge.plans.retrieval import ALPHABET, DOCS_SQL, documents, rounded

# What a surface signal adds to a short query's score.
SIGNAL_BOOST = {4: 1_000_000.0, 3: 10_000.0, 2: 5_000.0, 1: 2_500.0}

#: nm: concepts; qs: queries (every name, its first word, the name without its middle letter, unknown words).
VOCAB_SQL = """nm AS (SELECT p_name AS name, min(p_partkey) AS doc_id FROM part GROUP BY p_name),
qs AS (SELECT doc_id * 10 AS query_id, name AS query FROM nm UNION ALL SELECT doc_id * 10 + 1, string_split(name, ' ')[1] FROM nm UNION ALL SELECT doc_id * 10 + 2, substr(name, 1, length(name) // 2) || substr(name, length(name) // 2 + 2) FROM nm UNION ALL SELECT 7, 'unheard thing'),
nt AS (SELECT doc_id, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS term FROM nm), qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z]+')) AS term FROM qs),
vt AS (SELECT DISTINCT term FROM nt), qd AS (SELECT DISTINCT term FROM qt),
pr AS (SELECT qd.term AS q, vt.term AS v, CASE WHEN qd.term = vt.term THEN 3 WHEN length(qd.term) >= 6 AND length(vt.term) >= 6 AND (contains(qd.term, vt.term) OR contains(vt.term, qd.term)) THEN 2
  WHEN length(qd.term) >= 6 AND length(vt.term) >= 6 AND levenshtein(qd.term, vt.term) <= CASE WHEN least(length(qd.term), length(vt.term)) >= 9 THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS signal FROM qd CROSS JOIN vt),
sg AS (SELECT query_id, doc_id, max(signal) AS signal FROM (SELECT qt.query_id, nt.doc_id, signal FROM qt JOIN pr ON pr.q = qt.term JOIN nt ON nt.term = pr.v WHERE signal > 0 UNION ALL SELECT query_id, doc_id, 4 FROM qs JOIN nm ON lower(query) = lower(name)) GROUP BY query_id, doc_id)"""


def vocabulary(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("doc_id")).withColumn("tokens", T.tokens(F.col("name")))


def asked(t: Tables) -> DataFrame:
    """(query_id, query, tokens)."""
    v, id_ = vocabulary(t), F.col("doc_id") * 10
    forms = [v.select(id_.alias("query_id"), F.col("name").alias("query")), v.select((id_ + 1).alias("query_id"), F.element_at(F.split("name", " "), 1).alias("query")), v.select((id_ + 2).alias("query_id"), T.drop_middle(F.col("name")).alias("query"))]
    extra = t.spark.createDataFrame([(7, "unheard thing")], "query_id long, query string")
    return forms[0].union(forms[1]).union(forms[2]).union(extra).withColumn("tokens", T.tokens(F.col("query")))


def signals(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, signal): 4 the surface itself, 3 a shared token, 2 one token holds another (six letters
    or more both), 1 a token within the lesser of both fuzzy limits; the best of each pair.

    Only distinct tokens are compared: equal ones by equi-join, holding ones under the shorter one's first
    six letters, near ones under their deletion neighbourhoods.
    """
    qt = queries.select("query_id", F.explode("tokens").alias("q"))
    dt = docs.select("doc_id", F.explode("tokens").alias("v"))
    q, v = qt.select("q").distinct(), dt.select("v").distinct()
    equal = q.join(v, F.col("q") == F.col("v")).withColumn("signal", F.lit(3))

    def holds(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
        grams = a.where(F.length(x) >= 6).select(x, F.explode(F.array_distinct(T.char_ngrams(F.col(x), 6))).alias("g"))
        return grams.join(b.where(F.length(y) >= 6).select(y, F.substring(y, 1, 6).alias("g")), "g").where(F.contains(x, y)).select("q", "v").distinct()

    inside = holds(q, v, "q", "v").union(holds(v, q, "v", "q")).distinct().withColumn("signal", F.lit(2))

    def without_one(x):
        return F.transform(T.positions(F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    def neighbourhood(a: DataFrame, x: str) -> DataFrame:
        one = a.select(x, F.explode(F.concat(F.array(x), without_one(F.col(x)))).alias("one")).distinct()
        return one.select(x, F.explode(F.concat(F.array("one"), without_one(F.col("one")))).alias("k")).distinct()

    met = neighbourhood(q.where(F.length("q") >= 6), "q").join(neighbourhood(v.where(F.length("v") >= 6), "v"), "k").select("q", "v").distinct()
    near = met.where(F.levenshtein("q", "v") <= F.least(T.fuzzy_limit(F.col("q")), T.fuzzy_limit(F.col("v")))).withColumn("signal", F.lit(1))
    best = equal.union(inside).union(near).groupBy("q", "v").agg(F.max("signal").alias("signal"))
    by_token = qt.join(best, "q").join(dt, "v").select("query_id", "doc_id", "signal")
    exact = queries.select("query_id", T.norm(F.col("query")).alias("s")).join(docs.select("doc_id", T.norm(F.col("name")).alias("s")), "s").select("query_id", "doc_id", F.lit(4).alias("signal"))
    return by_token.union(exact).groupBy("query_id", "doc_id").agg(F.max("signal").alias("signal"))


@query(f"WITH {VOCAB_SQL} SELECT query_id, doc_id, CAST(signal AS INTEGER) AS signal FROM sg")
def surface_signals(t: Tables) -> DataFrame:
    """The best signal between every query and concept."""
    return signals(asked(t), vocabulary(t))


C1_SQL = f"""{VOCAB_SQL}, tf AS (SELECT doc_id, term, count(*) AS tf FROM nt GROUP BY doc_id, term), dl AS (SELECT doc_id, count(*) AS dl FROM nt GROUP BY doc_id), st AS (SELECT (SELECT count(*) FROM nm) AS n, CAST(sum(dl) AS DOUBLE) / (SELECT count(*) FROM nm) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM (SELECT DISTINCT query_id, term FROM qt) q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY query_id, tf.doc_id),
c1 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (SELECT sg.query_id, sg.doc_id, coalesce(score, 0) + CASE signal WHEN 4 THEN 1000000.0 WHEN 3 THEN 10000.0 WHEN 2 THEN 5000.0 ELSE 2500.0 END AS score FROM sg LEFT JOIN bm ON bm.query_id = sg.query_id AND bm.doc_id = sg.doc_id))"""


def short_query_rank(t: Tables, k: int | None = None) -> DataFrame:
    """Queries of three tokens or fewer: documents without a signal go, the others get its boost; longer ones: BM25 and exact surfaces."""
    q, v = asked(t), vocabulary(t)
    bm25 = index.scores(q, index.postings(v))
    short = F.size("tokens") <= 3
    boost = F.coalesce(*(F.when(F.col("signal") == s, b) for s, b in SIGNAL_BOOST.items()))
    signalled = signals(q.where(short), v).join(bm25, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + boost).alias("score"))
    exact = index.exact_hits(q.where(~short).select("query_id", T.norm(F.col("query")).alias("surface")), v.select("doc_id", T.norm(F.col("name")).alias("surface")))
    long_ = index.with_exact(bm25.join(q.where(~short).select("query_id"), "query_id", "left_semi"), exact)
    return index.ranked(signalled.unionByName(long_), k)


@query(f"WITH {C1_SQL} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM c1 WHERE rank <= 5")
def short_query_ranking(t: Tables) -> DataFrame:
    """Five results of every short query by signal and score."""
    return rounded(short_query_rank(t, 5), "score")


@query(f"""WITH {C1_SQL}, dm AS (SELECT p_partkey, count(*) AS demand FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey),
rt AS (SELECT qs.query_id, d.doc_id, row_number() OVER (PARTITION BY qs.query_id ORDER BY coalesce(max(demand), 0) DESC, d.name, d.doc_id) AS rank FROM qs JOIN part ON lower(qs.query) = lower(p_name) JOIN part o ON o.p_brand = part.p_brand JOIN nm d ON d.name = o.p_name LEFT JOIN dm ON dm.p_partkey = d.doc_id WHERE part.p_partkey = (SELECT doc_id FROM nm WHERE nm.name = part.p_name) GROUP BY qs.query_id, d.doc_id, d.name),
u AS (SELECT query_id, doc_id, 0 AS list, 1 AS rank FROM qs JOIN nm ON lower(query) = lower(name) UNION ALL SELECT query_id, doc_id, 1, rank FROM rt UNION ALL SELECT query_id, doc_id, 2, rank FROM c1),
m AS (SELECT query_id, doc_id, min(list * 100000 + rank) AS pos FROM u GROUP BY query_id, doc_id), r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS INTEGER) AS rank, CAST(pos // 100000 AS INTEGER) AS list FROM m) SELECT * FROM r WHERE rank <= 5""")
def routed_ranking(t: Tables) -> DataFrame:
    """The concept of that very name, then what its title routes to (names of its brand, by demand), then the ranking."""
    q, v = asked(t), vocabulary(t)
    exact = q.select("query_id", T.norm(F.col("query")).alias("s")).join(v.select("doc_id", T.norm(F.col("name")).alias("s")), "s").select("query_id", "doc_id")
    demand = t.lineitem.groupBy(F.col("l_partkey").alias("doc_id")).agg(count_rows().alias("demand"))
    brand = t.part.select(F.col("p_partkey").alias("doc_id"), "p_brand")
    members = t.part.select("p_brand", F.col("p_name").alias("name")).distinct().join(v.select("name", "doc_id"), "name")
    routed = exact.join(brand, "doc_id").select("query_id", "p_brand").join(members, "p_brand").join(demand, "doc_id", "left").select("query_id", "doc_id", "name", F.coalesce("demand", F.lit(0)).alias("demand")).distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("demand"), "name", "doc_id")
    lists = [exact.withColumn("rank", F.lit(1)), routed.withColumn("rank", F.row_number().over(w)), short_query_rank(t)]
    return fusion.ordered_union(lists, 5)


@query(f"""WITH {VOCAB_SQL}, d AS (SELECT query_id, doc_id, name, CASE WHEN lower(name) = lower(query) THEN 1.0 WHEN starts_with(lower(name), lower(query)) THEN 0.99 WHEN contains(' ' || lower(name), ' ' || lower(query)) THEN 0.98 WHEN contains(lower(name), lower(query)) THEN 0.95 END AS score FROM qs CROSS JOIN nm),
h AS (SELECT query_id, doc_id, name, score, 'direct' AS stage FROM d WHERE score IS NOT NULL), z AS (SELECT query_id, doc_id, name, round(1.0 - levenshtein(lower(query), lower(name)) * 1.0 / greatest(length(query), length(name)), 6) AS score, 'fuzzy' AS stage FROM qs CROSS JOIN nm WHERE query_id NOT IN (SELECT query_id FROM h) AND levenshtein(lower(query), lower(name)) <= greatest(2, floor(length(query) * 0.25)))
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, stage, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, doc_id) AS INTEGER) AS rank FROM (SELECT * FROM h UNION ALL SELECT * FROM z)""")
def selector_ranking(t: Tables) -> DataFrame:
    """A selector: direct hits by kind; only queries without any fall back to edit distance over distinct names."""
    q, v = asked(t).drop("tokens"), vocabulary(t).drop("tokens")
    kind = T.direct_match(F.col("query"), F.col("name"))
    score = F.when(kind == "exact", 1.0).when(kind == "prefix", 0.99).when(kind == "word_boundary", 0.98).when(kind == "contains", 0.95)
    pairs = q.crossJoin(v)  # a stated query set against a vocabulary of names
    direct = pairs.withColumn("score", score).where("score is not null").select("query_id", "doc_id", "name", "score", F.lit("direct").alias("stage"))
    distance = F.levenshtein(F.lower("query"), F.lower("name"))
    rest = q.join(direct.select("query_id").distinct(), "query_id", "left_anti").crossJoin(v).where(distance <= F.greatest(F.lit(2), F.floor(F.length("query") * 0.25)))
    fuzzy = rest.select("query_id", "doc_id", "name", F.round(1.0 - distance / F.greatest(F.length("query"), F.length("name")), 6).alias("score"), F.lit("fuzzy").alias("stage"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "doc_id")
    return direct.union(fuzzy).withColumn("rank", F.row_number().over(w)).drop("name")


@query(f"""WITH {DOCS_SQL}, ex AS (SELECT source, lower(unnest(regexp_extract_all(lang || ' ' || source, '{ALPHABET}'))) AS term FROM (SELECT DISTINCT source, lang FROM documents)), own AS (SELECT doc_id, source FROM documents),
al AS (SELECT doc_id, term FROM tok UNION ALL SELECT doc_id, term FROM own JOIN ex ON ex.source = own.source) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM al GROUP BY doc_id""")
def expanded_documents(t: Tables) -> DataFrame:
    """Documents with the tokens of their group's labels added (distinct labels once, exact surfaces untouched)."""
    docs = documents(t)
    labels = docs.select("source", "lang").distinct().select("source", F.explode(T.tokens(F.concat_ws(" ", "lang", "source"))).alias("term"))
    own = docs.select("doc_id", F.explode("tokens").alias("term"))
    return own.union(docs.select("doc_id", "source").join(labels, "source").select("doc_id", "term")).groupBy("doc_id").agg(count_rows().alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@query("""WITH m AS (SELECT item_id, lower(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS n FROM benchmark), h AS (SELECT item_id, n FROM m WHERE item_id % 5 = 0), k AS (SELECT n, min(item_id) AS item_id, count(*) AS copies FROM m WHERE item_id NOT IN (SELECT item_id FROM h) AND n NOT IN (SELECT n FROM h) GROUP BY n) SELECT item_id, copies FROM k""")
def expansion_texts(t: Tables) -> DataFrame:
    """Texts fit for expansion: those held out go by id and by normalised text, copies count once."""
    m = t.benchmark.select("item_id", T.lower_norm(F.col("text")).alias("n"))
    held = m.where("item_id % 5 = 0")
    free = m.join(held.select("item_id"), "item_id", "left_anti").join(held.select("n").distinct(), "n", "left_anti")
    return free.groupBy("n").agg(F.min("item_id").alias("item_id"), count_rows().alias("copies")).select("item_id", "copies")


@query(f"""WITH {DOCS_SQL}, b AS (SELECT d.lang, tok.term, count(*) AS f FROM tok JOIN documents d ON d.doc_id = tok.doc_id GROUP BY d.lang, tok.term), i AS (SELECT term, ln(1 + (4 - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM b GROUP BY term)
SELECT lang, term, f, round(idf * (1 + ln(f)), 6) AS score, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(idf * (1 + ln(f)), 6) DESC, term) AS INTEGER) AS rank FROM b JOIN i USING (term) QUALIFY rank <= 20""".replace("(4 - count(*)", "((SELECT count(DISTINCT lang) FROM documents) - count(*)"))
def discriminative_terms(t: Tables) -> DataFrame:
    """The twenty terms that mark each group out: idf over groups times one plus the log of the count."""
    docs = documents(t)
    bag = docs.select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(count_rows().alias("f"))
    groups = docs.agg(F.countDistinct("lang").alias("n"))
    idf = bag.groupBy("term").agg(count_rows().alias("df")).crossJoin(F.broadcast(groups)).select("term", index.idf(F.col("n"), F.col("df")).alias("idf"))  # one row
    scored = bag.join(idf, "term").withColumn("score", F.round(F.col("idf") * (1 + F.log("f")), 6))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("lang", "term", "f", "score", "rank")


@query(f"""WITH {DOCS_SQL}, s AS (SELECT conv_id AS owner, turn, lower(unnest(regexp_extract_all(text, '{ALPHABET}'))) AS term FROM conversations), c AS (SELECT owner, term, count(DISTINCT turn) AS n FROM s GROUP BY owner, term), o AS (SELECT conv_id AS owner, count(DISTINCT turn) AS slots FROM conversations GROUP BY conv_id), i AS (SELECT term, ln(1 + ((SELECT count(*) FROM o) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c GROUP BY term)
SELECT owner, term, round(idf * sqrt(n * 1.0 / slots), 6) AS w FROM c JOIN o USING (owner) JOIN i USING (term)""")
def slot_weights(t: Tables) -> DataFrame:
    """Term weights of owners with several phrases: idf times the root of the share of phrases with the term."""
    s = t.conversations.select(F.col("conv_id").alias("owner"), "turn", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct()
    c = s.groupBy("owner", "term").agg(count_rows().alias("n"))
    slots = t.conversations.groupBy(F.col("conv_id").alias("owner")).agg(F.countDistinct("turn").alias("slots"))
    idf = c.groupBy("term").agg(count_rows().alias("df")).crossJoin(F.broadcast(slots.agg(count_rows().alias("owners")))).select("term", index.idf(F.col("owners"), F.col("df")).alias("idf"))  # one row
    return c.join(slots, "owner").join(idf, "term").select("owner", "term", F.round(F.col("idf") * F.sqrt(F.col("n") / F.col("slots")), 6).alias("w"))


@query("""WITH o AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey), g AS (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2), p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 2)
SELECT c_custkey, o_orderkey, false AS is_global FROM o JOIN g ON k = c_custkey UNION ALL SELECT c_custkey, o_orderkey, true FROM o CROSS JOIN p WHERE n = 0""")
def context_fallback(t: Tables) -> DataFrame:
    """A contextual list of two; where the context is empty, the global one of two rows."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    own = urgent.withColumn("r", F.row_number().over(w)).where("r <= 2").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.lit(False).alias("is_global"))
    top = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2).select("o_orderkey")
    empty = t.customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
    return own.join(t.customer.select("c_custkey"), "c_custkey").union(empty.crossJoin(F.broadcast(top)).withColumn("is_global", F.lit(True)))  # two rows
