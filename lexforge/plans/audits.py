"""Graph routes, surface authority, validation of records, sampling, and the evaluation audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.counts import count_rows
from lexforge.functions import text as T
from lexforge.operators import graph, store
from lexforge.plans.registry import Tables, query
from lexforge.plans.retrieval import ALPHABET



@query("""WITH n AS (SELECT p_partkey AS id, p_type AS kind, p_partkey % 3 = 0 AS active FROM part), e AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 3 = 2 AND p_size > 25),
s AS (SELECT id FROM n WHERE NOT active),
w1 AS (SELECT s.id, a.kind, e.dst AS a1 FROM s JOIN n a ON a.id = s.id LEFT JOIN e ON e.src = s.id),
x1 AS (SELECT w1.*, t.kind AS tk, t.active, CASE WHEN a1 IS NULL THEN 'dead_end' WHEN a1 = w1.id THEN 'cycle' WHEN t.id IS NULL THEN 'missing' WHEN t.active AND t.kind <> w1.kind THEN 'mismatch' WHEN t.active THEN 'target' ELSE 'open' END AS state FROM w1 LEFT JOIN n t ON t.id = a1),
w2 AS (SELECT x1.id, x1.kind, x1.a1, e.dst AS a2 FROM x1 LEFT JOIN e ON e.src = x1.a1 WHERE state = 'open'),
x2 AS (SELECT w2.*, CASE WHEN a2 IS NULL THEN 'dead_end' WHEN a2 IN (w2.id, a1) THEN 'cycle' WHEN t.id IS NULL THEN 'missing' WHEN t.active AND t.kind <> w2.kind THEN 'mismatch' WHEN t.active THEN 'target' ELSE 'open' END AS state FROM w2 LEFT JOIN n t ON t.id = a2),
al AS (SELECT id, state, a1 AS pos, 1 AS depth FROM x1 WHERE state <> 'open' UNION ALL SELECT id, state, a2, 2 FROM x2),
g AS (SELECT id, bool_or(state = 'mismatch') AS m, bool_or(state IN ('cycle', 'missing')) AS c, count(DISTINCT CASE WHEN state = 'target' THEN pos END) AS k, string_agg(DISTINCT CASE WHEN state = 'target' THEN pos::VARCHAR END, ',') AS t, min(depth) FILTER (state = 'target') AS depth FROM al GROUP BY id)
SELECT id, CASE WHEN m THEN 'TYPE_MISMATCH' WHEN c THEN 'CYCLE_OR_INVALID' WHEN k = 0 THEN 'NO_ACTIVE' WHEN k > 1 THEN 'MULTIPLE' ELSE 'UNIQUE' END AS status, k AS n_targets, CAST(depth AS INTEGER) AS depth FROM g""")
def replacement_routes(t: Tables) -> DataFrame:
    """Where retired concepts lead: unique, multiple or no active target, another kind, cycles."""
    p = F.col("p_partkey")
    nodes = t.part.select(p.alias("id"), F.col("p_type").alias("kind"), (p % 3 == 0).alias("active"))
    forward, back, more = t.part.where(p % 3 == 1), t.part.where(p % 3 == 2), t.part.where((p % 3 == 2) & (F.col("p_size") > 25))
    edges = forward.select(p.alias("src"), (p + 1).alias("dst")).union(back.select(p, p - 1)).union(more.select(p, p + 1))
    shared_checkpoints(t)
    routes = graph.replacement_routes(nodes, edges, nodes.where("not active").select("id"))
    return routes.select("id", "status", F.size("targets").cast("long").alias("n_targets"), "depth")


def shared_checkpoints(t: Tables) -> None:
    """Checkpoints go to spark.checkpoint.dir."""
    sc = t.spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(store.shared_dir(t.spark))


@query("""WITH s AS (SELECT DISTINCT lower(p_name) AS surface, p_brand AS id, p_type = 'PROMO' AS canonical FROM part), a AS (SELECT surface, bool_or(canonical) AS has FROM s GROUP BY surface), k AS (SELECT s.* FROM s JOIN a USING (surface) WHERE canonical OR NOT has), o AS (SELECT surface, count(DISTINCT id) AS n, min(id) AS id, bool_or(canonical) AS c FROM k GROUP BY surface)
SELECT surface, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n <> 1 THEN 'ambiguous' WHEN c THEN 'canonical' ELSE 'fallback' END AS status FROM o""")
def surface_authority(t: Tables) -> DataFrame:
    """Who owns a surface: canonical owners first, ambiguity closed."""
    return graph.authority(t.part.select(T.norm(F.col("p_name")).alias("surface"), F.col("p_brand").alias("id"), (F.col("p_type") == "PROMO").alias("canonical")))


@query("""SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS parents FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def multi_parents(t: Tables) -> DataFrame:
    """Concepts under several parents."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_suppkey").alias("parents")).where("parents > 1")


@query("""SELECT lower(p_name) AS label, count(DISTINCT p_brand || '/' || p_type) AS identities FROM part GROUP BY lower(p_name) HAVING count(DISTINCT p_brand || '/' || p_type) > 1""")
def ambiguous_labels(t: Tables) -> DataFrame:
    """Labels of several contextual identities (brand and type together, never collapsed)."""
    return t.part.groupBy(T.norm(F.col("p_name")).alias("label")).agg(F.countDistinct(F.struct("p_brand", "p_type")).alias("identities")).where("identities > 1")


def errors(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error): every rule that a row breaks; all rules are tried."""
    found = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return df.select(key, F.explode(found).alias("error"))


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS k, unnest([CASE WHEN l_quantity <= 0 THEN 'quantity' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'status' END]) AS error FROM lineitem) SELECT k, error FROM e WHERE error IS NOT NULL""")
def record_errors(t: Tables) -> DataFrame:
    """A record contract: all broken rules of every row, none hides another."""
    rules = {"quantity": F.col("l_quantity") <= 0, "discount": F.col("l_discount") > 0.09, "tax": F.col("l_tax") > 0.07, "status": (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")}
    return errors(t.lineitem.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k", rules)


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS dangling_orders, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated_documents, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown_labels, (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) AS bad_labels""")
def integrity(t: Tables) -> DataFrame:
    """References, keys and values over whole tables, each an anti-join or an aggregation."""
    dangling = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(count_rows().alias("dangling_orders"))
    repeated = t.documents.groupBy("doc_id").agg(count_rows().alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_documents"))
    unknown = t.labels.join(t.documents, "doc_id", "left_anti").agg(count_rows().alias("unknown_labels"))
    bad = t.labels.agg(F.count_if(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).alias("bad_labels"))
    return dangling.crossJoin(repeated).crossJoin(unknown).crossJoin(bad)  # one row each


@query("""SELECT doc_id, source, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS priority, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END, sha256('pick:' || doc_id)) AS INTEGER) AS place FROM documents JOIN labels USING (doc_id) QUALIFY place <= 3""")
def priority_sample(t: Tables) -> DataFrame:
    """Three of every source: by priority, then by a stable hash."""
    priority = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "source", priority.alias("priority"))
    w = Window.partitionBy("source").orderBy("priority", T.stable_hash("pick", F.col("doc_id")))
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS round FROM part) SELECT p_brand, p_partkey, CAST(round AS INTEGER) AS round, CAST(row_number() OVER (ORDER BY round, p_brand) AS INTEGER) AS place FROM r WHERE round <= 2""")
def round_robin(t: Tables) -> DataFrame:
    """Round r takes the r-th best of every brand in turn; brands are few."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    r = t.part.select("p_brand", "p_partkey", F.row_number().over(w).alias("round")).where("round <= 2")
    return r.withColumn("place", F.row_number().over(Window.orderBy("round", "p_brand")))  # two rows a brand


@query("""SELECT DISTINCT p_brand, arg_min(p_partkey, CAST(p_size AS BIGINT) * 100000000 + p_partkey) OVER (PARTITION BY p_brand) AS chosen FROM part WHERE p_size >= 5""")
def one_per_target(t: Tables) -> DataFrame:
    """The best row of every target by a tuple."""
    return t.part.where("p_size >= 5").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("chosen"))


@query("""WITH a AS (SELECT p_name, count(DISTINCT p_brand) AS owners FROM part GROUP BY p_name), r AS (SELECT p.p_type, a.owners = 1 AS strict, count(*) AS n, sum(p_size) AS weight FROM part p JOIN a USING (p_name) GROUP BY p.p_type, a.owners = 1)
SELECT p_type, coalesce(sum(n) FILTER (strict), 0)::BIGINT AS strict, coalesce(sum(n) FILTER (NOT strict), 0)::BIGINT AS colliding, coalesce(sum(weight), 0)::BIGINT AS weight FROM r GROUP BY p_type""")
def alias_rescue(t: Tables) -> DataFrame:
    """Aliases with one owner and with several, by provenance, and weighted."""
    owners = t.part.groupBy("p_name").agg(F.countDistinct("p_brand").alias("owners"))
    strict = F.col("owners") == 1
    return t.part.join(owners, "p_name").groupBy("p_type").agg(F.count_if(strict).alias("strict"), F.count_if(~strict).alias("colliding"), F.sum("p_size").alias("weight"))


@query("""SELECT item_id, len(x) AS words_20, len(y) AS words_40, array_to_string(x, ' ') AS capped FROM (SELECT item_id, (string_split(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')), ' '))[1:20] AS x, (string_split(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')), ' '))[1:40] AS y FROM benchmark)""")
def capped_queries(t: Tables) -> DataFrame:
    """Queries capped at 20 and 40 words, to see how a frozen rule depends on length."""
    a, b = T.clip_words(F.col("text"), 20), T.clip_words(F.col("text"), 40)
    return t.benchmark.select("item_id", F.size(F.split(a, " ")).cast("long").alias("words_20"), F.size(F.split(b, " ")).cast("long").alias("words_40"), a.alias("capped"))


@query("""WITH q AS (SELECT props, count(*) AS n FROM events GROUP BY props), k AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, n, props FROM q) SELECT props, n FROM k WHERE k NOT IN (SELECT n_nationkey FROM nation) AND k NOT IN (SELECT p_size FROM part WHERE p_brand = 'Brand#1') ORDER BY n DESC, props LIMIT 15""")
def unbound_queries(t: Tables) -> DataFrame:
    """The most frequent queries that neither of two vocabularies knows."""
    q = t.events.groupBy("props").agg(count_rows().alias("n")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    sizes = t.part.where("p_brand = 'Brand#1'").select(F.col("p_size").cast("long").alias("k"))
    rest = q.join(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k", "left_anti").join(sizes, "k", "left_anti")
    return rest.select("props", "n").orderBy(F.desc("n"), "props").limit(15)


@query("""WITH v AS (SELECT DISTINCT p_name AS s FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS s FROM part UNION SELECT 'big red widget' UNION SELECT 'red widget')
SELECT w.s AS query, v.s AS surface, CASE WHEN w.s = v.s THEN 'exact' WHEN contains(' ' || w.s || ' ', ' ' || v.s || ' ') THEN 'query_holds_surface' ELSE 'surface_holds_query' END AS relation FROM w JOIN v ON contains(' ' || w.s || ' ', ' ' || v.s || ' ') OR contains(' ' || v.s || ' ', ' ' || w.s || ' ')""")
def surface_relations(t: Tables) -> DataFrame:
    """Equal, query holds surface, or surface holds query; both sides meet on a shared token first."""
    v = t.part.select(F.col("p_name").alias("surface")).distinct()
    w = v.select(F.explode(F.split("surface", " ")).alias("query")).union(t.spark.createDataFrame([("big red widget",), ("red widget",)], "query string")).distinct()
    tok = lambda df, c: df.select(c, F.explode(T.tokens(F.col(c))).alias("t"))
    pairs = tok(w, "query").join(tok(v, "surface"), "t").select("query", "surface").distinct()
    a, b = (F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("query", "surface"))
    rel = F.when(F.col("query") == F.col("surface"), "exact").when(F.contains(a, b), "query_holds_surface").when(F.contains(b, a), "surface_holds_query")
    return pairs.withColumn("relation", rel).where("relation is not null")


@query("""WITH l AS (SELECT l_partkey AS k, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS combination, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS first FROM lineitem GROUP BY l_partkey) SELECT combination, count(*) AS concepts, count(*) FILTER (first = 0) AS covered_by_first, count(*) FILTER (first = 1) AS added_by_second, count(*) FILTER (first = 2) AS added_by_third FROM l GROUP BY combination""")
def lane_combinations(t: Tables) -> DataFrame:
    """Which lanes cover a concept together, and what each adds in order."""
    place = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    per = t.lineitem.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("combination"), F.min(place).alias("first"))
    return per.groupBy("combination").agg(count_rows().alias("concepts"), *(F.count_if(F.col("first") == i).alias(n) for i, n in enumerate(("covered_by_first", "added_by_second", "added_by_third"))))


@query("""WITH r AS (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality), s AS (SELECT lang, sum(n) AS n, coalesce(sum(n) FILTER (quality = 1), 0) AS k FROM r GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS rate, round(100.0 * (k / n - (SELECT sum(k) / sum(n) FROM s)), 6) AS points FROM s""")
def rate_deltas(t: Tables) -> DataFrame:
    """Rates by stratum and their distance from the total in points."""
    s = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(count_rows().alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    total = s.agg((F.sum("k") / F.sum("n")).alias("all"))
    return s.crossJoin(F.broadcast(total)).select("lang", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(100.0 * (F.col("k") / F.col("n") - F.col("all")), 6).alias("points"))  # one row


@query("""WITH i AS (SELECT o_custkey AS q, o_orderpriority AS c FROM orders GROUP BY o_custkey, o_orderpriority), v AS (SELECT DISTINCT o_custkey AS q, o_orderpriority AS c FROM orders WHERE o_totalprice > 250000) SELECT i.q, count(*) AS intended, count(v.q) AS visible, round(count(v.q) / count(*), 6) AS recall FROM i LEFT JOIN v ON v.q = i.q AND v.c = i.c GROUP BY i.q""")
def context_recall(t: Tables) -> DataFrame:
    """The share of intended contexts that a result shows."""
    i = t.orders.select(F.col("o_custkey").alias("q"), F.col("o_orderpriority").alias("c")).distinct()
    v = t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("q"), F.col("o_orderpriority").alias("c"), F.lit(1).alias("v")).distinct()
    j = i.join(v, ["q", "c"], "left").groupBy("q").agg(count_rows().alias("intended"), F.count("v").alias("visible"))
    return j.withColumn("recall", F.round(F.col("visible") / F.col("intended"), 6))


@query(f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{ALPHABET}')) AS w FROM documents), s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(source || ' ' || lang || ' the la die'), '{ALPHABET}')) AS s FROM documents)
SELECT doc_id, len(list_intersect(w, s)) AS shared, len(w) AS unique_tokens FROM d JOIN s USING (doc_id)""")
def token_overlap(t: Tables) -> DataFrame:
    """Shared and distinct tokens of two texts of a row."""
    w = F.array_distinct(T.tokens(F.lower("text")))
    s = F.array_distinct(T.tokens(F.concat_ws(" ", "source", "lang", F.lit("the la die"))))
    return t.documents.select("doc_id", F.size(F.array_intersect(w, s)).cast("long").alias("shared"), F.size(w).cast("long").alias("unique_tokens"))


@query("""SELECT kind, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN value > 50 THEN 'KNOWN_TRUE' ELSE 'KNOWN_FALSE' END AS kind, value FROM events) GROUP BY kind""")
def tri_state(t: Tables) -> DataFrame:
    """Known true, known false and unknown, which is never false."""
    kind = F.when(F.col("value").isNull(), "UNKNOWN").when(F.col("value") > 50, "KNOWN_TRUE").otherwise("KNOWN_FALSE")
    return t.events.groupBy(kind.alias("kind")).agg(count_rows().alias("n"), F.round(F.avg("value"), 6).alias("mean"))
