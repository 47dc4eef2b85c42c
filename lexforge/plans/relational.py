"""Projections, filters, joins, aggregations, windows, top-k and set operations over the typed tables.

Roles: part, supplier and customer are typed concepts; lineitem holds the edges part-supplier and
order-part; region > nation > supplier/customer is the hierarchy; lineitem also holds demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.counts import count_rows
from lexforge.functions import text as T
from lexforge.plans.registry import Tables, query



def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; `empty` where b is zero (the two contracts: None or 0.0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


@query("""SELECT p_partkey, lower(p_name) || CASE WHEN lower(p_type) <> lower(p_name) THEN ' ' || lower(p_type) ELSE '' END AS text_a,
lower(concat_ws(' ', p_name, p_type, p_brand)) AS text_c, p_type = 'PROMO' AS is_promo FROM part WHERE p_size > 10""")
def concept_texts(t: Tables) -> DataFrame:
    """Concept text under two configurations of columns, of one type of concept."""
    name, kind = F.col("p_name"), F.col("p_type")
    a = F.concat_ws(" ", T.lower_norm(name), F.when(T.real_definition(kind, name), T.lower_norm(kind)))
    return t.part.where("p_size > 10").select("p_partkey", a.alias("text_a"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("text_c"), (kind == "PROMO").alias("is_promo"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' END AS reason FROM lineitem) GROUP BY reason""")
def reject_reasons(t: Tables) -> DataFrame:
    """A chain of filters: the first rule that fails names the reason; null is accepted."""
    reason = F.when(F.col("l_quantity") < 5, "small").when(F.col("l_discount") > 0.08, "discounted").when(F.col("l_returnflag") == "R", "returned")
    return t.lineitem.select(reason.alias("reason")).groupBy("reason").agg(count_rows().alias("n"))


@query("""WITH s AS (SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey),
p AS (SELECT p_partkey, p_size, coalesce(lines, 0) AS lines, coalesce(suppliers, 0) AS suppliers, coalesce(quantity, 0) AS quantity FROM part LEFT JOIN s ON l_partkey = p_partkey)
SELECT p_partkey, lines, concat_ws('+', CASE WHEN lines < 25 THEN 'few_lines' END, CASE WHEN suppliers < 20 THEN 'few_suppliers' END, CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN quantity = 0 THEN 'no_demand' END) AS gaps,
CASE WHEN lines >= 40 THEN 'admitted' WHEN suppliers > 20 THEN 'excluded_many' WHEN p_size > 25 THEN 'excluded_redundant' ELSE 'unbound' END AS bucket FROM p""")
def gap_tags(t: Tables) -> DataFrame:
    """Support of every concept, gap tags from rules, and a bucket by priority."""
    s = t.lineitem.groupBy("l_partkey").agg(count_rows().alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity"))
    p = t.part.join(s, F.col("l_partkey") == F.col("p_partkey"), "left").na.fill(0, ["lines", "suppliers", "quantity"])
    rules = {"few_lines": F.col("lines") < 25, "few_suppliers": F.col("suppliers") < 20, "large": F.col("p_size") > 40, "no_demand": F.col("quantity") == 0}
    gaps = F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items()))), "+")
    bucket = F.when(F.col("lines") >= 40, "admitted").when(F.col("suppliers") > 20, "excluded_many").when(F.col("p_size") > 25, "excluded_redundant").otherwise("unbound")
    return p.select("p_partkey", "lines", gaps.alias("gaps"), bucket.alias("bucket"))


@query("""WITH e AS (SELECT 'part' AS src_type, l_partkey AS src, 'supplied_by' AS rel, l_suppkey AS dst FROM lineitem UNION ALL SELECT 'part', l_partkey, 'ordered_in', l_orderkey FROM lineitem WHERE l_quantity > 45),
j AS (SELECT e.src_type, e.rel, e.src, CASE WHEN rel = 'supplied_by' AND s_suppkey IS NOT NULL THEN 'supplier' WHEN rel = 'ordered_in' AND o_orderkey % 7 <> 0 THEN 'order' ELSE '__unresolved__' END AS dst_type FROM e LEFT JOIN supplier ON rel = 'supplied_by' AND dst = s_suppkey AND s_acctbal > 0 LEFT JOIN orders ON rel = 'ordered_in' AND dst = o_orderkey)
SELECT src_type, rel, dst_type, count(*) AS edges, count(DISTINCT src) AS concepts FROM j GROUP BY GROUPING SETS ((src_type, rel, dst_type), (src_type, rel))""")
def edge_matrix(t: Tables) -> DataFrame:
    """Typed edges counted by source type, relation and target type, with a row over all targets; targets
    that no concept table knows are unresolved."""
    l = t.lineitem
    e = l.select(F.col("l_partkey").alias("src"), F.lit("supplied_by").alias("rel"), F.col("l_suppkey").alias("dst")).unionByName(
        l.where("l_quantity > 45").select(F.col("l_partkey").alias("src"), F.lit("ordered_in").alias("rel"), F.col("l_orderkey").alias("dst"))
    )
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"), F.lit("supplied_by").alias("rel"), F.lit("supplier").alias("dst_type")).unionByName(
        t.orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("dst"), F.lit("ordered_in").alias("rel"), F.lit("order").alias("dst_type"))
    )
    typed = e.join(known, ["rel", "dst"], "left").select(F.lit("part").alias("src_type"), "rel", "src", F.coalesce("dst_type", F.lit("__unresolved__")).alias("dst_type"))
    sets = [[F.col("src_type"), F.col("rel"), F.col("dst_type")], [F.col("src_type"), F.col("rel")]]
    return typed.groupingSets(sets, "src_type", "rel", "dst_type").agg(count_rows().alias("edges"), F.countDistinct("src").alias("concepts"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def left_with_zero(t: Tables) -> DataFrame:
    """Left outer join whose missing side counts as zero."""
    o = t.orders.groupBy("o_custkey").agg(count_rows().alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").na.fill(0, ["n_orders", "total"]).select("c_custkey", "n_orders", "total")


@query("""SELECT 'ordering' AS kind, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'idle', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_and_anti(t: Tables) -> DataFrame:
    """Known and unknown ids."""
    on = F.col("o_custkey") == F.col("c_custkey")
    c = [t.customer.join(t.orders, on, how).select(F.lit(kind).alias("kind"), "c_custkey") for kind, how in (("ordering", "left_semi"), ("idle", "left_anti"))]
    return c[0].unionByName(c[1])


@query("""SELECT r_name, n_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name""")
def hierarchy(t: Tables) -> DataFrame:
    """Ancestors by fixed-depth joins, with the concepts below each."""
    s = t.supplier.groupBy("s_nationkey").agg(count_rows().alias("suppliers"))
    c = t.customer.groupBy("c_nationkey").agg(count_rows().alias("customers"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return n.na.fill(0, ["suppliers", "customers"]).select("r_name", "n_name", "suppliers", "customers")


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
a(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON a.ancestor = e.child) SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM a""")
def ancestors(t: Tables) -> DataFrame:
    """Ancestors at any depth, by a recursive common table expression."""
    t.nation.selectExpr("concat('n', n_nationkey) AS child", "concat('r', n_regionkey) AS parent").unionByName(
        t.supplier.selectExpr("concat('s', s_suppkey) AS child", "concat('n', s_nationkey) AS parent")
    ).createOrReplaceTempView("lexforge_edges")
    return t.spark.sql("""WITH RECURSIVE a(node, ancestor, depth) AS (
        SELECT child, parent, 1 FROM lexforge_edges UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN lexforge_edges e ON a.ancestor = e.child) SELECT node, ancestor, depth FROM a""")


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS w FROM part) SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w) AS distance FROM t a JOIN t b ON a.w < b.w WHERE abs(length(a.w) - length(b.w)) <= 2 AND levenshtein(a.w, b.w) <= 2""")
def fuzzy_join(t: Tables) -> DataFrame:
    """Bounded edit distance join of distinct words: words meet under a shared deletion neighbour (up to two
    letters left out), and what meets is verified; no pair is compared that can't be near."""
    w = t.part.select(F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).distinct()

    def without_one(x: Column) -> Column:
        return F.transform(T.positions(F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    one = w.select("w", F.explode(F.concat(F.array("w"), without_one(F.col("w")))).alias("one")).distinct()
    keys = one.select("w", F.explode(F.concat(F.array("one"), without_one(F.col("one")))).alias("key")).distinct()
    pairs = keys.withColumnRenamed("w", "a").join(keys.withColumnRenamed("w", "b"), "key").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", 2).cast("long")).where("distance between 0 and 2")


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS w FROM part UNION SELECT 'widgets' UNION SELECT 'smallest' UNION SELECT 'standardised') SELECT a.w AS holder, b.w AS held FROM t a JOIN t b ON a.w <> b.w AND length(b.w) >= 5 AND contains(a.w, b.w)""")
def containment_join(t: Tables) -> DataFrame:
    """Words that hold other words of five letters or more: both meet under the shorter one's first five letters."""
    w = t.part.select(F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).union(t.spark.createDataFrame([("widgets",), ("smallest",), ("standardised",)], "w string")).distinct()
    grams = w.select(F.col("w").alias("holder"), F.explode(F.array_distinct(T.char_ngrams(F.col("w"), 5))).alias("gram"))
    starts = w.where("length(w) >= 5").select(F.col("w").alias("held"), F.substring("w", 1, 5).alias("gram"))
    return grams.join(starts, "gram").where("holder <> held and contains(holder, held)").select("holder", "held").distinct()


@query("""WITH o AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS have FROM lineitem GROUP BY l_orderkey), r AS (SELECT * FROM (VALUES (1, ['AF', 'NO']), (2, ['RF']), (3, ['AF', 'RF'])) v(rule, need))
SELECT o, rule, len(have) - len(need) AS extra FROM o JOIN r ON list_has_all(have, need)""")
def superset_join(t: Tables) -> DataFrame:
    """Sets that hold all of a rule's elements: explode, equi-join, count."""
    have = t.lineitem.select(F.col("l_orderkey").alias("o"), F.concat("l_returnflag", "l_linestatus").alias("x")).distinct()
    size = have.groupBy("o").agg(count_rows().alias("have"))
    rules = t.spark.createDataFrame([(1, ["AF", "NO"]), (2, ["RF"]), (3, ["AF", "RF"])], "rule int, need array<string>")
    need = rules.select("rule", F.size("need").alias("n_need"), F.explode("need").alias("x"))
    hits = have.join(F.broadcast(need), "x").groupBy("o", "rule", "n_need").agg(count_rows().alias("n")).where("n = n_need")  # three rules
    return hits.join(size, "o").select("o", "rule", (F.col("have") - F.col("n_need")).alias("extra"))


@query("""WITH a AS (SELECT p_brand AS k, avg(p_retailprice) AS x FROM part GROUP BY p_brand), b AS (SELECT p_brand AS k, max(p_size) AS y FROM part WHERE p_size > 20 GROUP BY p_brand) SELECT coalesce(a.k, b.k) AS k, round(x, 4) AS x, y, a.k IS NOT NULL AND b.k IS NOT NULL AS in_both FROM a FULL JOIN b ON a.k = b.k""")
def paired_join(t: Tables) -> DataFrame:
    """Two results by the same key; keys of one side only show."""
    a = t.part.groupBy(F.col("p_brand").alias("k")).agg(F.avg("p_retailprice").alias("x"), F.lit(True).alias("ina"))
    b = t.part.where("p_size > 20").groupBy(F.col("p_brand").alias("k")).agg(F.max("p_size").alias("y"), F.lit(True).alias("inb"))
    both = F.coalesce("ina", F.lit(False)) & F.coalesce("inb", F.lit(False))
    return a.join(b, "k", "full").select("k", F.round("x", 4).alias("x"), "y", both.alias("in_both"))


@query("""WITH e AS (SELECT DISTINCT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem) SELECT e.a, e.b, r.a IS NOT NULL AS mutual FROM e LEFT JOIN e r ON e.a = r.b AND e.b = r.a""")
def reciprocity(t: Tables) -> DataFrame:
    """Whether the reverse edge exists."""
    e = t.lineitem.select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b")).distinct()
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("m"))
    return e.join(back, ["a", "b"], "left").select("a", "b", F.coalesce("m", F.lit(False)).alias("mutual"))


@query("""SELECT event_id, user_id, CAST(x AS BIGINT) AS custkey FROM (SELECT event_id, user_id, unnest(regexp_extract_all(props, '[0-9]+')) AS x FROM events) WHERE CAST(x AS BIGINT) IN (SELECT c_custkey FROM customer)""")
def ids_in_text(t: Tables) -> DataFrame:
    """Ids that a text names, if they are known."""
    ids = t.events.select("event_id", "user_id", F.explode(F.regexp_extract_all("props", F.lit("[0-9]+"), F.lit(0)).cast("array<long>")).alias("custkey"))
    return ids.join(t.customer, F.col("custkey") == F.col("c_custkey"), "left_semi")


@query("""SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_old, b.k IS NOT NULL AS in_new FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1998) b ON a.k = b.k""")
def versions(t: Tables) -> DataFrame:
    """Existence in two versions of a set; the year bounds are half-open time ranges."""

    def year(y: int, name: str) -> DataFrame:
        return t.orders.where((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))).select(F.col("o_custkey").alias("k"), F.lit(True).alias(name)).distinct()

    both = year(1997, "in_old").join(year(1998, "in_new"), "k", "full")
    return both.select("k", F.coalesce("in_old", F.lit(False)).alias("in_old"), F.coalesce("in_new", F.lit(False)).alias("in_new"))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS low, median(l_quantity) AS mid, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS high, quantile_disc(l_quantity, 0.9) AS p90, count(*) FILTER (l_discount > 0.05) AS discounted,
round(sum(l_extendedprice * CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / sum(l_extendedprice), 6) AS weighted FROM lineitem GROUP BY l_returnflag""")
def number_statistics(t: Tables) -> DataFrame:
    """Counts, distinct counts, minimum, median, mean, maximum, nearest-rank 90 %, conditional counts and weighted ratio."""
    hit = F.col("l_discount") > 0.05
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(
        count_rows().alias("n"), F.countDistinct("l_partkey").alias("parts"), F.min(q).alias("low"), F.median(q).alias("mid"), F.round(F.avg(q), 6).alias("mean"), F.max(q).alias("high"),
        F.expr("percentile_disc(0.9) within group (order by l_quantity)").alias("p90"), F.count_if(hit).alias("discounted"),
        F.round(F.sum(F.when(hit, F.col("l_extendedprice")).otherwise(0.0)) / F.sum("l_extendedprice"), 6).alias("weighted"),
    )


@query("""WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(l_quantity) FILTER (i = CAST(floor((n - 1) * 0.95) AS BIGINT)) AS p95 FROM r GROUP BY l_returnflag""")
def floor_percentile(t: Tables) -> DataFrame:
    """The value at place floor((n - 1) p): from counts by value, not from sorted rows."""
    counts = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(count_rows().alias("n"))
    by = Window.partitionBy("l_returnflag")
    upto = F.sum("n").over(by.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor((F.sum("n").over(by) - 1) * 0.95)
    return counts.withColumn("upto", upto).withColumn("place", place).where("upto > place").groupBy("l_returnflag").agg(F.min("l_quantity").alias("p95"))


@query("""SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n""")
def count_distribution(t: Tables) -> DataFrame:
    """Histogram of group sizes."""
    return t.orders.groupBy("o_custkey").agg(count_rows().alias("n")).groupBy("n").agg(count_rows().alias("customers"))


@query("""SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_retailprice DESC, p_partkey) AS parts, arg_max(p_partkey, p_partkey + p_size * 1000000) AS largest, arg_min(p_name, length(p_name) * 1000000 + p_partkey) AS shortest FROM part GROUP BY p_brand""")
def group_sets(t: Tables) -> DataFrame:
    """Groups as sets and ordered lists, and the best row of each by a tuple."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("x"), "p_partkey")))
    return t.part.groupBy("p_brand").agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.array_join(F.transform(ordered, lambda s: s["p_partkey"].cast("string")), ",").alias("parts"),
        F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("largest"), F.min_by("p_name", F.struct(F.length("p_name"), "p_partkey")).alias("shortest"),
    )


@query("""SELECT (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)) AS repeated_names, (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY p_partkey HAVING count(*) > 1)) AS repeated_keys,
(SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2)) AS ambiguous_names""")
def uniqueness(t: Tables) -> DataFrame:
    """Repeated keys, repeated and ambiguous surfaces."""
    names = t.part.groupBy("p_name").agg(count_rows().alias("n"), F.countDistinct("p_brand").alias("brands"))
    keys = t.part.groupBy("p_partkey").agg(count_rows().alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return names.agg(F.count_if(F.col("n") > 1).alias("repeated_names"), F.count_if(F.col("brands") >= 2).alias("ambiguous_names")).crossJoin(keys)  # one row each


@query("""SELECT lower(p_name) AS surface, count(*) AS n, min(CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END) AS origin, arg_min(p_name, length(p_name) * 1000000 + p_partkey) AS exemplar FROM part GROUP BY lower(p_name)""")
def surface_groups(t: Tables) -> DataFrame:
    """Spellings of one surface: the best origin and the shortest exemplar."""
    origin = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    return t.part.groupBy(T.norm(F.col("p_name")).alias("surface")).agg(count_rows().alias("n"), F.min(origin).alias("origin"), F.min_by("p_name", F.struct(F.length("p_name"), "p_partkey")).alias("exemplar"))


@query("""SELECT stratum, count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS rate FROM (SELECT l_discount, unnest(['all', 'flag_' || l_returnflag, 'status_' || l_linestatus]) AS stratum FROM lineitem) GROUP BY stratum""")
def strata_rollup(t: Tables) -> DataFrame:
    """Rates by stratum, a row counting in each of its strata, with the total."""
    strata = F.explode(F.array(F.lit("all"), F.concat(F.lit("flag_"), "l_returnflag"), F.concat(F.lit("status_"), "l_linestatus")))
    hit = F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)
    return t.lineitem.select(strata.alias("stratum"), hit.alias("hit")).groupBy("stratum").agg(count_rows().alias("n"), F.round(F.avg("hit"), 6).alias("rate"))


DEMAND_SQL = "d AS (SELECT l_partkey AS part, CAST(sum(l_quantity) AS BIGINT) AS demand FROM lineitem GROUP BY l_partkey)"


def demand(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").cast("long").alias("demand"))


@query(f"""WITH {DEMAND_SQL}, r AS (SELECT part, demand, row_number() OVER (ORDER BY demand DESC, part) AS rank, sum(demand) OVER (ORDER BY demand DESC, part ROWS UNBOUNDED PRECEDING) AS upto, sum(demand) OVER () AS total FROM d)
SELECT CAST(x AS DOUBLE) AS threshold, min(rank) AS set_size FROM r CROSS JOIN (VALUES (0.5), (0.8), (0.9), (0.95), (0.99)) v(x) WHERE upto >= x * total GROUP BY x""")
def pareto_thresholds(t: Tables) -> DataFrame:
    """How many of the most demanded concepts make up 50, 80, 90, 95 and 99 % of demand.

    Concepts with one demand are summed up first, so the running sum goes over distinct demands, not rows:
    within a level, ranks and sums grow evenly.
    """
    levels = demand(t).groupBy("demand").agg(count_rows().alias("n"))
    order = Window.orderBy(F.desc("demand"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("demand") * F.col("n")
    run = levels.select("demand", "n", F.coalesce(F.sum(mass).over(before), F.lit(0)).alias("upto"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"), F.sum(mass).over(Window.partitionBy()).alias("total"))
    cut = run.select("*", F.explode(F.array(*(F.lit(x).cast("decimal(3,2)") for x in ("0.5", "0.8", "0.9", "0.95", "0.99")))).alias("threshold"))
    inside = F.greatest(F.ceil((F.col("threshold") * F.col("total") - F.col("upto")) / F.col("demand")), F.lit(1))
    hit = cut.withColumn("need", inside).where("need <= n").groupBy("threshold").agg(F.min(F.col("rank") + F.col("need")).cast("long").alias("set_size"))
    return hit.withColumn("threshold", F.col("threshold").cast("double"))


@query(f"""WITH {DEMAND_SQL}, b AS (SELECT p_brand, part, demand, row_number() OVER (PARTITION BY p_brand ORDER BY demand DESC, part) AS rank, demand * 1.0 / max(demand) OVER (PARTITION BY p_brand) AS ratio FROM d JOIN part ON part = p_partkey)
SELECT p_brand, part, CAST(rank AS INTEGER) AS rank, round(ratio, 6) AS ratio, CAST((rank - 1) // 2 AS BIGINT) AS bucket FROM b WHERE rank <= 5""")
def top_per_group(t: Tables) -> DataFrame:
    """The five most demanded of each group, their share of the first, and a bucket by place."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("demand"), "part")
    j = demand(t).join(t.part, F.col("part") == F.col("p_partkey"))
    out = j.withColumn("ratio", F.round(F.col("demand") / F.max("demand").over(Window.partitionBy("p_brand")), 6)).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return out.select("p_brand", "part", "rank", "ratio", F.floor((F.col("rank") - 1) / 2).alias("bucket"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, o_orderkey, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 3""")
def first_accepted(t: Tables) -> DataFrame:
    """The first three accepted rows of each group in id order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.where("o_totalprice > 100000").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("nth")).where("nth <= 3")


@query("""WITH c AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS path FROM c GROUP BY user_id""")
def first_occurrences(t: Tables) -> DataFrame:
    """Repeats after the first occurrence go, order stays."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda s: s["event_type"])
    return first.groupBy("user_id").agg(F.array_join(path, ">").alias("path"))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey FROM p WHERE i IN (SELECT CAST(floor(k * (n - 1) / 9.0 + 0.5) AS BIGINT) FROM range(10) r(k), (SELECT max(n) AS n FROM p))""")
def even_sample(t: Tables) -> DataFrame:
    """Ten rows evenly over the sorted population: the ranks come from counts by range partition."""
    p = t.part.select("p_partkey")
    n = p.count()
    wanted = sorted({int(k * (n - 1) / 9.0 + 0.5) for k in range(10)}) if n else []
    parts = p.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("p_partkey", F.spark_partition_id().alias("part"))
    place = parts.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("p_partkey")) - 1)
    sizes = parts.groupBy("part").agg(count_rows().alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row per partition
    return place.join(starts, "part").where((F.col("start") + F.col("i")).isin(wanted)).select("p_partkey")


@query("""SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY sha256('order:' || p_partkey)) AS INTEGER) AS place FROM part ORDER BY sha256('order:' || p_partkey) LIMIT 20""")
def hash_order(t: Tables) -> DataFrame:
    """The first twenty in a stable pseudo-random order."""
    top = t.part.select("p_partkey", "p_name", T.stable_hash("order", F.col("p_partkey")).alias("h")).orderBy("h").limit(20)
    return top.select("p_partkey", "p_name", F.row_number().over(Window.orderBy("h")).alias("place"))  # twenty rows


@query("""SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY day ORDER BY n DESC, day LIMIT 10""")
def most_common(t: Tables) -> DataFrame:
    """The ten most frequent values."""
    return t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(count_rows().alias("n")).orderBy(F.desc("n"), "day").limit(10)


@query("""WITH f AS (SELECT p_brand, p_partkey, p_size, p_retailprice, bool_or(p_size > 48) OVER (PARTITION BY p_brand) AS strong, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_type, p_name, p_partkey) AS rank FROM part) SELECT p_brand, p_partkey, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= CASE WHEN strong THEN 5 ELSE 2 END""")
def dynamic_cap(t: Tables) -> DataFrame:
    """A chain of comparisons, and a cap that depends on whether a group has a strong hit."""
    by = Window.partitionBy("p_brand")
    out = t.part.select("p_brand", "p_partkey", F.max(F.col("p_size") > 48).over(by).alias("strong"), F.row_number().over(by.orderBy(F.desc("p_size"), "p_retailprice", "p_type", "p_name", "p_partkey")).alias("rank"))
    return out.where(F.col("rank") <= F.when(F.col("strong"), 5).otherwise(2)).select("p_brand", "p_partkey", "rank")


@query("""SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_name COLLATE NOCASE, c_custkey) AS INTEGER) AS place FROM customer ORDER BY c_name, c_custkey LIMIT 15""")
def code_point_sort(t: Tables) -> DataFrame:
    """The first fifteen by code points, ties by id."""
    top = t.customer.select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(15)
    return top.withColumn("place", F.row_number().over(Window.orderBy("c_name", "c_custkey")))  # fifteen rows


SETS_SQL = "a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')"


def edge_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct() for f in ("A", "R"))


@query(f"""WITH {SETS_SQL}, u AS (SELECT coalesce(a.s, b.s) AS s, a.s IS NOT NULL AS ina, b.s IS NOT NULL AS inb FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p)
SELECT count(*) FILTER (ina) AS in_left, count(*) FILTER (inb) AS in_right, count(*) FILTER (ina AND inb) AS in_both, count(*) FILTER (ina AND NOT inb) AS left_only, count(*) FILTER (inb AND NOT ina) AS right_only, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (ina AND inb) / count(*) END, 6) AS jaccard, count(*) FILTER (ina AND inb) = count(*) AS exact_equal FROM u""")
def edge_set_compare(t: Tables) -> DataFrame:
    """Two edge sets compared; no edges at all count as equal."""
    a, b = edge_sets(t)
    u = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["s", "p"], "full").select(F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    both = F.count_if(F.col("a") & F.col("b"))
    return u.agg(
        F.count_if("a").alias("in_left"), F.count_if("b").alias("in_right"), both.alias("in_both"), F.count_if(F.col("a") & ~F.col("b")).alias("left_only"), F.count_if(F.col("b") & ~F.col("a")).alias("right_only"),
        F.round(ratio(both, count_rows(), 1.0), 6).alias("jaccard"), (both == count_rows()).alias("exact_equal"),
    )


@query(f"""WITH {SETS_SQL}, u AS (SELECT coalesce(a.s, b.s) AS s, a.s IS NOT NULL AS ina, b.s IS NOT NULL AS inb FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p)
SELECT s, round(count(*) FILTER (ina AND inb) / count(*), 6) AS jaccard FROM u GROUP BY s""")
def neighbour_jaccard(t: Tables) -> DataFrame:
    """Jaccard similarity of two neighbour sets of each key; keys without neighbours don't occur."""
    a, b = edge_sets(t)
    u = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["s", "p"], "full")
    return u.groupBy("s").agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / count_rows(), 6).alias("jaccard"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def id_sets(t: Tables) -> DataFrame:
    """Union, intersection and difference of id sets."""
    a, b = (t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey") for f in ("A", "R"))
    sizes = [x.agg(F.lit(op).alias("op"), count_rows().alias("n")) for op, x in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)))]
    return sizes[0].union(sizes[1]).union(sizes[2])


@query("""WITH a AS (SELECT l_partkey AS p, count(*) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey), b AS (SELECT l_partkey AS p, count(*) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) SELECT a.p, a.f - coalesce(b.f, 0) AS f FROM a LEFT JOIN b ON a.p = b.p WHERE a.f > coalesce(b.f, 0)""")
def bag_difference(t: Tables) -> DataFrame:
    """Counts of one bag less another's, where more is left."""
    a, b = (t.lineitem.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("p")).agg(count_rows().alias(n)) for f, n in (("A", "f"), ("R", "g")))
    return a.join(b, "p", "left").select("p", (F.col("f") - F.coalesce("g", F.lit(0))).alias("f")).where("f > 0")


@query("""WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z]+')) AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard, len(list_intersect(a, b)) AS shared FROM t""")
def token_jaccard(t: Tables) -> DataFrame:
    """Jaccard similarity of token sets; two empty sets are not alike."""
    a, b = T.tokens(F.col("p_name")), T.tokens(F.col("p_type"))
    both = F.size(F.array_intersect(a, b)).cast("long")
    return t.part.select("p_partkey", F.round(ratio(both, F.size(F.array_union(a, b)), 0.0), 6).alias("jaccard"), both.alias("shared"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS shared, (SELECT count(*) FROM orders) = (SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS covered""")
def partition_check(t: Tables) -> DataFrame:
    """Whether classes are disjoint and cover everything."""
    o, f = (t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey") for s in ("O", "F"))
    shared = o.join(f, "o_orderkey", "left_semi").agg(count_rows().alias("shared"))
    total = t.orders.groupBy("o_orderstatus").agg(count_rows().alias("n")).agg(F.sum("n").alias("s")).crossJoin(t.orders.agg(count_rows().alias("t")))  # one row each
    return shared.crossJoin(total.select((F.col("s") == F.col("t")).alias("covered")))
