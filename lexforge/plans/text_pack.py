"""Text functions over documents, benchmark, pages and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.plans.registry import Tables, query
from lexforge.plans.retrieval import ALPHABET, NORM_SQL

WS = "[\\s\\x{00A0}]+"


def sql_norm(x: str) -> str:
    return NORM_SQL.format(x)


def sql_tokens(x: str, alphabet: str = ALPHABET) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{alphabet}')"


@query(f"""SELECT doc_id, md5({sql_norm('text')}) AS folded, md5(lower(trim(regexp_replace(text, '{WS}', ' ', 'g')))) AS lowered, md5(lower(nfc_normalize(trim(text)))) AS composed,
length(trim(regexp_replace(text, '{WS}', ' ', 'g'))) > 0 AS has_text FROM documents""")
def text_norms(t: Tables) -> DataFrame:
    """The normalisations of a text: folded, lowered, and composed (NFC, pandas)."""
    x = F.col("text")
    nfc = F.lower(T.normalize_unicode(F.trim(x), F.lit("NFC")))
    return t.documents.select("doc_id", F.md5(T.norm(x)).alias("folded"), F.md5(T.lower_norm(x)).alias("lowered"), F.md5(nfc).alias("composed"), (F.length(T.lower_norm(x)) > 0).alias("has_text"))


@query()
def text_nfkc(t: Tables) -> DataFrame:
    """Compatibility normalisation, folded (SQL has no NFKC; tested against the standard library)."""
    return t.documents.select("doc_id", T.norm(T.normalize_unicode(F.col("text"), F.lit("NFKC"))).alias("text"))


@query(f"""SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, md5(lower(array_to_string({sql_tokens('text')}, ' '))) AS tokens,
len(regexp_extract_all({sql_norm('text')}, '{T.WORD_TOKEN}')) AS n_word_tokens, md5(array_to_string(regexp_extract_all({sql_norm('text')}, '{T.WORD_TOKEN}'), ' ')) AS word_tokens,
len(regexp_extract_all(text, '[^\\s\\-_/(),.;:]+')) AS n_split_tokens FROM documents""")
def text_tokens(t: Tables) -> DataFrame:
    """Three tokenisers: letters and digits, with + and #, and cut at separators."""
    x = F.col("text")
    a, b, c = T.tokens(x), T.word_tokens(x), T.split_tokens(x)
    size = [F.size(v).cast("long").alias(n) for v, n in ((a, "n_tokens"), (b, "n_word_tokens"), (c, "n_split_tokens"))]
    return t.documents.select("doc_id", *size, F.md5(F.array_join(a, " ")).alias("tokens"), F.md5(F.array_join(b, " ")).alias("word_tokens"))


@query(f"""WITH w AS (SELECT item_id, ' ' || lower(unnest({sql_tokens('text')})) || ' ' AS w FROM benchmark), n AS (SELECT item_id, w, unnest([3, 4]) AS n FROM w),
g AS (SELECT item_id, substr(w, p, n) AS gram FROM (SELECT item_id, w, n, unnest(range(1, length(w) - n + 2)) AS p FROM n WHERE length(w) >= n))
SELECT item_id, gram, count(*) AS n FROM g GROUP BY item_id, gram""")
def padded_char_ngrams(t: Tables) -> DataFrame:
    """3- and 4-grams of words with a space on either side, counted."""
    grams = T.padded_ngrams(T.tokens(F.col("text")))
    return t.benchmark.select("item_id", F.explode(grams).alias("gram")).groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("n"))


FOUR_SQL = f"""w AS (SELECT doc_id, {sql_tokens('lower(text)')} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM w WHERE len(w) >= 4)),
v AS (SELECT item_id, {sql_tokens('lower(text)')} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 3], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM v WHERE len(w) >= 4))"""


def four_grams(df: DataFrame, key: str) -> DataFrame:
    cut = df.select(key, T.tokens(F.col("text")).alias("tokens"))  # a column, so that the lambda below doesn't cut anew for every run
    return cut.select(key, F.explode(T.token_ngrams(F.col("tokens"), 4)).alias("gram"))


@query(f"WITH {FOUR_SQL} SELECT doc_id, item_id, count(*) AS shared FROM g JOIN b USING (gram) GROUP BY doc_id, item_id")
def four_gram_leakage(t: Tables) -> DataFrame:
    """Documents and benchmark passages that share a run of four tokens: an equi-join on the runs."""
    return four_grams(t.documents, "doc_id").join(four_grams(t.benchmark, "item_id"), "gram").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query(f"WITH {FOUR_SQL} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM g JOIN b USING (gram))")
def leakage_free_items(t: Tables) -> DataFrame:
    """Benchmark passages that share no run of four tokens with any document."""
    leaked = four_grams(t.documents, "doc_id").join(four_grams(t.benchmark, "item_id"), "gram").select("item_id")
    return t.benchmark.select("item_id").join(leaked, "item_id", "left_anti")


PARTS_SQL = "(SELECT p_partkey, p_name, p_type, p_brand, regexp_extract_all(lower(p_name), '[a-z]+') AS w FROM part)"


@query(f"""WITH p AS {PARTS_SQL} SELECT p_partkey, contains(' ' || array_to_string(w, ' ') || ' ', ' widget ') AS has_phrase, contains(' ' || lower(p_name) || ' ', ' ring ') AS has_surface,
contains(lower(p_name), 'bolt') AS has_substring, false AS has_short FROM p""")
def phrase_tests(t: Tables) -> DataFrame:
    """A phrase among tokens, a surface between spaces, a substring of four letters or more."""
    x = F.col("p_name")
    return t.part.select(
        "p_partkey", T.phrase_present(T.tokens(x), F.array(F.lit("widget"))).alias("has_phrase"), T.has_surface(x, F.lit("Ring")).alias("has_surface"),
        T.contains_surface(x, F.lit("bolt")).alias("has_substring"), T.contains_surface(x, F.lit("red")).alias("has_short"),
    )


NAMES_SQL = "n AS (SELECT DISTINCT p_name AS name FROM part), ab AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON string_split(a.name, ' ')[1] = string_split(b.name, ' ')[1] AND a.name < b.name)"
LIMIT_SQL = "CASE WHEN length({0}) >= 9 THEN 2 WHEN length({0}) >= 6 THEN 1 ELSE 0 END"


def name_pairs(t: Tables) -> DataFrame:
    """Pairs of distinct names of one first word, by equi-join on it."""
    n = t.part.select("p_name", F.element_at(F.split("p_name", " "), 1).alias("first")).distinct()
    return n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), "first").where("a < b")


@query(f"""WITH {NAMES_SQL} SELECT a, b, levenshtein(a, b) AS distance, least(levenshtein(a, b), 4) AS bounded, {LIMIT_SQL.format('a')} AS allowed, levenshtein(a, b) <= {LIMIT_SQL.format('a')} AS near FROM ab""")
def edit_distances(t: Tables) -> DataFrame:
    """Edit distance, bounded distance (limit + 1 beyond), and the limit by length."""
    a, b = F.col("a"), F.col("b")
    limit = T.fuzzy_limit(a)
    columns = [F.levenshtein(a, b).cast("long").alias("distance"), T.bounded_levenshtein(a, b, 3).cast("long").alias("bounded"), limit.alias("allowed"), (F.levenshtein(a, b) <= limit).alias("near")]
    return name_pairs(t).select("a", "b", *columns)


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS w FROM part), ab AS (SELECT x.w AS a, y.w AS b FROM t x JOIN t y ON x.w <= y.w),
c AS (SELECT a, b, least(length(a), length(b)) AS s, greatest(length(a), length(b)) AS l, (SELECT count(*) FROM range(1, least(length(a), length(b)) + 1) r(i) WHERE substr(a, 1, r.i) = substr(b, 1, r.i)) AS p,
 least(CASE WHEN length(a) >= 9 THEN 2 WHEN length(a) >= 6 THEN 1 ELSE 0 END, CASE WHEN length(b) >= 9 THEN 2 WHEN length(b) >= 6 THEN 1 ELSE 0 END) AS f FROM ab),
d AS (SELECT *, CASE WHEN a = b THEN 4 WHEN s >= 5 AND (contains(a, b) OR contains(b, a)) THEN 3 WHEN s >= 6 AND p >= 5 AND p >= 0.65 * s THEN 2 WHEN s >= 6 AND levenshtein(a, b) <= f THEN 1 ELSE 0 END AS signal FROM c)
SELECT a, b, CAST(signal AS INTEGER) AS signal, CAST(CASE WHEN signal = 2 THEN p WHEN signal = 1 THEN l - levenshtein(a, b) ELSE s END AS INTEGER) AS specificity FROM d WHERE signal > 0""")
def pair_signals(t: Tables) -> DataFrame:
    """How alike two words are, of those that are at all: equal, held, shared beginning, within the fuzzy limit."""
    w = t.part.select(F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("a")).distinct()
    pairs = alike_words(w, "a", w.withColumnRenamed("a", "b"), "b").where("a <= b")
    return pairs.select("a", "b", "signal", "specificity")


def alike_words(xs: DataFrame, x: str, ys: DataFrame, y: str) -> DataFrame:
    """(x, y, signal, specificity) of the distinct words of xs and ys whose pair signal isn't 0.

    Words meet under keys that every such pair shares: themselves, the five letters that the shorter begins
    with somewhere in the longer, five letters they begin with, or what they become without up to two letters.
    """

    def keys(df: DataFrame, c: str) -> DataFrame:
        w = F.col(c)
        five = F.transform(T.char_ngrams(w, 5), lambda g: F.concat(F.lit("5"), g))
        near = F.when(F.length(w) >= 6, F.transform(T.deletions(w), lambda g: F.concat(F.lit("~"), g))).otherwise(F.array().cast("array<string>"))
        return df.select(c, F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), w)), five, near))).alias("key"))

    met = keys(xs, x).join(keys(ys, y), "key").select(x, y).distinct()
    return met.withColumn("s", T.pair_signal(F.col(x), F.col(y))).select(x, y, "s.signal", "s.specificity").where("signal > 0")


@query("""WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS w FROM part), v AS (SELECT DISTINCT w FROM w),
q0 AS (SELECT DISTINCT w AS q FROM w UNION SELECT DISTINCT substr(w, 1, length(w) // 2) || substr(w, length(w) // 2 + 2) FROM w), q AS (SELECT q, dense_rank() OVER (ORDER BY q) AS query_id FROM q0 WHERE q <> ''),
c AS (SELECT query_id, q AS a, w AS b, least(length(q), length(w)) AS s, greatest(length(q), length(w)) AS l, levenshtein(q, w) AS e, (SELECT count(*) FROM range(1, least(length(q), length(w)) + 1) r(i) WHERE substr(q, 1, r.i) = substr(w, 1, r.i)) AS p FROM q CROSS JOIN v),
d AS (SELECT *, CASE WHEN a = b THEN 4 WHEN s >= 5 AND (contains(a, b) OR contains(b, a)) THEN 3 WHEN s >= 6 AND p >= 5 AND p >= 0.65 * s THEN 2 WHEN s >= 6 AND e <= CASE WHEN s >= 9 THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS signal FROM c),
f AS (SELECT query_id, b, signal, CASE WHEN signal = 2 THEN p WHEN signal = 1 THEN l - e ELSE s END AS specificity FROM d WHERE signal > 0),
o AS (SELECT query_id, id AS doc_id, max(signal) AS signal, max(signal * 1000 + specificity) % 1000 AS specificity FROM f JOIN w ON w.w = f.b GROUP BY query_id, id),
r AS (SELECT query_id, doc_id, CAST(signal AS INTEGER) AS signal, CAST(specificity AS INTEGER) AS specificity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY signal DESC, specificity DESC, doc_id) AS INTEGER) AS rank FROM o)
SELECT query_id, doc_id, signal, specificity, rank FROM r WHERE rank <= 5""")
def surface_ranking(t: Tables) -> DataFrame:
    """Surface rank: every part by its most alike word (signal, then specificity) for one-word queries, well and badly spelt; five each."""
    words = t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).distinct()
    vocabulary = words.select("w").distinct()
    asked = vocabulary.select(F.col("w").alias("q")).union(vocabulary.select(T.drop_middle(F.col("w")))).where("q <> ''").distinct()
    alike = alike_words(asked, "q", vocabulary, "w").join(words, "w").groupBy("q", "doc_id").agg(F.max(F.struct("signal", "specificity")).alias("s"))
    number = asked.withColumn("query_id", F.dense_rank().over(Window.orderBy("q")).cast("long"))  # a vocabulary's words
    best = Window.partitionBy("q").orderBy(F.desc("s.signal"), F.desc("s.specificity"), "doc_id")
    top = alike.withColumn("rank", F.row_number().over(best)).where("rank <= 5").join(number, "q")
    return top.select("query_id", "doc_id", "s.signal", "s.specificity", "rank")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, needle, unnest(list_distinct([greatest(length(needle) + d, 3) FOR d IN [-2, -1, 0, 1, 2]])) AS size FROM n, (VALUES ('widgit'), ('blot'), ('smal rng')) v(needle)) ,
w AS (SELECT name, needle, min(levenshtein(needle, substr(name, p, size))) AS d FROM (SELECT *, unnest(range(1, length(name) - size + 2)) AS p FROM s WHERE length(name) >= size) GROUP BY name, needle)
SELECT n.name, v.needle, least(coalesce(d, levenshtein(v.needle, n.name)), levenshtein(v.needle, n.name)) AS distance, least(coalesce(d, levenshtein(v.needle, n.name)), levenshtein(v.needle, n.name)) <= greatest(2, floor(length(v.needle) * 0.25)) AS accepted
FROM n CROSS JOIN (VALUES ('widgit'), ('blot'), ('smal rng')) v(needle) LEFT JOIN w ON w.name = n.name AND w.needle = v.needle""".replace("list_distinct([greatest(length(needle) + d, 3) FOR d IN [-2, -1, 0, 1, 2]])", "list_distinct([greatest(length(needle) - 2, 3), greatest(length(needle) - 1, 3), greatest(length(needle), 3), greatest(length(needle) + 1, 3), greatest(length(needle) + 2, 3)])"))
def fuzzy_substrings(t: Tables) -> DataFrame:
    """Misspelt words found inside names: the best window, and whether it is near enough."""
    needles = F.explode(F.array(*(F.lit(x) for x in ("widgit", "blot", "smal rng"))))
    rows = t.part.select(F.col("p_name").alias("name")).distinct().select("name", needles.alias("needle"))
    out = rows.withColumn("distance", T.fuzzy_substring(F.col("needle"), F.col("name")).cast("long"))
    return out.withColumn("accepted", T.fuzzy_accept(F.col("needle"), F.col("distance")))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) = 'blue bolt' THEN 'exact' WHEN starts_with(lower(p_name), 'blue') AND false THEN '' END AS exact_kind,
CASE WHEN lower(p_name) = 'blue' THEN 'exact' WHEN starts_with(lower(p_name), 'blue') THEN 'prefix' WHEN contains(' ' || lower(p_name), ' blue') THEN 'word_boundary' WHEN contains(lower(p_name), 'blue') THEN 'contains' END AS blue_kind,
CASE WHEN starts_with(lower(p_name), 'bolt') THEN 'prefix' WHEN contains(' ' || lower(p_name), ' bolt') THEN 'word_boundary' WHEN contains(lower(p_name), 'bolt') THEN 'contains' END AS bolt_kind,
CASE WHEN starts_with(lower(p_name), 'olt') THEN 'prefix' WHEN contains(' ' || lower(p_name), ' olt') THEN 'word_boundary' WHEN contains(lower(p_name), 'olt') THEN 'contains' END AS olt_kind FROM part""")
def direct_matches(t: Tables) -> DataFrame:
    """How a query stands in a label."""
    x = F.col("p_name")
    exact = F.when(T.direct_match(F.lit("Blue bolt"), x) == "exact", "exact")
    return t.part.select("p_partkey", exact.alias("exact_kind"), *(T.direct_match(F.lit(q), x).alias(f"{q}_kind") for q in ("blue", "bolt", "olt")))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'))) AS text,
len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS n_links FROM pages""")
def page_texts(t: Tables) -> DataFrame:
    """Mark-up off: references decoded (pandas), tags and white space collapsed; and the anchors counted."""
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).cast("long")
    return t.pages.select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("text"), links.alias("n_links"))


@query(r"""SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)""")
def page_links(t: Tables) -> DataFrame:
    """(href, label) of every anchor."""
    a = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("a"))
    return a.select("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("a", ">([^<]*)<", 1)).alias("label"))


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', ' ', 'g'), '{T.URL}', ' ', 'g'), '{T.PHONE}', '\1 ', 'g'), '{WS}', ' ', 'g'))) AS text,
len(regexp_extract_all(text, '{T.EMAIL}')) AS n_mails, len(regexp_extract_all(text, '{T.URL}')) AS n_urls FROM documents""")
def scrubbed(t: Tables) -> DataFrame:
    """E-mail addresses, URLs and phone numbers out of texts."""
    n = [F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias(c) for p, c in ((T.EMAIL, "n_mails"), (T.URL, "n_urls"))]
    return t.documents.select("doc_id", F.md5(T.scrub(F.col("text"))).alias("text"), *n)


@query(r"""SELECT doc_id, md5(substr(text, coalesce(nullif(least(CASE WHEN strpos(lower(text), ' the ') > 0 THEN strpos(lower(text), ' the ') ELSE 999999999 END, CASE WHEN strpos(lower(text), ' les ') > 0 THEN strpos(lower(text), ' les ') ELSE 999999999 END), 999999999), 1), 1200)) AS slice,
array_to_string((string_split(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')), ' '))[1:12], ' ') AS clipped FROM documents""")
def slices(t: Tables) -> DataFrame:
    """The 1200 characters from the first marker on, and the first twelve words."""
    x = F.col("text")
    return t.documents.select("doc_id", F.md5(T.work_slice(x, [" the ", " les "])).alias("slice"), T.clip_words(x, 12).alias("clipped"))


@query(r"""WITH s AS (SELECT doc_id, trim(x) AS x, i FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS x, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents) WHERE trim(x) <> ''),
k AS (SELECT doc_id, x, i FROM s WHERE NOT contains(lower(x), 'the')) SELECT d.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS n_sentences, (SELECT count(*) FROM k WHERE k.doc_id = d.doc_id) AS n_kept FROM documents d""")
def sentence_filter(t: Tables) -> DataFrame:
    """Sentences, and those without a forbidden surface."""
    s = T.sentences(F.col("text"))
    kept = F.filter(s, lambda x: ~F.contains(F.lower(x), F.lit("the")))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.size(kept).cast("long").alias("n_kept"))


@query(rf"""WITH w AS (SELECT doc_id, text, lower(unnest({sql_tokens('text')})) AS w FROM documents)
SELECT d.doc_id, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id AND NOT regexp_full_match(w.w, '[0-9]+')) AS n_words, starts_with({sql_norm('d.text')}, 'the ') OR length({sql_norm('d.text')}) < 30 AS is_terse, {sql_norm('d.text')} <> '' AND {sql_norm('d.text')} <> {sql_norm('d.source')} AS is_definition FROM documents d""")
def text_predicates(t: Tables) -> DataFrame:
    """Tokens that aren't numbers, terse texts, real definitions."""
    x = F.col("text")
    n = F.size(T.without_numbers(T.tokens(x))).cast("long")
    return t.documents.select("doc_id", n.alias("n_words"), T.terse(x, "the ").alias("is_terse"), T.real_definition(x, F.col("source")).alias("is_definition"))


@query("""WITH w AS (SELECT p_partkey, regexp_extract(lower(p_type), '[a-z]+') AS w FROM part WHERE length(p_type) >= 5)
SELECT p_partkey, substr(w, 1, length(w) // 2) || substr(w, length(w) // 2 + 2) AS dropped, substr(w, 1, length(w) // 2 - 1) || substr(w, length(w) // 2 + 1, 1) || substr(w, length(w) // 2, 1) || substr(w, length(w) // 2 + 2) AS swapped FROM w""")
def typos(t: Tables) -> DataFrame:
    """Deterministic misspellings of the longest word."""
    w = T.longest_word(T.tokens(F.col("p_type")))
    return t.part.where(F.length("p_type") >= 5).select("p_partkey", T.drop_middle(w).alias("dropped"), T.swap_middle(w).alias("swapped"))


@query("""SELECT doc_id, sha256('split:' || doc_id) AS key, CAST(('0x' || substr(sha256('split:' || doc_id), 1, 8)) AS BIGINT) AS number, CAST(('0x' || substr(sha256('split:' || doc_id), 1, 8)) AS BIGINT) % 5 = 0 AS in_fifth,
CASE WHEN CAST(('0x' || substr(sha256('split:' || doc_id), 1, 8)) AS BIGINT) % 100 < 60 THEN 'calibration' ELSE 'test' END AS split FROM documents""")
def hash_splits(t: Tables) -> DataFrame:
    """Reproducible splits by a salted hash of the key: 60/40, and one fifth."""
    n = T.hash_fraction("split", F.col("doc_id"))
    split = F.when(n % 100 < 60, "calibration").otherwise("test")
    return t.documents.select("doc_id", T.stable_hash("split", F.col("doc_id")).alias("key"), n.alias("number"), (n % 5 == 0).alias("in_fifth"), split.alias("split"))


@query("""SELECT p_brand, count(*) AS n, sha256(string_agg(sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}'), '' ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand""")
def content_hashes(t: Tables) -> DataFrame:
    """A hash of every group's rows as sorted-key JSON, in the order of the key."""
    row = F.sha2(F.to_json(F.struct("p_name", "p_partkey")), 256)
    hashes = F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("h"))))
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(hashes, lambda s: s["h"]), ""), 256).alias("digest"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2 AS n_items FROM events""")
def tolerant_json(t: Tables) -> DataFrame:
    """Fields of JSON texts; an array is found plain or inside an envelope."""
    envelope = F.when(F.col("event_id") % 2 == 0, F.lit('["a","b"]')).otherwise(F.lit('{"items":["a","b"]}'))
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(T.json_items(envelope)).alias("n_items"))


SENTENCES_SQL = r"""s AS (SELECT doc_id, trim(x) AS x, i FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS x, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents) WHERE trim(x) <> ''),
o AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, contains(lower(x), 'hat') AS bad, contains(lower(x), 'tion') OR contains(lower(x), 'ung') AS task FROM s)"""


@query(f"""WITH {SENTENCES_SQL}, f AS (SELECT doc_id, min(i) AS i FROM o WHERE task AND NOT bad GROUP BY doc_id),
k AS (SELECT o.doc_id, string_agg(x, ' ' ORDER BY o.i) AS q FROM o JOIN f ON f.doc_id = o.doc_id AND o.i BETWEEN f.i AND f.i + 3 WHERE NOT bad GROUP BY o.doc_id),
l AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS q FROM o WHERE NOT bad GROUP BY doc_id),
w AS (SELECT doc_id, string_split(trim(regexp_replace(q, '\\s+', ' ', 'g')), ' ') AS w FROM k), v AS (SELECT doc_id, string_split(trim(regexp_replace(q, '\\s+', ' ', 'g')), ' ') AS w FROM l)
SELECT d.doc_id, md5(array_to_string(w.w[1:50], ' ')) AS task, md5(array_to_string(v.w[1:80], ' ')) AS lead FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id AND len(w.w) >= 12 LEFT JOIN v ON v.doc_id = d.doc_id AND len(v.w) >= 25""")
def task_queries(t: Tables) -> DataFrame:
    """Queries made of texts: the sentences about a task, and the text without sentences that give the answer away."""
    x = F.col("text")
    return t.documents.select("doc_id", F.md5(T.task_query(x, ["tion", "ung"], ["hat"])).alias("task"), F.md5(T.leak_free(x, ["hat"])).alias("lead"))


def stemmed(df: DataFrame, id_: str, raw: bool) -> DataFrame:
    """df (id_, tokens) with the stems of its tokens, repeats kept; with `raw`, the tokens before them. Each distinct token is stemmed once."""
    words = df.select(id_, F.explode("tokens").alias("term"))
    stems = words.select("term").distinct().withColumn("stem", T.stem_words("term"))
    own = words.join(stems, "term").groupBy(id_).agg(F.collect_list(F.concat(F.lit("m:"), "stem")).alias("_stems"))
    out = F.coalesce("_stems", F.array().cast("array<string>"))
    return df.join(own, id_, "left").withColumn("tokens", F.concat("tokens", out) if raw else out).drop("_stems")


@query()
def stemmed_terms(t: Tables) -> DataFrame:
    """(doc_id, term, stem, tf): stems of distinct tokens by a pandas UDF, joined back (tested against the rules)."""
    tf = t.documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    stems = tf.select("term").distinct().withColumn("stem", T.stem_words("term"))
    return tf.join(stems, "term").select("doc_id", "term", "stem", "tf")


@query(f"""WITH w AS (SELECT item_id, {sql_tokens('lower(text)')} AS w FROM benchmark), b AS (SELECT item_id, 'b:' || w[p] || '_' || w[p + 1] AS feature FROM (SELECT item_id, w, unnest(range(1, len(w))) AS p FROM w WHERE len(w) >= 2))
SELECT item_id, feature, count(*) AS n FROM b GROUP BY item_id, feature""")
def pair_features(t: Tables) -> DataFrame:
    """Neighbouring tokens as features."""
    cut = t.benchmark.select("item_id", T.tokens(F.col("text")).alias("tokens"))
    return cut.select("item_id", F.explode(T.adjacent_pairs(F.col("tokens"))).alias("feature")).groupBy("item_id", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_partkey, trim(unnest(string_split(replace(p_type || '/' || p_name || ',' || p_brand, '/', ','), ','))) AS s FROM part) SELECT DISTINCT p_partkey, lower(s) AS surface FROM s WHERE length(s) >= 4""")
def title_surfaces(t: Tables) -> DataFrame:
    """Surfaces of a label and its alternatives: cut at commas, strokes and brackets, four letters or more."""
    label = F.concat_ws(",", F.concat_ws("/", "p_type", "p_name"), "p_brand")
    s = t.part.select("p_partkey", F.explode(F.split(label, r"[,/()]")).alias("s"))
    return s.select("p_partkey", T.norm(F.col("s")).alias("surface")).where(F.length("surface") >= 4).distinct()
