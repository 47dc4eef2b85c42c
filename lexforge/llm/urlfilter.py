"""URL filter: a blocked Bloom filter passes possible hits to an exact join.

The list holds canonical URLs (scheme, port 80/443, `www.`, query, fragment, a final `/` or `.html` don't
count). Its filter has one block of eight 64-bit words per group of URLs: a URL's hash names its block, and
eight further bits, one in each word, are set there. The filter's blocks lie in one array of rows, built by
one aggregation (bit_or, combined before the shuffle); the number of blocks follows the list's length up
to `MAX_BLOCKS`, so the broadcast filter never exceeds 16 MB: a longer list raises the rate of false
positives only. URLs whose bits are all set are joined with the list itself, which removes false
positives; all others never reach a shuffle. Rules by host and path prefix go before the list.

Everything is a DataFrame expression.

Defined results
- null url or none with `://`: host and path empty, no rule fits, never listed: allow;
- repeated rows: judged once each; empty list: allow; empty pages: no rows;
- further columns are not read; null page_id: kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

WORDS = 8
URLS_PER_BLOCK = 24
#: 2**18 blocks of 64 bytes.
MAX_BLOCKS = 1 << 18

#: The contract's rules: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The spelling that the list holds; null where there is no host."""
    name = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    return F.when(host != "", F.concat(name, F.regexp_replace(path, "(\\.html|/)$", "")))


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bits(url: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    h = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(6 * w)).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def n_blocks(n_urls: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-n_urls // URLS_PER_BLOCK)))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the filter over listed(url); at most `blocks` rows."""
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row of pages (page_id, url).

    listed(url): distinct canonical URLs to block where no rule fits.
    """
    listed = listed.select(F.col("url").cast("string").alias("url")).where("url is not null")
    blocks = n_blocks(listed.count())
    host, path = parts(F.col("url").cast("string"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = named.withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("fit", rule(F.col("host"), F.col("path"), rules))
    probed = keyed.withColumn("block", _block(F.coalesce("canonical", F.lit("")), blocks))
    at_block = probed.join(F.broadcast(bloom(listed, blocks)), "block", "left")  # at most MAX_BLOCKS rows of 72 bytes
    set_ = F.lit(True)
    for i, b in enumerate(_bits(F.col("canonical"))):
        set_ = set_ & (F.col(f"w{i}").bitwiseAND(b) == b)
    flagged = at_block.withColumn("maybe", F.coalesce(set_ & F.col("fit").isNull() & F.col("canonical").isNotNull(), F.lit(False)))
    clear = flagged.where("not maybe").withColumn("listed", F.lit(False))
    hits = flagged.where("maybe").join(listed.withColumnRenamed("url", "canonical").withColumn("found", F.lit(True)), "canonical", "left")
    hits = hits.withColumn("listed", F.coalesce("found", F.lit(False)))
    out = [F.col("page_id"), F.col("host"), F.col("path"), F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), F.col("listed")]
    return clear.select(*out).union(hits.select(*out))


def recrawled(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs that two or more rows of pages carry."""
    host, path = parts(F.col("url").cast("string"))
    urls = pages.select(host.alias("host"), path.alias("path")).select(canonical(F.col("host"), F.col("path")).alias("url")).where("url is not null")
    return urls.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url")


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, recrawled(pages)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html|/)$', '') END AS canonical FROM p),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
f AS (SELECT c.*, l.canonical IS NOT NULL AS listed, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c LEFT JOIN l USING (canonical))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
