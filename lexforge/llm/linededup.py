"""Line dedup: repeated runs of lines from a suffix array over line ids, by distributed prefix doubling.

The corpus is one sequence of line ids a document (blank lines left out, white space at the ends of a line
not counted); suffixes start at every line. Prefix doubling ranks suffixes by their first 1, 2, 4, ...
lines: a rank for 2k lines is the place of the pair (rank at i, rank at i + k) among the sorted distinct
pairs. Pairs are counted before they are sorted, and a suffix whose prefix occurs once leaves: it has no
LCP of that length with any neighbour. Doubling goes on until no prefix occurs twice, so the last level a
suffix reaches brackets its longest common prefix. The suffixes of one rank at length n are one interval of
LCP >= n of the suffix array; all but the first of it, by (doc_id, line), are later copies of n lines. Later
copies that overlap or touch make up the maximal repeated runs, and their lines go: runs of `min_lines`
lines, and single lines of `long_words` words, which are passages of their own.

A hot line costs a row per occurrence in joins that adaptive execution can split; counts and ranks are
aggregated before any shuffle; each level is staged.

Defined results
- null text: no lines, text stays null; empty or blank text: unchanged; blank lines stay where they are;
- rows of equal doc_id and text are one document and keep the same lines; null doc_id sorts first;
- fewer lines than min_lines and no long line: unchanged; no rows: no rows; all other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPACE, staged, table

#: Lines of a run, and words of a single line, that count as a passage.
MIN_LINES, LONG_WORDS = 2, 50
NODE = ["doc", "hash", "i"]


def line_ids(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, hash, i, pos, id, id2, long): a row per line that isn't blank; i counts those lines, pos all of them; two hashes name a line."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    keyed = keyed.select("doc", F.xxhash64("text").alias("hash"), F.split("text", "\n").alias("lines"))
    full = F.filter(F.transform("lines", lambda x, p: F.struct(p.alias("pos"), F.trim(x, F.lit(SPACE)).alias("line"))), lambda s: s["line"] != "")
    rows = keyed.select("doc", "hash", F.posexplode(full).alias("i", "s")).select("doc", "hash", "i", "s.pos", "s.line")
    some = f"^(?:[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+){{{long_words - 1}}}[^\\x20]"
    words = (F.length("line") >= 2 * long_words - 1) & F.col("line").rlike(some)
    return rows.select("doc", "hash", "i", "pos", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), words.alias("long"))


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs with `rank`, ordered as `by`; only those whose `by` occurs twice or more."""
    order = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    ranks = staged(order.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank")), "ranks")
    return pairs.join(ranks, by)


def levels(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, depth: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(n, level) for n = 1, 2, 4, ... as far as repeats go (or to n = depth), and min_lines among them: (doc, hash, i, rank, long) of the suffixes whose
    first n lines occur twice or more; equal prefixes have equal ranks, and ranks are in order."""
    lines = staged(line_ids(docs, long_words).select(*NODE, "id", "id2", "long"), "lines").distinct()
    level, n = staged(_ranked(lines, ["id", "id2"]).select(*NODE, "rank", "long"), "suffixes"), 1
    while not level.isEmpty():
        yield n, level
        if depth and n >= depth:
            return
        step = min(n, min_lines - n) if n < min_lines else n
        ahead = level.select("doc", "hash", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.i") == F.col("b.i"))
        pairs = level.alias("a").join(ahead.alias("b"), same).select("a.doc", "a.hash", "a.i", F.col("a.rank").alias("r0"), F.col("b.next").alias("r1"), "a.long")
        level, n = staged(_ranked(pairs, ["r0", "r1"]).select(*NODE, "rank", "long"), "suffixes"), n + step


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, depth: int | None = None) -> DataFrame:
    """(doc, hash, i, n): n lines from i on also start earlier; n is the longest of the levels at which they do."""
    found = None
    for n, level in levels(docs, min_lines, long_words, depth):
        if 1 < n < min_lines:
            continue
        level = level if n >= min_lines else level.where("long")
        first = level.groupBy("rank").agg(F.min(F.struct(*NODE)).alias("first")).select("first.*")
        same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.i") == F.col("b.i"))
        part = level.alias("a").join(first.alias("b"), same, "left_anti").select(*NODE, F.lit(n).alias("n"))
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc long, hash long, i int, n int")
    return found.groupBy(*NODE).agg(F.max("n").alias("n"))


def _gone(docs: DataFrame, min_lines: int, long_words: int) -> DataFrame:
    copies = later_copies(docs, min_lines, long_words)
    return copies.select("doc", "hash", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, depth: int | None = None) -> DataFrame:
    """docs with the lines of later copies out of `text`, and n_lines, n_removed (long), which replace columns of those names.

    depth = min_lines gives the same texts in fewer jobs: all lines of a longer later copy lie in later copies of min_lines lines.
    """
    gone = later_copies(docs, min_lines, long_words, depth).groupBy("doc", "hash").agg(F.collect_list(F.struct("i", "n")).alias("gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.struct(*kept).alias("row"))
    both = keyed.alias("a").join(gone.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.hash") == F.col("b.hash")), "left")
    rows = both.select(*(F.col("a.row")[c].cast("string").alias(c) if c == "text" else F.col("a.row")[c].alias(c) for c in kept), F.col("b.gone").alias("_gone"))
    schema = T.StructType([f for f in rows.schema if f.name != "_gone"] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(_without(kept), schema)


def _without(columns: list[str]):
    """mapInArrow over columns and _gone: the text without those of its lines, counted without blank ones."""
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, removed = [], [], []
            for text, gone in zip(b.column(at).cast(pa.large_binary()), b.column(len(columns))):
                lines = text.as_py().split(b"\n") if text.is_valid else []
                full = [p for p, x in enumerate(lines) if x and not x.isspace()]
                out = {full[i] for s in gone.as_py() for i in range(s["i"], s["i"] + s["n"])} if gone.is_valid else set()
                texts.append(b"\n".join(x for p, x in enumerate(lines) if p not in out) if text.is_valid else None)
                sizes.append(len(full))
                removed.append(len(out))
            arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(columns))]
            yield pa.record_batch([*arrays, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, "n_lines", "n_removed"])

    return run


def runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, start, n_lines): the maximal runs of lines that are later copies, in lines that aren't blank."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc", "hash").orderBy("i")  # the lines of one document
    gone = _gone(docs, min_lines, long_words).distinct().withColumn("run", F.col("i") - F.row_number().over(by))
    return gone.groupBy("doc", "hash", "run").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("n_lines")).select("doc", "start", "n_lines")


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
f AS (SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
w AS (SELECT a.doc_id, a.i, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.i) AS nth FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.i + 1 = b.i),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM f WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
g AS (SELECT DISTINCT doc_id, i + unnest([0, 1]) AS i FROM w WHERE nth > 1 UNION SELECT doc_id, i FROM o WHERE nth > 1),
p AS (SELECT f.doc_id, f.pos FROM f JOIN g USING (doc_id, i)),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN p ON l.doc_id = p.doc_id AND l.pos = p.pos WHERE p.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST((SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS BIGINT) AS n_lines, CAST((SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS kept_md5
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
