"""Quality rules whose cutoffs are set by risk control on labelled documents.

A rule rejects a text whose signal is above its cutoff; cutoffs come from a fixed grid, laxest first. In every
stratum (lang) the labelled documents that pass the base rules are dealt into two halves by a hash of doc_id.

1. Selection half: a path of cutoffs for all rules together, from none to stricter and stricter. Each step
   tightens the one rule that rejects most bad documents for each good one lost; no step after the path
   loses more than twice the risk here.
2. Holdout half: the good documents test the path's steps in this order. At a step that loses k of n, the
   exact binomial test P(Bin(n, risk) <= k) <= confidence / strata shows that the rules together lose at most
   `risk` (the one-sided Clopper-Pearson bound). The first step that fails ends the path (fixed-sequence
   testing: steps need no further correction), the last that holds gives the cutoffs.

So with probability 1 - confidence no stratum loses more than `risk` of its good documents to all rules
together (documents drawn independently; copies under other ids count as documents of their own).

Labelled documents are counted by the rules' bins before anything is brought together: a stratum holds at most
a row for each combination of bins, however many labels there are. The table of cutoffs has a row a stratum.

Defined results
- null, empty or blank text: no words, all counts 0, fails the base rules;
- null lang and empty lang: a stratum each; a stratum without labelled rows: base rules only;
- labels with null quality or doc_id: not used; repeated labels: the worst counts; a labelled document of
  several rows: its distinct rows count;
- ties in a step's gain: the first rule in the table of rules; a signal equal to a cutoff is not above it;
- repeated rows: judged alike; no rows: no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

RISK = 0.02
CONFIDENCE = 0.05
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Rule -> (signal, cutoffs from the laxest), fixed before any label is seen.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02]),
    "repeat_words": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / n_words", [0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.002]),
    "long_words": ("word_chars / n_words", [12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5, 6.0, 5.5]),
    "short_words": ("-word_chars / n_words", [-1.5, -2.0, -2.5, -2.75, -3.0, -3.25, -3.5, -4.0, -4.5]),
}
STEPS = 9
#: Selection stops where the rules lose so many times the risk.
SLACK = 2


def signals(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    repeat = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pair[:-1] * len(number) + ids[2:]
        _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
        many = n[back] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for o in range(3):
            covered[o : o + len(many)] |= many
        repeat = int(covered.sum())
    return len(words), chars, len(SYMBOLS.findall(text)), dup, repeat


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the counts and base_failed of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [signals(t.as_py()) for t in b.column(2).cast(pa.large_binary())]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], names=["doc_id", "stratum", *COUNTS])

    stratum = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), stratum), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly but for rounding."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def admissible(k: int, n: int, risk: float, level: float) -> bool:
    """Whether n trials with k false rejections show, at this level, a risk of at most `risk`."""
    if n == 0 or k > risk * n:
        return False
    return binomial_cdf(k, n, risk) <= level


def path(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, most: float) -> list[tuple[int, ...]]:
    """Steps of stricter and stricter cutoffs, as how many of each rule's grid are in force.

    bins: by row and rule, the first place of the grid that rejects, from 1; STEPS + 1: none. good, bad: documents of the row.
    """
    at = np.zeros(bins.shape[1], dtype=np.int64)
    left, lost, out = np.ones(len(bins), dtype=bool), 0, []
    while True:
        best = (0.0, 0, 0)
        for r in range(bins.shape[1]):
            gain_bad, gain_good = (np.cumsum(np.bincount(bins[left, r], weights=w[left], minlength=STEPS + 2)) for w in (bad, good))
            for t in range(int(at[r]) + 1, STEPS + 1):
                worth = gain_bad[t] / (gain_good[t] + 1)
                if worth > best[0] and lost + gain_good[t] <= most:
                    best = (worth, r, t)
        if not best[0]:
            return out
        _, r, t = best
        at[r] = t
        hit = left & (bins[:, r] <= t)
        lost += good[hit].sum()
        left &= ~hit
        out.append(tuple(at.tolist()))


def certified(steps: list[tuple[int, ...]], bins: np.ndarray, good: np.ndarray, risk: float, level: float) -> tuple[int, ...] | None:
    """The last step of the path that holds, with all before it, on the holdout's good documents."""
    held, n = None, int(good.sum())
    for step in steps:
        k = int(good[(bins <= np.array(step)).any(axis=1)].sum())
        if not admissible(k, n, risk, level):
            break
        held = step
    return held


def _value(rule: str) -> Column:
    return F.expr(f"try_divide({RULES[rule][0].replace(' / ', ', ')})")


def binned(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, half, a bin for each rule, good, bad): labelled documents counted by the rules' bins."""
    graded = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("fine"))
    bins = [F.lit(STEPS + 1) - sum((F.coalesce(_value(r) > c, F.lit(False)).cast("int") for c in grid), F.lit(0)) for r, (_, grid) in RULES.items()]
    rows = own.where("not base_failed").join(graded, "doc_id").select("doc_id", "fine", "stratum", *(b.alias(r) for r, b in zip(RULES, bins))).distinct()
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    return rows.groupBy("stratum", half.alias("half"), *RULES).agg(F.count_if("fine").alias("good"), F.count_if(~F.col("fine")).alias("bad"))


def cutoffs(own: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum and a cutoff for every rule (null: none), a row per stratum that has labelled documents."""
    counts = staged(binned(own, labels), "bins")
    strata = counts.where("good > 0").select(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))

    def run(table: pa.Table) -> pa.Table:
        bins = np.stack([table.column(r).to_numpy() for r in RULES], axis=1)
        good, bad, half = (table.column(c).to_numpy() for c in ("good", "bad", "half"))
        order = np.lexsort(bins.T)
        bins, good, bad, half = bins[order], good[order], bad[order], half[order]
        choose, hold = half == 0, half == 1
        steps = path(bins[choose], good[choose], bad[choose], SLACK * risk * good[choose].sum())
        held = certified(steps, bins[hold], good[hold], risk, confidence / table.column("strata")[0].as_py())
        picked = {r: grid[t - 1] if t else None for (r, (_, grid)), t in zip(RULES.items(), held or [0] * len(RULES))}
        return pa.Table.from_pylist([{"stratum": table.column("stratum")[0].as_py(), **picked}], schema=pa.schema([("stratum", pa.string())] + [(r, pa.float64()) for r in RULES]))

    rows = counts.crossJoin(F.broadcast(strata))  # one row
    return rows.groupBy("stratum").applyInArrow(run, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules (array of names) and kept of every row."""
    own = staged(measured(docs), "signals")
    cuts = cutoffs(own, labels, risk, confidence)
    failed = F.filter(F.array(*(F.when(_value(r) > F.col(r), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    out = own.join(cuts, "stratum", "left").withColumn("failed_rules", failed)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules", *(F.col(r).alias(f"cut_{r}") for r in RULES))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
