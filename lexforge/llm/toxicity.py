"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades of a labelled document: 0 not toxic, 1 toxic, 2 toxic and of low quality. For ordered thresholds
t1 <= t2 and shared weights w the model is P(grade >= k) = sigmoid(w.x - t_k). It gives every text an
expected severity, the sum of these probabilities, and rejects where P(grade >= 1) reaches one half.

Features (A-Z lower-cased, punctuation at the ends of words off): presence of a word, and for word
beginnings of 3, 5 and 7 characters whether at least one, two or four words of the text have them, which
catches families of word forms that no list of words holds.

The fit takes at most `LABELLED` labelled documents (those of smallest hash of doc_id) and the `FEATURES`
features of largest chi-square against toxicity; both are parameters. Feature counts are summed up by
Spark; the driver gets the chosen features of each sampled document. Scoring reads all documents whole.

Defined results
- null, empty or blank text: no features, the base rate, not rejected unless most labelled texts are toxic;
- labels with null toxic or null doc_id, or of no document: not used; repeated labels: the severest counts;
- no usable labels, or none toxic: severity 0, nothing rejected; no rows: no rows;
- repeated rows: scored alike, one row each; null doc_id: kept; further columns are not read (keep_mild
  returns them as they are).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, staged, table

LABELLED = 20_000
FEATURES = 2_000
LEAST_DOCS = 3
BEGINNINGS = (3, 5, 7)
COUNTS = (1, 2, 4)
#: Step between the hashes of a beginning's counts.
LEVEL = 0x9E3779B97F4A7C15
EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
REMEMBERED = 300_000


def word_features(chunk: bytes) -> list[tuple[int, bool]]:
    """(hash, is a beginning) of a word's features, from a lower-cased chunk without white space."""
    core = chunk.strip(EDGE)
    if not core:
        return []
    digest, text = xxhash.xxh64_intdigest, core.decode("utf-8", "replace")
    return [(digest(core), False)] + [(digest(text[:n].encode("utf-8", "replace"), n), True) for n in BEGINNINGS if len(text) > n]


def features(text: bytes | None, chosen: set[int] | None = None, known: dict | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's features, sorted; with `chosen`, of the base features in it only."""
    counts: dict[int, int] = {}
    found: set[int] = set()
    known = {} if known is None else known
    for chunk, n in Counter((text or b"").lower().split()).items():
        own = known.get(chunk)
        if own is None:
            if len(known) >= REMEMBERED:
                known.clear()
            own = known[chunk] = [x for x in word_features(chunk) if chosen is None or x[0] in chosen]
        for h, beginning in own:
            if beginning:
                counts[h] = counts.get(h, 0) + n
            else:
                found.add(h)
    for h, n in counts.items():
        found.update((h + k * LEVEL) % (1 << 64) for k, least in enumerate(COUNTS) if n >= least)
    return np.sort(np.array(list(found), dtype=np.uint64).view(np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights by word hash, and the ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.empty(0))

    def severity(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(score - self.thresholds)


def chi_square(n: Column, bad: Column, total: int, share: float) -> Column:
    """Of presence in n documents, bad of them toxic, against toxicity."""
    expected = n * share
    return (bad - expected) * (bad - expected) / (expected * (1 - share) * (1 - n / total))


def fit(docs: list[np.ndarray], grades: np.ndarray, l2: float = 1e-3, steps: int = 400, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on all rows; the same rows give the same model."""
    grades = np.asarray(grades)
    if not len(docs) or grades.max() == 0 or grades.min() > 0:
        return OrdinalModel()
    levels, total, share = int(grades.max()), len(docs), float((grades > 0).mean())
    rows = np.repeat(np.arange(total), [len(d) for d in docs])
    words, column = np.unique(np.concatenate(docs), return_inverse=True)
    picked = np.arange(len(words))
    # theta: weights, first threshold, log gaps
    theta = np.zeros(len(picked) + levels)
    theta[len(picked)] = np.log((1 - share) / share)
    m = v = np.zeros_like(theta)
    at_least = grades[:, None] >= np.arange(1, levels + 1)
    weight = np.ones(total) / total
    for step in range(1, steps + 1):
        w = theta[: len(picked)]
        gaps = np.exp(theta[len(picked) + 1 :])
        cuts = theta[len(picked)] + np.r_[0, np.cumsum(gaps)]
        eta = np.bincount(rows, weights=w[column], minlength=total)
        p = _sigmoid(eta[:, None] - cuts)
        edges = np.concatenate([np.ones((total, 1)), p, np.zeros((total, 1))], axis=1)
        own = np.maximum(edges[np.arange(total), grades] - edges[np.arange(total), grades + 1], 1e-12)
        slope = p * (1 - p)
        # d log(own) / d cut_k: minus where cut k opens the grade, plus where it closes it
        closes = at_least.sum(1)[:, None] + 1 == np.arange(1, levels + 1)
        opens = at_least.sum(1)[:, None] == np.arange(1, levels + 1)
        d_cut = slope * (closes.astype(float) - opens) / own[:, None]
        d_eta = -d_cut.sum(1)
        grad = np.empty_like(theta)
        grad[: len(picked)] = -np.bincount(column, weights=(weight * d_eta)[rows], minlength=len(picked)) + l2 * w
        by_cut = -(weight[:, None] * d_cut).sum(0)
        grad[len(picked)] = by_cut.sum()
        for k in range(1, levels):
            grad[len(picked) + k] = by_cut[k:].sum() * gaps[k - 1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = theta[len(picked)] + np.r_[0, np.cumsum(np.exp(theta[len(picked) + 1 :]))]
    return OrdinalModel(dict(zip(words[picked].tolist(), theta[: len(picked)].tolist())), cuts)


def _words(chosen: set[int] | None, pick: np.ndarray | None):
    """mapInArrow over (doc_id, grade, text): adds the hashes of the features, those in `pick` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            hashes = [features(t.as_py(), chosen, known) for t in b.column(2).cast(pa.large_binary())]
            if pick is not None:
                hashes = [h[np.isin(h, pick)] for h in hashes]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([h.tolist() for h in hashes], pa.list_(pa.int64()))], names=["doc_id", "grade", "words"])

    return run


def _bases(picked: np.ndarray) -> set[int]:
    """Every hash from which features() can reach a picked one."""
    return {(int(h) - k * LEVEL) % (1 << 64) for h in picked.view(np.uint64) for k in range(len(COUNTS))}


def trained(docs: DataFrame, labels: DataFrame, most: int = LABELLED, n_features: int = FEATURES) -> OrdinalModel:
    """The model of at most `most` labelled documents."""
    usable = labels.where("toxic is not null and doc_id is not null")
    graded = usable.groupBy("doc_id").agg(F.max(F.expr("case when toxic = 0 then 0 when coalesce(quality, 1) = 0 then 2 else 1 end")).alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = staged(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text"), "labelled")  # at most `most` rows of 12 bytes
    total, bad = joined.agg(F.count(F.lit(1)), F.count_if(F.col("grade") > 0)).head()
    if not bad or bad == total:
        return OrdinalModel()
    schema = "doc_id long, grade int, words array<long>"
    counts = joined.mapInArrow(_words(None, None), schema).select("grade", F.explode("words").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("bad"))
    ranked = counts.where(f"n >= {LEAST_DOCS} and n < {total}").orderBy(F.desc(F.round(chi_square(F.col("n"), F.col("bad"), total, bad / total), 9)), "h")
    pick = np.array([r.h for r in ranked.select("h").limit(n_features).collect()], dtype=np.int64)
    rows = joined.mapInArrow(_words(_bases(pick), pick), schema).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    return fit([np.array(r["words"], dtype=np.int64) for r in rows], np.array([r["grade"] for r in rows], dtype=np.int64))


def _probabilities(model: OrdinalModel):
    """Texts of a batch -> P(grade >= k) of each."""
    weights = model.weights
    bases = _bases(np.array(list(weights), dtype=np.int64))
    known: dict = {}

    def of(texts: pa.Array) -> list[np.ndarray]:
        return [model.severity(sum(weights[h] for h in features(t.as_py(), bases, known).tolist() if h in weights)) for t in texts.cast(pa.large_binary())]

    return of


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity, p_toxic, grade and rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _probabilities(model)
        for b in batches:
            ps = of(b.column(1))
            columns = [[float(p.sum()) for p in ps], [float(p[0]) if len(p) else 0.0 for p in ps], [int((p >= 0.5).sum()) for p in ps], [len(p) > 0 and bool(p[0] >= 0.5) for p in ps]]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int32(), pa.bool_())))], names=["doc_id", "severity", "p_toxic", "grade", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def keep_mild(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _probabilities(model)
        for b in batches:
            yield b.filter(pa.array([not (len(p) and p[0] >= 0.5) for p in of(b.column(at))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))
