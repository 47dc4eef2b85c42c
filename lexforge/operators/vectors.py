"""Sparse vectors in long form (id, feature, w) and dense ones as arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.counts import count_rows



def smoothed_idf(docs: DataFrame, min_df: int = 2) -> DataFrame:
    """(feature, idf) of docs (doc_id, tokens): ln((1 + n) / (1 + df)) + 1, features of min_df documents or more."""
    df = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("feature")).groupBy("feature").agg(count_rows().alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(docs.agg(count_rows().alias("n")))).select("feature", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def normalised(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Unit length: norms are aggregated and joined back, so no vector has to sit in one task."""
    norm = vectors.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return vectors.join(norm, by).select(*by, "feature", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(docs: DataFrame, idf: DataFrame, by: list[str]) -> DataFrame:
    """(by..., feature, w) with (1 + ln tf) idf, unit length."""
    tf = docs.select(*by, F.explode("tokens").alias("feature")).groupBy(*by, "feature").agg(count_rows().alias("tf"))
    return normalised(tf.join(idf, "feature").select(*by, "feature", ((1 + F.log("tf")) * F.col("idf")).alias("w")), by)


def centroids(vectors: DataFrame, cls: str, mean: bool = False) -> DataFrame:
    """(cls, feature, w): the sum (or mean over members) of a class's vectors, unit length unless a mean."""
    total = vectors.groupBy(cls, "feature").agg(F.sum("w").alias("w"))
    if not mean:
        return normalised(total, [cls])
    size = vectors.select(cls, "doc_id").distinct().groupBy(cls).agg(count_rows().alias("n"))
    return total.join(size, cls).select(cls, "feature", (F.col("w") / F.col("n")).alias("w"))


def pruned(vectors: DataFrame, by: list[str], k: int, digits: int = 9) -> DataFrame:
    """The k features of largest absolute weight of each vector, ties by feature."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(F.abs("w"), digits)), "feature")
    return vectors.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def quantised_unsigned(vectors: DataFrame) -> DataFrame:
    """w as 1..255 of the largest weight of all, half to even."""
    top = vectors.agg(F.max("w").alias("top"))
    q = F.rint(F.round(F.col("w") / F.col("top") * 255, 6)).cast("int")
    return vectors.crossJoin(F.broadcast(top)).withColumn("q", F.greatest(F.lit(1), F.least(F.lit(255), q))).drop("top")  # one row


def quantised_signed(vectors: DataFrame, by: list[str]) -> DataFrame:
    """w as -127..127 of each vector's largest absolute weight; what would be zero becomes its sign."""
    top = F.max(F.abs("w")).over(Window.partitionBy(*by))
    q = F.rint(F.round(F.col("w") / top * 127, 6)).cast("int")
    return vectors.withColumn("q", F.when(q == 0, F.signum("w").cast("int")).otherwise(q))


def dot(a: DataFrame, b: DataFrame, a_by: str, b_by: str) -> DataFrame:
    """(a_by, b_by, score): inverted dot products of two sparse tables; pairs without a shared feature don't occur."""
    left = a.select(a_by, "feature", F.col("w").alias("wa"))
    right = b.select(b_by, "feature", F.col("w").alias("wb"))
    return left.join(right, "feature").groupBy(a_by, b_by).agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def dense_dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dense_dot(a, b) / F.nullif(F.sqrt(dense_dot(a, a)) * F.sqrt(dense_dot(b, b)), F.lit(0.0))


#: Vectors compared at once, of the table and of the queries; how far single precision may put a cosine off.
TABLE_BLOCK, QUERY_BLOCK, SLACK = 4096, 1024, 1e-4


def padded(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of lists of numbers: shorter ones end in zeros, nulls are zero."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=1))), dtype=np.float32 if pa.types.is_float32(vectors.type.value_type) else np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), out


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; NaN where there is none."""
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(queries, k: int):
    """mapInArrow over rows (id, vector): (query_id, doc_id, score), of each query (a broadcast of `padded`) the k vectors of
    other ids that come first among the rows of a task by cosine (9 digits; NaN first) and id.

    Products in single precision tell which pairs may be among them; those are computed in double precision.
    """

    def first(q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k of every q, in order of q."""
        order = np.lexsort((doc, -np.round(score, 9), ~np.isnan(score), q))
        q, doc, score = q[order], doc[order], score[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        kept = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
        return q[kept], doc[kept], score[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, raw = queries.value
        if not len(asked):
            return
        best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)) for _ in range(0, len(asked), QUERY_BLOCK)]
        least = np.full(len(asked), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, TABLE_BLOCK):
                part = b.slice(at, TABLE_BLOCK)
                ids, x = padded(part.column(0), part.column(1))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                # of equal vectors, the k + 1 smallest ids can come first, the query's own among them
                _, kind = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").reshape(-1), return_inverse=True)
                by = np.argsort(kind, kind="stable")
                start = np.flatnonzero(np.r_[True, np.diff(kind[by]) > 0])
                by = np.sort(by[np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)])) <= k])
                ids, x = ids[by], _units(x[by])
                width = max(x.shape[1], raw.shape[1])
                x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                single = x.T.astype(np.float32)
                for i, lo in enumerate(range(0, len(asked), QUERY_BLOCK)):
                    q = _units(raw[lo : lo + QUERY_BLOCK])
                    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
                    score = q.astype(np.float32) @ single
                    score[np.isnan(score)] = np.inf
                    floor = least[lo : lo + QUERY_BLOCK]
                    if np.isneginf(floor).any() and len(ids) > k + 1:
                        floor = np.maximum(floor, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)])
                    row, col = np.nonzero(score >= (floor - SLACK)[:, None].astype(np.float32))
                    other = asked[lo + row] != ids[col]
                    row, col = row[other], col[other]
                    if not len(row):
                        continue
                    exact = np.concatenate([np.einsum("ij,ij->i", q[row[j : j + 65_536]], x[col[j : j + 65_536]]) for j in range(0, len(row), 65_536)])
                    best[i] = first(*(np.concatenate(c) for c in zip(best[i], (row, ids[col], exact))))
                    full = np.flatnonzero(np.bincount(best[i][0], minlength=len(q)) == k)
                    last = np.searchsorted(best[i][0], full, side="right") - 1
                    least[lo + full] = np.where(np.isnan(best[i][2][last]), np.inf, best[i][2][last])
        for i, (q, doc, score) in enumerate(best):
            yield pa.record_batch([pa.array(asked[i * QUERY_BLOCK + q]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run


def sigmoid(x: Column) -> Column:
    """Without overflow at either end."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def standardised(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """columns less their mean over their population deviation, at least `floor`."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns))


def passive_aggressive(rows: DataFrame, margin: float = 1.0, epochs: int = 3, most: int = 20_000, seed: str = "pa") -> DataFrame:
    """(cls, feature, w) of online passive-aggressive training over rows (row, cls, features map).

    Starts from the classes' positive vectors (unit sums of their rows), takes unit rows, and goes through them
    `epochs` times, each in its own hash order. Each update depends on all before it, so one task must see them in
    order: the training set is bounded, the `most` rows of smallest hash. Step length: half the hinge loss.
    """

    def unit(x: dict[str, float]) -> dict[str, float]:
        norm = sum(v * v for v in x.values()) ** 0.5
        return {f: v / norm for f, v in x.items()} if norm else {}

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(str(r), c, x) for r, c, x in zip(pdf["row"], pdf["cls"], (unit(dict(x)) for x in pdf["features"])) if x]
        own.sort(key=lambda r: r[0])
        sums: dict[str, dict[str, float]] = {c: {} for c in sorted(set(pdf["cls"]))}
        for _, c, x in own:
            for f, v in x.items():
                sums[c][f] = sums[c].get(f, 0.0) + v
        weights = {c: unit(x) for c, x in sums.items()}
        for epoch in range(epochs if len(weights) > 1 else 0):
            for _, c, x in sorted(own, key=lambda r: hashlib.sha256(f"{seed}|{epoch}|{r[0]}".encode()).digest()):
                score = {k: sum(w.get(f, 0.0) * v for f, v in x.items()) for k, w in weights.items()}
                wrong = min((k for k in weights if k != c), key=lambda k: (-score[k], k))
                loss = margin - score[c] + score[wrong]
                if loss > 0:
                    for k, sign in ((c, 1.0), (wrong, -1.0)):
                        for f, v in x.items():
                            weights[k][f] = weights[k].get(f, 0.0) + sign * loss / 2 * v
        out = [(c, f, v) for c, w in weights.items() for f, v in sorted(w.items())]
        return pd.DataFrame(out, columns=["cls", "feature", "w"])

    picked = rows.select("row", "cls", "features").orderBy(F.xxhash64("row"), "row").limit(most)
    return picked.groupBy(F.lit(0).alias("all")).applyInPandas(train, "cls string, feature string, w double")


def logistic(rows: DataFrame, columns: list[str], label: str, steps: int = 800, rate: float = 0.05, l2: float = 0.01, most: int = 50_000) -> tuple[np.ndarray, DataFrame]:
    """Full-batch logistic regression with class weights, fitted on the driver; scores stay expressions over all rows.

    The fit takes at most `most` rows, those of smallest hash of their values: `most` times the columns is all that is brought together.
    """
    fitted = rows.select(*columns, F.col(label).cast("double").alias("_y")).orderBy(F.xxhash64(*columns, "_y"), *columns, "_y").limit(most).toArrow()
    x = np.stack([fitted.column(c).to_numpy() for c in columns], axis=1).astype(float)
    y = fitted.column("_y").to_numpy()
    pos, n = float((y == 1).sum()), len(y)
    weight = np.where(y == 1, n / (2.0 * max(pos, 1)), n / (2.0 * max(n - pos, 1)))
    theta = np.zeros(len(columns) + 1)
    for _ in range(steps if n else 0):
        e = weight * (1 / (1 + np.exp(-(theta[0] + x @ theta[1:]))) - y)
        g = np.r_[e.sum(), e @ x] / n
        g[1:] += l2 * theta[1:]
        theta = theta - rate * g
    score = sum((F.lit(float(w)) * F.col(c) for w, c in zip(theta[1:], columns)), F.lit(float(theta[0])))
    return theta, rows.withColumn("p", sigmoid(score))
