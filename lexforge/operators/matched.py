"""BM25 of a stated query set in two passes over the documents, without postings of the words that nobody asks for.

Pass 1 counts, in every document, the terms of all queries, and the document's length; their document frequencies and
the average length are added up on the way. Pass 2 weighs the counts and multiplies them, some rows at a time, with
the queries' terms; a task passes on the first k of each query, which the first k of all are among.

Distinct tokens of a batch are taken apart once each, so that features of tokens (character n-grams, stems) cost
little more than tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.index import B, EXACT_BOOST, K1
from lexforge.operators.store import BROADCAST_ROWS, built, small, stored, written

#: Cells of the matrix of terms and queries up to which this is done; beyond, the compiled index answers.
CELLS = 8_000_000
#: Cells of a block of documents and terms; tokens that a worker remembers.
BLOCK, REMEMBERED = 4_000_000, 300_000


def _counts(numbers: dict[str, int], features: Callable[[str], list[str]]):
    """Rows (doc_id, exact, tokens) to (stat, doc_id, exact, n, dl, terms, tfs); of every batch one row with stat: documents, lengths and document frequencies."""
    n_terms = len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            tokens = b.column(2)
            size = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            own, at = [], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for word in coded.dictionary.to_pylist():
                got = known.get(word)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    all_ = features(word)
                    got = known[word] = ([numbers[f] for f in all_ if f in numbers], len(all_))
                own.append(got)
            row = np.repeat(np.arange(b.num_rows), size)
            lengths = np.bincount(row, weights=np.array([n for _, n in own], dtype=np.float64)[at] if own else None, minlength=b.num_rows).astype(np.int64)
            hits = np.array([len(x) for x, _ in own], dtype=np.int64)
            flat = np.array([f for x, _ in own for f in x], dtype=np.int64)
            first = np.cumsum(hits) - hits
            asked = hits[at] > 0 if len(at) else np.empty(0, dtype=bool)
            cells, times = np.unique(row[asked] * max(1, len(own)) + at[asked], return_counts=True)
            row, at = cells // max(1, len(own)), cells % max(1, len(own))
            step, found = max(1, BLOCK // max(1, n_terms)), []
            for low in range(0, b.num_rows, step):
                lo, hi = np.searchsorted(row, (low, low + step))
                n = hits[at[lo:hi]]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[lo:hi]], n)
                code = np.repeat(row[lo:hi] - low, n) * n_terms + flat[place]
                sums = np.bincount(code, weights=np.repeat(times[lo:hi], n))
                some = np.flatnonzero(sums)
                found.append((some + low * n_terms, sums[some]))
            code, tf = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            term = code % n_terms if n_terms else code
            ends = np.searchsorted(code, np.arange(b.num_rows + 1) * n_terms) if n_terms else np.zeros(b.num_rows + 1, dtype=np.int64)
            df = np.bincount(term, minlength=n_terms)
            seen = np.flatnonzero(df)
            lists = lambda values, more: pa.ListArray.from_arrays(pa.array(np.r_[ends, ends[-1] + len(more)].astype(np.int32)), pa.array(np.r_[values, more].astype(np.int32)))
            one = lambda array, last: pa.concat_arrays([array, pa.array([last], array.type)])
            yield pa.record_batch(
                [
                    pa.array([False] * b.num_rows + [True]), one(b.column(0), None), one(b.column(1), None), pa.array(np.r_[np.ones(b.num_rows, dtype=np.int64), b.num_rows]),
                    pa.array(np.r_[lengths, lengths.sum()]), lists(term, seen), lists(tf, df[seen]),
                ],
                names=["stat", "doc_id", "exact", "n", "dl", "terms", "tfs"],
            )

    return run


def _best(query: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by falling score and rising doc."""
    order = np.lexsort((doc, -score, query))
    query, score, doc = query[order], score[order], doc[order]
    new = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, dtype=np.int64)
    place = np.arange(len(query)) - np.repeat(new, np.diff(np.r_[new, len(query)]))
    return tuple(x[place < k] for x in (query, score, doc))


def _scores(asked: list[np.ndarray], ids: list, idf: np.ndarray, avgdl: float, k: int, digits: int):
    """Rows (doc_id, exact, dl, terms, tfs) to the task's first k (query_id, doc_id, score) of each query."""
    at_id = {q: i for i, q in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((len(idf), len(ids)))
        for i, terms in enumerate(asked):
            matrix[terms, i] = 1
        none, held = np.empty(0, dtype=np.int64), []
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            size = np.diff(b.column(3).offsets.to_numpy())
            term, tf = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy().astype(np.float64)
            dl = np.repeat(b.column(2).to_numpy().astype(np.float64), size)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / max(avgdl, 1e-9)))
            ends, exact = np.r_[0, np.cumsum(size)], b.column(1)
            also = np.flatnonzero(exact.is_valid().to_numpy(zero_copy_only=False))
            step = max(1, BLOCK // max(1, len(idf), len(ids)))
            for low in range(0, b.num_rows, step):
                high = min(low + step, b.num_rows)
                block = np.zeros((high - low, len(idf)))
                lo, hi = ends[low], ends[high]
                block[np.repeat(np.arange(high - low), size[low:high]), term[lo:hi]] = weight[lo:hi]
                total = block @ matrix
                for i in also[(also >= low) & (also < high)]:
                    for q in exact[int(i)].as_py():
                        total[i - low, at_id[q]] += EXACT_BOOST
                shown = np.floor(total * 10**digits + 0.5) / 10**digits
                shown[total <= 0] = -1
                least = np.maximum(np.partition(shown, -k, axis=0)[-k] if high - low > k else 0, 0)
                row, query = np.nonzero(shown >= least)
                held.append(_best(query, shown[row, query], doc[low:high][row], k))
            if len(held) > 20:
                held = [_best(*(np.concatenate(x) for x in zip(*held)), k)]
        query, score, doc = _best(*(np.concatenate(x) for x in zip(*held)), k) if held else (none, none.astype(float), none)
        yield pa.record_batch([pa.array([ids[q] for q in query.tolist()], pa.int64()), pa.array(doc.astype(np.int64)), pa.array(score.astype(np.float64))], names=["query_id", "doc_id", "score"])

    return run


def top(docs: DataFrame, queries: DataFrame, k: int, features: Callable[[str], list[str]] = lambda w: [w], exact: bool = False, digits: int = 6, source: DataFrame | None = None, also: DataFrame | None = None) -> DataFrame | None:
    """(query_id, doc_id, score, rank): the first k documents of every query by rounded score and doc_id.

    docs (doc_id, tokens) and queries (query_id, tokens); with `exact` both have surfaces, whose equality adds the boost.
    With `source`, the table that docs are made of, the counts are stored for all calls of the same terms; the terms of
    the queries `also` are then counted too. None, where the queries are too many for it, or where doc_id isn't unique.
    """
    own = queries.select("query_id", "tokens", *(["surface"] * exact))
    if own.select(F.explode("tokens")).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS or own.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    wanted: dict[int, set[str]] = {}
    for q, tokens in own.select("query_id", "tokens").collect():
        wanted.setdefault(q, set()).update(f for w in set(tokens) for f in features(w))
    ids = sorted(wanted)
    terms = set().union(*wanted.values())
    if also is not None:
        terms |= {f for r in also.select(F.explode("tokens").alias("w")).distinct().collect() for f in features(r.w)}
    numbers = {f: i for i, f in enumerate(sorted(terms))}
    if len(ids) * len(numbers) > CELLS:
        return None

    def build() -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens", *(["surface"] * exact))
        same = F.lit(None).cast("array<long>").alias("exact")
        if exact:
            equal = own.where("surface is not null").groupBy("surface").agg(F.collect_set(F.col("query_id").cast("long")).alias("exact"))
            rows, same = rows.join(small(equal), "surface", "left"), F.col("exact")
        return rows.select("doc_id", same, "tokens").mapInArrow(_counts(numbers, features), "stat boolean, doc_id long, exact array<long>, n long, dl long, terms array<int>, tfs array<int>")

    if source is None:
        counted = written(build(), "matched")
    else:
        name = "matched-" + hashlib.sha256("\n".join(numbers).encode()).hexdigest()[:16]
        equal_to = queries if also is None else also
        if "surface" in equal_to.columns:  # its table also serves where no surface is asked for
            said = sorted(map(repr, equal_to.select("query_id", "surface").collect()))
            surfaces = f"{name}-surfaces-{hashlib.sha256(chr(10).join(said).encode()).hexdigest()[:16]}"
            name = surfaces if exact or built(source, surfaces) else name
        counted = stored(source, name, build)
    plain = counted.where("not stat")
    n, distinct = plain.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).head()
    if n != distinct:
        return None
    stats = counted.where("stat")
    length = stats.agg(F.sum("dl")).head()[0] or 0
    df = np.zeros(len(numbers))
    for term, count in stats.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs")).collect():  # one row for each term of the queries
        df[term] = count
    asked = [np.array(sorted(numbers[f] for f in wanted[q]), dtype=np.int64) for q in ids]
    score = _scores(asked, ids, np.log(1 + (n - df + 0.5) / (df + 0.5)), length / max(n, 1), k, digits)
    equal = F.col("exact") if exact else F.lit(None).cast("array<long>").alias("exact")
    best = plain.select("doc_id", equal, "dl", "terms", "tfs").mapInArrow(score, "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
