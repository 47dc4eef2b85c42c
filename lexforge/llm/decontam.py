"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words (2**18 buckets, each task's counts added up before the shuffle)
   over all documents give the TF-IDF weights.
2. The benchmark's items are cut into passages of at most `WINDOW` words. Their TF-IDF matrix goes through a
   distributed randomised SVD: from a seeded Gaussian start, rounds of Z = A'(A Q) are summed over
   partitions by feature, the driver orthonormalises Z (features of the benchmark by `RANK`, bounded by
   `FEATURES`), and a Rayleigh-Ritz step gives the right singular vectors V.
3. Every document is scanned whole in windows of `WINDOW` words, `STRIDE` apart. A window goes on if the
   benchmark's features hold enough of its weight for the cosine to be reached at all, is folded into the
   latent space, and meets all passages of a block of items; pairs of cosine >= `COSINE` are candidates.
   Passages of which `RANK` directions hold less than `HELD` of the norm (a block may have more passages
   than directions) meet every window by their exact TF-IDF cosine too, over postings of all their words.
4. A candidate is a leak if, in some stretch of the text as long as the item, the longest common
   subsequence of words holds `COPIED` of the item, or `REWORDED` of it and the answer (the item's last
   sentence) too. Near copies and reworded copies keep the order of most words; texts on like topics don't.

Items are a query set: the SVD is of a block of at most `BLOCK` items, and up to `BLOCKS_A_PASS` blocks are
searched in one pass over the documents. Items shorter than `LEAST` words say too little for a cosine; they
are leaks where the run of their words stands in a text as it is.

Words: A-Z lower-cased, punctuation at the ends off.

Defined results
- null, empty or blank text or item: no words, no leak; null doc_id or item_id: kept as they are;
- items shorter than `LEAST` words: exact runs only (cosine and share 1, answer found); repeated rows and
  items: a row for each pair;
- no documents or no items: no rows; further columns are not read (clean returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import n_partitions, staged, table

BUCKETS = 1 << 18
WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, ROUNDS = 256, 8, 3
HELD = 0.999
FEATURES = 1 << 17
BLOCK = 10_000
BLOCKS_A_PASS = 8
LEAST = 6
COSINE = 0.35
COPIED, REWORDED, ANSWERED = 0.7, 0.5, 0.8
EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
REMEMBERED = 250_000
#: Multiplier of the keys of short runs.
RUN_BASE = 0x9E3779B97F4A7C15
#: Words taken together in one batch of matrix work.
CHUNK = 200_000


def tokens(text: bytes | None) -> list[bytes]:
    return [c for w in (text or b"").lower().split() if (c := w.strip(EDGE))]


def word_hash(core: bytes) -> int:
    return xxhash.xxh64_intdigest(core)


#: What a chunk without a word hashes to once its punctuation is off.
NO_WORD = np.uint64(xxhash.xxh64_intdigest(b""))


def hashed(chunks: Iterable[bytes]) -> np.ndarray:
    """Word hash of every lower-cased chunk; NO_WORD for those of punctuation only."""
    return np.fromiter(map(xxhash.xxh64_intdigest, map(bytes.strip, chunks, repeat(EDGE))), dtype=np.uint64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency by bucket, and the number of documents; at most BUCKETS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, known = np.zeros(BUCKETS + 1, dtype=np.int64), 0, {}
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                n += 1
                chunks = set((t.as_py() or b"").lower().split())
                if new := chunks.difference(known):
                    if len(known) + len(new) > REMEMBERED:
                        known.clear()
                        new = chunks
                    h = hashed(new)
                    known.update(zip(new, np.where(h == NO_WORD, BUCKETS, h % np.uint64(BUCKETS)).tolist()))
                df[list(set(map(known.__getitem__, chunks)))] += 1
        at = np.flatnonzero(df[:BUCKETS])
        yield pa.record_batch([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], n])], names=["bucket", "df"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, count = rows.column("bucket").to_numpy(), rows.column("df").to_numpy()
    df = np.zeros(BUCKETS, dtype=np.int64)
    df[bucket[bucket >= 0]] = count[bucket >= 0]
    return df, int(count[bucket < 0].sum())


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Word weights: the square of the usual logarithm, so that common words hardly make texts alike."""
    return ((np.log((1.0 + n) / (1.0 + df)) + 0.05) ** 2).astype(np.float32)


def cut(words: list[bytes], window: int = WINDOW) -> list[list[bytes]]:
    """Passages of at most `window` words, half a window apart, the last at the end."""
    if len(words) <= window:
        return [words]
    starts = [*range(0, len(words) - window, window // 2), len(words) - window]
    return [words[s : s + window] for s in starts]


def passages(items: DataFrame) -> DataFrame:
    """(item_id, no, words array<long>): word hashes of every passage of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, no, np.array([word_hash(w) for w in p], dtype=np.uint64).view(np.int64).tolist()) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())) if len(w := tokens(t.as_py())) >= LEAST for no, p in enumerate(cut(w))]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], names=["item_id", "no", "words"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, no int, words array<long>")


def _vectors(words: list[np.ndarray], features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature place, weight) of unit TF-IDF rows over sorted feature hashes."""
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    h = np.concatenate(words) if words else np.empty(0, dtype=np.int64)
    place = np.minimum(np.searchsorted(features, h), len(features) - 1)
    ok = features[place] == h
    row, place = row[ok], place[ok]
    cell, n = np.unique(row * len(features) + place, return_counts=True)
    row, place = cell // len(features), cell % len(features)
    weight = n * idf[features.view(np.uint64)[place] % np.uint64(BUCKETS)]
    norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=len(words)))
    return row, place, weight / np.maximum(norm[row], 1e-12)


def latent_basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes sorted, V): right singular vectors of the TF-IDF matrix of passages `rows`."""
    spark = rows.sparkSession
    picked = rows.select(F.explode("words").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "h").limit(FEATURES)
    features = np.sort(picked.select("h").toArrow().column(0).to_numpy())
    if not len(features):
        return features, np.zeros((0, 0), dtype=np.float32)
    size = min(rank + OVERSAMPLE, len(features))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(features), size)))[0].astype(np.float32)
    for last in [False] * (ROUNDS - 1) + [True]:
        shared = spark.sparkContext.broadcast((features, idf, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, idf, q = shared.value
            z: dict[int, np.ndarray] = {}
            for b in batches:
                row, place, weight = _vectors([np.array(w.values, dtype=np.int64) for w in b.column(0)], features, idf)
                if not len(row):
                    continue
                y = np.zeros((b.num_rows, q.shape[1]), dtype=np.float64)
                np.add.at(y, row, weight[:, None] * q[place])
                order = np.argsort(place, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
                sums = np.add.reduceat(weight[order, None] * y[row[order]], first, axis=0)
                for p, s in zip(place[order][first].tolist(), sums):
                    z[p] = z[p] + s if p in z else s
            yield pa.record_batch([pa.array(list(z), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in z.values()], pa.binary())], names=["place", "z"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for b in batches:
                done = []
                for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    v = np.frombuffer(v, dtype="<f8")
                    if p == at:
                        total = total + v
                    else:
                        if at is not None:
                            done.append((at, total.tobytes()))
                        at, total = p, v
                yield pa.record_batch([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], names=["place", "z"])
            if at is not None:
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["place", "z"])

        parts = rows.select("words").mapInArrow(run, "place int, z binary").repartition(n_partitions(spark), "place").sortWithinPartitions("place")
        got = parts.mapInArrow(add, "place int, z binary").toArrow()
        z = np.zeros((len(features), size))
        z[got.column("place").to_numpy()] = np.frombuffer(b"".join(got.column("z").to_pylist()), dtype="<f8").reshape(-1, size)
        shared.unpersist()
        if last:
            values, vectors = np.linalg.eigh(q.T.astype(np.float64) @ z)
            order = np.argsort(-values)[:rank]
            q = (q @ vectors[:, order[values[order] > 1e-9]]).astype(np.float32)
        else:
            q = np.linalg.qr(z)[0].astype(np.float32)
    return features, q


class Postings:
    """Unit TF-IDF passages by word, for exact cosines with windows."""

    def __init__(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, columns: np.ndarray, n_features: int):
        """Of the passages (row, place, weight), those numbered in `columns`."""
        self.columns = columns
        ours = np.isin(row, columns)
        order = np.argsort(place[ours], kind="stable")
        self.passage = np.searchsorted(columns, row[ours][order])
        self.weight = weight[ours][order].astype(np.float32)
        self.first = np.searchsorted(place[ours][order], np.arange(n_features + 1))
        self.most = np.zeros(n_features + 1, dtype=np.float32)  # the last for words that no passage has
        np.maximum.at(self.most, place[ours][order], self.weight)

    def products(self, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(windows, passages): products of windows, given by the places and weights of their words."""
        r, c = np.nonzero(weight)
        f = place[r, c]
        size = self.first[f + 1] - self.first[f]
        at = np.repeat(self.first[f] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(r, size) * len(self.columns) + self.passage[at]
        return np.bincount(cell, np.repeat(weight[r, c], size) * self.weight[at], len(place) * len(self.columns)).reshape(len(place), -1)

    def lift(self, cosine: np.ndarray, place: np.ndarray, weight: np.ndarray, norm: np.ndarray) -> None:
        """Raises the cosines (windows, all passages) of these passages to the exact ones that reach COSINE.

        Words that together can't bring any passage to COSINE open no posting: a pair that reaches it shares one of the others.
        """
        need = COSINE * (1 - 1e-5) * norm
        bound = weight * self.most[place]
        able = np.flatnonzero(bound.sum(axis=1) >= need)
        for lo in range(0, len(able), step := max(1, (1 << 21) // len(self.columns))):
            r = able[lo : lo + step]
            order = np.argsort(bound[r], axis=1)
            rising = np.cumsum(np.take_along_axis(bound[r], order, axis=1), axis=1)
            skip = np.zeros(rising.shape, dtype=bool)
            np.put_along_axis(skip, order, rising < need[r, None], axis=1)
            part = self.products(place[r], np.where(skip, 0, weight[r]))
            rest = (bound[r] * skip).sum(axis=1)
            r = r[(part >= (need[r] - rest)[:, None]).any(axis=1)]
            if len(r):
                full = self.products(place[r], weight[r]) / norm[r, None]
                cell = np.ix_(r, self.columns)
                cosine[cell] = np.maximum(cosine[cell], np.where(full >= COSINE, full, -1))


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of a longest common subsequence, by bit-parallel rows."""
    where: dict[bytes, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer(words: list[bytes], text: bytes) -> list[bytes]:
    """Words of an item's last sentence; its last eight words if there is one sentence only."""
    parts = [t for s in text.replace(b"!", b".").replace(b"?", b".").split(b".") if (t := tokens(s))]
    return parts[-1] if len(parts) > 1 else words[-8:]


def judge(item: list[bytes], reply: list[bytes], text: list[bytes], at: int) -> tuple[float, bool]:
    """Best share of the item in a stretch of the text around word `at`, and whether the answer is there too."""
    size = len(item) + len(item) // 4 + 2
    low, high = max(0, at - len(item)), min(len(text), at + WINDOW + len(item))
    best, place = 0.0, low
    if lcs(item, text[low:high]) < REWORDED * len(item):  # no stretch of it has more
        return best, False
    for start in range(low, max(low + 1, high - size + 1 + 3), 4):
        share = lcs(item, text[start : start + size]) / len(item)
        if share > best:
            best, place = share, start
    found = lcs(reply, text[max(0, place - 4) : place + size + 4]) >= ANSWERED * len(reply)
    return best, found


@dataclass
class Block:
    """A block of items, ready to meet windows. Words go by their place in the pass's vocabulary, -1 for others."""

    folds: np.ndarray  # word -> row of the basis, or -1
    v: np.ndarray
    latent: np.ndarray  # passages by direction
    owners: np.ndarray  # passage -> number among items
    exact: Postings
    items: list[tuple]  # (item_id, words, answer)

    @classmethod
    def of(cls, items: list[tuple], features: np.ndarray, v: np.ndarray, every: np.ndarray, idf: np.ndarray) -> Block:
        cuts = [(i, hashes(p)) for i, (_, words, _) in enumerate(items) for p in cut(words)]
        row, at, weight = _vectors([w for _, w in cuts], every, idf)
        folds = np.full(len(every) + 1, -1)
        folds[np.searchsorted(every, features)] = np.arange(len(features))
        latent = np.zeros((len(cuts), v.shape[1]), dtype=np.float32)
        inside = folds[at] >= 0
        np.add.at(latent, row[inside], weight[inside, None].astype(np.float32) * v[folds[at[inside]]])
        held = np.linalg.norm(latent, axis=1)
        latent /= np.maximum(held, 1e-9)[:, None]
        return cls(folds, v, latent, np.array([i for i, _ in cuts]), Postings(row, at, weight, np.flatnonzero(held < HELD), len(every)), items)

    def near(self, place: np.ndarray, weight: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, number of the item, cosine) of the pairs that reach COSINE."""
        inner = self.folds[place]
        held = np.where(inner >= 0, weight, 0)
        folded = np.zeros((len(place), self.v.shape[1]), dtype=np.float32)
        for c in range(WINDOW):
            folded += self.v[np.maximum(inner[:, c], 0)] * held[:, c, None]
        cos = (folded / norm[:, None].astype(np.float32)) @ self.latent.T
        if len(self.exact.columns):
            self.exact.lift(cos, place, weight, norm)
        r, c = np.nonzero(cos >= np.float32(COSINE))
        return r, self.owners[c], cos[r, c]


class Runs:
    """Items shorter than LEAST words, found where the run of their words stands as it is."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        """Of (item_id, places of its words)."""
        self.by_size: dict[int, tuple[np.ndarray, list]] = {}
        for n in {len(w) for _, w in items}:
            same = [(i, w) for i, w in items if len(w) == n]
            keys = self.keys(np.array([w for _, w in same]))
            order = np.argsort(keys, kind="stable")
            self.by_size[n] = keys[order], [same[o] for o in order]

    @staticmethod
    def keys(runs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(runs), dtype=np.uint64)
        for c in range(runs.shape[1]):
            out = (out + (runs[:, c].astype(np.int64) + 1).view(np.uint64)) * np.uint64(RUN_BASE)
        return out

    def of(self, place: np.ndarray) -> Iterator[tuple[int, int]]:
        """(number of a word, item_id) of every occurrence among the places of many texts, set apart by words of place -1."""
        for n, (keys, items) in self.by_size.items():
            if len(place) < n:
                continue
            able = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(place, n).min(axis=1) >= 0)
            runs = place[able[:, None] + np.arange(n)]
            mine = self.keys(runs)
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for i in np.flatnonzero(high > low):
                for item_id, words in items[low[i] : high[i]]:
                    if np.array_equal(words, runs[i]):
                        yield int(able[i]), item_id


def hashes(words: list[bytes]) -> np.ndarray:
    return np.array([word_hash(w) for w in words], dtype=np.uint64).view(np.int64)


LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_ratio", pa.float64()), ("answer_found", pa.bool_())])


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, idf, blocks, short = shared.value
        places = {h: i + 1 for i, h in enumerate(every.view(np.uint64).tolist())}
        weigh = np.r_[idf, np.float32(0)]  # the last for the padding between texts
        shift, pad = np.int64(BUCKETS.bit_length()), np.full(WINDOW, BUCKETS, dtype=np.int64)
        low_bits = np.int64((1 << BUCKETS.bit_length()) - 1)
        known: dict[bytes, int] = {}  # chunk -> (place + 1) << shift | bucket; -1 without a word

        def coded(chunks: list[bytes]) -> np.ndarray:
            if new := set(chunks).difference(known):
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set(chunks)
                h = hashed(new)
                place = np.fromiter(map(places.get, h.tolist(), repeat(0)), dtype=np.int64, count=len(h))
                known.update(zip(new, np.where(h == NO_WORD, -1, place << shift | (h % np.uint64(BUCKETS)).astype(np.int64)).tolist()))
            out = np.fromiter(map(known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            return out[out >= 0]

        def leaks(rows: list[tuple]) -> list[tuple]:
            parts, starts, owner, offsets, at = [], [], [], [], 0
            for k, (_, words, _) in enumerate(rows):
                parts += [words, pad]
                s = np.arange(at, at + max(1, len(words) - WINDOW + STRIDE), STRIDE)
                starts.append(s)
                owner.append(np.full(len(s), k))
                offsets.append(at)
                at += len(words) + WINDOW
            code = np.concatenate(parts)
            place, weight = (code >> shift) - 1, weigh[code & low_bits]
            start, owner = np.concatenate(starts), np.concatenate(owner)
            square = weight.astype(np.float64) ** 2
            total = np.r_[0, np.cumsum(square)]
            inside = np.r_[0, np.cumsum(np.where(place >= 0, square, 0))]
            all_, ours = (x[start + WINDOW] - x[start] for x in (total, inside))
            go = ours >= COSINE * COSINE * np.maximum(all_, 1e-12)
            go &= ours > 0
            start, owner = start[go], owner[go]
            found: dict[tuple[int, int, int], list[tuple[float, int]]] = {}
            for lo in range(0, len(start), 2048):
                s = start[lo : lo + 2048]
                cells = s[:, None] + np.arange(WINDOW)
                p, w = place[cells], np.where(place[cells] >= 0, weight[cells], 0)
                norm = np.sqrt(total[s + WINDOW] - total[s])
                for n, block in enumerate(blocks):
                    for r, i, cos in zip(*(x.tolist() for x in block.near(p, w, norm))):
                        found.setdefault((int(owner[lo + r]), n, i), []).append((cos, int(s[r])))
            out, texts = [], {}
            for (k, n, i), hits in sorted(found.items()):
                doc_id, _, text = rows[k]
                if k not in texts:
                    texts = {k: tokens(text)}
                item_id, item, reply = blocks[n].items[i]
                best = (False, 0.0, False)
                for cos, s in sorted(hits, reverse=True):
                    share, has = judge(item, reply, texts[k], s - offsets[k])
                    best = max(best, (share >= COPIED or share >= REWORDED and has, share, has))  # a leak before a larger share without the answer
                    if share >= COPIED:
                        break
                if best[0]:
                    out.append((doc_id, item_id, max(c for c, _ in hits), best[1], best[2]))
            exact = {(int(np.searchsorted(offsets, word, "right")) - 1, item_id) for word, item_id in short.of(place)}
            out += [(rows[k][0], item_id, 1.0, 1.0, True) for k, item_id in sorted(exact, key=lambda x: (x[0], x[1] is None, x[1] or 0))]
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*leaks(rows))) or [()] * 5
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, LEAK)], schema=LEAK)

        rows, size = [], 0
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                text = t.as_py() or b""
                words = coded(text.lower().split())
                if not len(words):
                    continue
                rows.append((doc_id, words, text))
                size += len(words)
                if size >= CHUNK:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, rank: int = RANK, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_found): a row for every leak of an item into a document."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_found boolean"
    df, n = frequencies(docs)
    idf = idf_of(df, n)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found, n_blocks = None, max(1, -(-items.count() // block))
    for first in range(0, n_blocks, BLOCKS_A_PASS):
        parts, short = [], []
        for k in range(first, min(n_blocks, first + BLOCKS_A_PASS)):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
            read = [(r["item_id"], w, answer(w, t)) for r in own.toArrow().to_pylist() if (w := tokens(t := (r["text"] or "").encode()))]
            short += [(i, w) for i, w, _ in read if len(w) < LEAST]
            if long := [x for x in read if len(x[1]) >= LEAST]:
                parts.append((long, *latent_basis(staged(passages(own), "passages"), idf, rank)))
        words = {w for long, _, _ in parts for _, x, _ in long for w in x} | {w for _, x in short for w in x}
        if not words:
            continue
        every = np.sort(hashes(list(words)))
        blocks = [Block.of(long, features, v, every, idf) for long, features, v in parts]
        runs = Runs([(i, np.searchsorted(every, hashes(w))) for i, w in short])
        part = texts.mapInArrow(_search(spark.sparkContext.broadcast((every, idf, blocks, runs))), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, all columns as they are."""
    bad = staged(find_leaks(docs, items).select(F.col("doc_id").alias("_leaked")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"] == bad["_leaked"], "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs_ratio", 4).alias("lcs_ratio"), "answer_found")
