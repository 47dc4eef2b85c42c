"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``radius`` bits are, in at least one
segment, within ``radius // segments`` bits (pigeonhole). Every fingerprint enters each segment's table
under the segment's value and all values one bit away; two values at most two bits apart then meet
under a common key, so balls of radius 1 on both sides answer a radius of 2 at 33 keys, not 529, for a
segment of 32 bits. What meets under a key is verified on the complete distance.

`deduplicate` links the texts whose Jaccard similarity on five-word shingles is `SIMILAR` or more, all of them and no others.
Fingerprints of 256 bits, cut into six segments of 21 bits with balls as above, find most: of what meets
under the keys of a batch within `WIDE` bits a minimum spanning forest by distance goes on, and for each of its
trees a star around the fingerprint nearest to the bitwise majority, which in a group of copies is the
original, so a group of thousands costs edges in proportion to its size, not pairs. Every edge is compared on its shingles.

A forest drops pairs before they are compared, and segments miss some, so a second pass completes the links. Two sets
of similarity t share a shingle among the first n - ceil(t n) + 1 of each, in any order that is the same for all. Such
prefixes, rare shingles first, meet by shingle; pairs that the first pass has not linked already, and that sizes and
places don't exclude, are compared on their shingles too.

Defined results
- null, empty or blank text: no shingle, fingerprint 0, linked like any other;
- fewer words than a shingle: one shingle of all words;
- equal texts, repeated rows: same fingerprint, same component; equal shingles: similarity 1; null doc_id: row kept, never the
  smallest id unless its component has no other; deduplicate keeps the smallest doc_id of a group, of equal
  doc_ids one row;
- ties in distance: the pair of smaller fingerprints first;
- no rows: no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import connected_components, lean, n_partitions, small_batches, staged, table

SEED = 42
#: Runs up to this length are compared by shifting whole batches; longer ones one by one.
SHORT_RUN = 48
#: Jaccard similarity of near duplicates; bits of 256 within which fingerprints are worth a comparison.
SIMILAR, WIDE = 0.8, 50
#: Segments of a wide fingerprint: three of 21 bits in each of its first two words.
WIDE_SEGMENTS, WIDE_BITS = 6, 21
#: Runs of wide fingerprints up to this length are compared pair by pair.
SHORT_WIDE_RUN = 16
#: Texts (about) whose shingles tell which are common, and the common ones at most: they order prefixes, results don't depend on them.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 1 << 18
#: Rows of a slice where batches are joined until runs are whole.
RUNS = 1 << 14
#: Comparisons of one text that meet in a task; texts with more are copied to several.
HUB = 256
#: Odd multipliers that spread a shingle's hash over four words.
LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
LOW_BITS = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None, words: int = 4, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles of `words` words, A-Z lower-cased."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), seed)
    h = np.array([digest(x, seed) for x in map(b" ".join, zip(*(w[i:] for i in range(words))))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t, words) for t in b.column(1).cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n segments of 64 bits."""
    base, more, at, out = 64 // n, 64 % n, 0, []
    for i in range(n):
        width = base + (i < more)
        out.append((at, width))
        at += width
    return out


def _link_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints of a run that chains of links connect: a star a component.

    Breadth-first over the not yet reached: every fingerprint is compared to those left over only.
    """
    left, a, b = np.unique(fps), [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 22) // len(left))
            block, front = front[:step], front[step:]
            near = (np.bitwise_count(block[:, None] ^ left[None, :]) <= radius).any(axis=0)
            got, left = left[near], left[~near]
            a.append(np.full(len(got), root, dtype=np.uint64))
            b.append(got)
            front = np.concatenate([front, got])
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forest_places(ab: np.ndarray) -> list[int]:
    """Of edges, the places of those that connect what the ones before them don't: fewer than there are nodes."""
    parent: dict[int, int] = {}
    keep = []
    for i, (a, b) in enumerate(ab.tolist()):
        while (p := parent.get(a, a)) != a:
            parent[a] = parent.get(p, p)
            a = p
        while (p := parent.get(b, b)) != b:
            parent[b] = parent.get(p, p)
            b = p
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(i)
    return keep


def _edges(radius: int):
    """mapInArrow over rows (key, fp) sorted by key: verified edges between what meets under a key."""

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
            yield _link_run(fp[s : s + n], radius)
        short = np.repeat(lengths <= SHORT_RUN, lengths)
        key, fp = key[short], fp[short]
        for o in range(1, SHORT_RUN):
            same = key[o:] == key[:-o]
            if not same.any():
                break
            x, y = fp[:-o][same], fp[o:][same]
            near = (x != y) & (np.bitwise_count(x ^ y) <= radius)
            yield x[near], y[near]

    def rows(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = [p for p in found(key, fp) if len(p[0])]
        if pairs:
            ab = np.unique(np.sort(np.stack([np.concatenate([p[i] for p in pairs]) for i in (0, 1)], axis=1), axis=1), axis=0)
            ab = ab[_forest_places(ab)]
            yield pa.record_batch([pa.array(ab[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((key, fp.view(np.uint64)))
            size += len(key)
            if size < 1 << 18 or key[0] == key[-1]:
                continue
            k, f = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            cut = int(np.searchsorted(k, k[-1]))  # the last run may go on
            yield from rows(k[:cut], f[:cut])
            held, size = [(k[cut:], f[cut:])], len(k) - cut
        if held:
            yield from rows(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))

    return run


def links(fps: DataFrame, radius: int = 4, segments: int = 2) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) whose components are those of all pairs
    within `radius` bits. Needs radius // segments <= 2."""
    if not 0 <= radius // segments <= 2 or not 2 <= segments <= 64:
        raise ValueError("balls of radius 1 on both sides reach two bits a segment")
    ball = []
    for s, (shift, width) in enumerate(_segments(segments)):
        mask = (1 << width) - 1
        ball += [f"named_struct('s', {s}L, 'shift', {shift}, 'mask', {mask}L, 'flip', {flip}L)" for flip in [0, *((1 << i) for i in range(width))]]
    probe = fps.select("fp", F.expr(f"explode(array({', '.join(ball)}))").alias("p"))
    keyed = probe.select(F.expr("shiftleft(p.s, 58) | ((shiftrightunsigned(fp, p.shift) & p.mask) ^ p.flip)").alias("key"), "fp")
    spark = fps.sparkSession
    dealt = keyed.repartition(n_partitions(spark) * 2, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that chains of links reach."""
    own = staged(fingerprints(docs, words), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(classes.select("fp"), radius, segments)
    roots = connected_components(edges)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    to = named.select("fp", "root").join(first, "root").select("fp", "component_id")
    return own.join(to, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole text if it has fewer words; none without words."""
    w = (text or b"").lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(w[i:] for i in range(words))))], dtype=np.uint64)


def wide_fingerprint(text: bytes | None, words: int = 5) -> bytes:
    """256-bit SimHash: each shingle's hash is spread over four words."""
    return _majority(shingle_hashes(text, words))


def _majority(h: np.ndarray) -> bytes:
    if not len(h):
        return bytes(32)
    ones = np.zeros((8, 32), dtype=np.int64)  # by bit of a byte and byte
    for at in range(0, len(h), 1 << 15):
        x = h[at : at + (1 << 15), None] * LANES
        x ^= x >> np.uint64(29)
        x *= LANES[::-1]
        x ^= x >> np.uint64(32)
        starts = np.arange(0, len(x), 255)  # so many ones a byte holds
        for bit in range(8):
            ones[bit] += np.add.reduceat((x >> np.uint64(bit)) & LOW_BITS, starts, axis=0).view(np.uint8).reshape(-1, 32).sum(axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > len(h)).T.reshape(-1), bitorder="little").tobytes()


def _nearest(front: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of left: the place of its nearest in front, and their distance."""
    best, at = np.full(len(left), 999), np.zeros(len(left), dtype=np.int64)
    step = max(1, (1 << 20) // max(1, len(left)))
    for lo in range(0, len(front), step):
        d = np.bitwise_count(front[lo : lo + step, None] ^ left[None]).sum(axis=2, dtype=np.int64)
        own = d.argmin(axis=0)
        least = d[own, np.arange(len(left))]
        at[least < best] = own[least < best] + lo
        best = np.minimum(best, least)
    return at, best


def _wide_run(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a long run: breadth first from the fingerprint nearest to the bitwise majority, each by its nearest in the front."""
    left = np.unique(fps, axis=0)
    while len(left) > 1:
        bits = np.unpackbits(left.view(np.uint8), axis=1).mean(axis=0) > 0.5
        centre = np.packbits(bits).view(np.uint64)
        root = int(np.bitwise_count(left ^ centre).sum(axis=1).argmin())
        front, left = left[root : root + 1], np.delete(left, root, axis=0)
        while len(front) and len(left):
            at, d = _nearest(front, left)
            near = d <= radius
            yield front[at[near]], left[near]
            front, left = left[near], left[~near]


def _stars(fps: np.ndarray, ab: np.ndarray, radius: int) -> np.ndarray:
    """(distance, a, b) within radius between the middle of each tree of the forest ab and its other nodes."""
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[ab[:, 0]], root[ab[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[ab[:, 0]], low)
        np.minimum.at(root, root[ab[:, 1]], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(root[order]) > 0])
    out = [np.empty((0, 3), dtype=np.int64)]
    for own in np.split(order, first[1:]):
        if len(own) > 2:
            bits = np.unpackbits(fps[own].view(np.uint8), axis=1).mean(axis=0) > 0.5
            middle = own[np.bitwise_count(fps[own] ^ np.packbits(bits).view(np.uint64)).sum(axis=1).argmin()]
            d = np.bitwise_count(fps[own] ^ fps[middle]).sum(axis=1, dtype=np.int64)
            near = own[(d <= radius) & (own != middle)]
            out.append(np.c_[d[(d <= radius) & (own != middle)], np.minimum(near, middle), np.maximum(near, middle)])
    return np.concatenate(out)


def _wide_edges(radius: int):
    """mapInArrow over rows (key, fp of 32 bytes) sorted by key: (a, b, distance) of a minimum spanning forest of what meets within radius."""

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[lengths > SHORT_WIDE_RUN], lengths[lengths > SHORT_WIDE_RUN]):
            yield from _wide_run(fp[s : s + n], radius)
        short = np.repeat(lengths <= SHORT_WIDE_RUN, lengths)
        key, fp = key[short], fp[short]
        for o in range(1, SHORT_WIDE_RUN):
            same = np.flatnonzero(key[o:] == key[:-o])
            if not len(same):
                break
            x, y = fp[same], fp[same + o]
            near = np.bitwise_count(x ^ y).sum(axis=1) <= radius
            yield x[near], y[near]

    def rows(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = [p for p in found(key, fp) if len(p[0])]
        if not pairs:
            return
        x, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
        names, place = np.unique(np.ascontiguousarray(np.r_[x, y]).view("V32").reshape(-1), return_inverse=True)
        ends = np.sort(place.reshape(2, -1), axis=0)
        cells = np.unique(np.c_[d, ends[0], ends[1]][ends[0] != ends[1]], axis=0)  # by distance, then fingerprints
        if len(cells):
            cells = cells[_forest_places(cells[:, 1:])]
            cells = np.unique(np.r_[cells, _stars(names.view(np.uint64).reshape(-1, 4), cells[:, 1:], radius)], axis=0)
            yield pa.record_batch([*(pa.array([bytes(v) for v in names[cells[:, c]]], pa.binary()) for c in (1, 2)), pa.array(cells[:, 0].astype(np.int32))], names=["a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(-1, 4)))
            size += b.num_rows
            if size < 1 << 18 or held[-1][0][0] == held[-1][0][-1]:
                continue
            k, f = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            cut = int(np.searchsorted(k, k[-1]))  # the last run may go on
            yield from rows(k[:cut], f[:cut])
            held, size = [(k[cut:], f[cut:])], len(k) - cut
        if held:
            yield from rows(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))

    return run


def wide_links(fps: DataFrame, radius: int = WIDE) -> DataFrame:
    """(a, b, d): candidate edges between distinct fingerprints of 32 bytes (column fp)."""
    mask = (1 << WIDE_BITS) - 1
    ball = []
    for s in range(WIDE_SEGMENTS):
        word, shift = divmod(s, WIDE_SEGMENTS // 2)
        ball += [f"named_struct('s', {s}L, 'w', {word}, 'shift', {shift * WIDE_BITS}, 'flip', {flip}L)" for flip in [0, *((1 << i) for i in range(WIDE_BITS))]]
    words = [F.conv(F.hex(F.substring("fp", 8 * w + 1, 8)), 16, -10).cast("long").alias(f"w{w}") for w in (0, 1)]
    probe = fps.select("fp", *words).select("fp", "w0", "w1", F.expr(f"explode(array({', '.join(ball)}))").alias("p"))
    keyed = probe.select(F.expr(f"shiftleft(p.s, 58) | ((shiftrightunsigned(if(p.w = 0, w0, w1), p.shift) & {mask}L) ^ p.flip)").alias("key"), "fp")
    # keys of one segment that begin alike share a task, so that copies meet in few tasks: a quarter as many beginnings as tasks
    parts = n_partitions(fps.sparkSession)
    block = F.expr(f"shiftrightunsigned(key, {WIDE_BITS - min(WIDE_BITS, max(1, parts.bit_length() - 2))})")
    dealt = keyed.repartition(parts, block).sortWithinPartitions("key")
    return dealt.mapInArrow(lean(_wide_edges(radius), RUNS), "a binary, b binary, d int")


def _least(n: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """The smallest whole number of at least t n."""
    return -(-n * t.numerator // t.denominator)


def _prefix(u: np.ndarray, common: np.ndarray, count: np.ndarray, t: Fraction) -> np.ndarray:
    """Of a set of shingles (sorted), rare ones first, so many that every set of similarity t shares one of them."""
    if not len(u):
        return u
    if len(common):
        at = np.minimum(np.searchsorted(common, u), len(common) - 1)
        u = u[np.argsort(np.where(common[at] == u, count[at], 0), kind="stable")]
    return u[: len(u) - _least(len(u), t) + 1]


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; texts that have them) of the shingles most common in about ORDER_TEXTS texts (_k1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).cast(pa.large_binary()):
                yield pa.record_batch([pa.array(np.unique(shingle_hashes(x.as_py(), words)).view(np.int64))], names=["h"])

    some = texts.where(F.pmod("_k1", F.lit(max(1, texts.count() // ORDER_TEXTS))) == 0).select("text")
    found = some.mapInArrow(lean(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _prefix_pairs(t: Fraction):
    """mapInArrow over rows (key, node, root, n, place) sorted by key: (a, b) of different roots that the sizes of
    their sets and the places of the first shingle they share leave a similarity of t."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (root, n, place), (root2, n2, place2) = x[..., 2:].T, y[..., 2:].T
        both = _least(n + n2, t / (1 + t))
        return (root != root2) & (place + both <= n) & (place2 + both <= n2)

    def found(rows: np.ndarray) -> Iterator[np.ndarray]:
        key = rows[:, 0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        for s, size in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
            own = rows[s : s + size]
            if (own[:, 2] == own[0, 2]).all():
                continue
            own = own[np.argsort(own[:, 3], kind="stable")]
            ends = np.searchsorted(own[:, 3] * t.numerator, own[:, 3] * t.denominator, side="right")  # larger ones can't be alike
            for i in range(size - 1):
                late = own[i + 1 : ends[i]]
                late = late[near(own[i], late)]
                yield np.c_[np.full(len(late), own[i, 1]), late[:, 1]]
        rows = rows[np.repeat(lengths <= SHORT_RUN, lengths)]
        for o in range(1, SHORT_RUN):
            same = np.flatnonzero(rows[o:, 0] == rows[:-o, 0])
            if not len(same):
                break
            x, y = rows[same], rows[same + o]
            ok = near(x, y)
            yield np.c_[x[ok, 1], y[ok, 1]]

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ab = np.concatenate([np.empty((0, 2), dtype=np.int64), *(p for p in found(rows) if len(p))])
        if len(ab):
            ab = np.unique(np.sort(ab, axis=1), axis=0)
            yield pa.record_batch([pa.array(ab[:, i].copy()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1).astype(np.int64))
            size += b.num_rows
            if size < 1 << 18 or held[-1][0, 0] == held[-1][-1, 0]:
                continue
            rows = np.concatenate(held)
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last run may go on
            yield from pairs(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
        if held:
            yield from pairs(np.concatenate(held))

    return run


def _alike(t: Fraction):
    """mapInArrow over rows (a, b, x, y), x and y sorted distinct shingle hashes: the pairs whose Jaccard similarity is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.asarray(v.values) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * t.denominator >= t.numerator * (len(x) + len(y) - both))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _parities(u: np.ndarray) -> bytes:
    """Of a set of shingles, the parity of those under each low end of their hash, as many as shingles (a power of two)."""
    size = max(64, 1 << (len(u) - 1).bit_length()) if len(u) else 64
    return np.packbits(np.bincount((u & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _within(t: Fraction):
    """mapInArrow over rows (a, b, n, n2, x, y), x and y parities: the pairs that parities leave a similarity of t: sets differ in at least as many shingles."""

    def folded(v: bytes, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(np.frombuffer(v, dtype=np.uint64).reshape(-1, size // 8), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            apart = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                size = min(len(x), len(y))
                apart.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
            keep = np.array(apart, dtype=np.int64) <= n + n2 - 2 * _least(n + n2, t / (1 + t))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Of pairs (a, b) of nodes (node, n, bits, _k1, _k2 of one of its rows) those whose Jaccard similarity is t or more."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), words)).view(np.int64) for x in b.column(1).cast(pa.large_binary())]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    def ends(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("node")).union(p.select("b")).groupBy("node").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("copies"))

    hubs = staged(ends(pairs).where("copies > 1"), "hubs")
    copies = F.coalesce("copies", F.lit(1))

    def beside(p: DataFrame, end: str, other: str, what: DataFrame) -> DataFrame:
        """p with the columns that what has for one end; what meets a hub is dealt over its copies."""
        p = p.join(hubs.withColumnRenamed("node", end), end, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies)).drop("copies")
        s = what.join(hubs, "node", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
        return p.join(s.withColumnRenamed("node", end), [end, "copy"]).drop("copy")

    both = beside(beside(pairs, "a", "b", nodes.select("node", "n", F.col("bits").alias("x"))), "b", "a", nodes.select("node", F.col("n").alias("n2"), F.col("bits").alias("y")))
    pairs = staged(both.select("a", "b", "n", "n2", "x", "y").mapInArrow(lean(_within(t)), "a long, b long"), "within")
    one = staged(nodes.select("node", "_k1", "_k2").join(ends(pairs).select("node"), "node"), "ends")
    sets = texts.select("_k1", "_k2", "text").join(one, ["_k1", "_k2"]).select("node", "text").dropDuplicates(["node"])
    sets = staged(sets.mapInArrow(lean(shingles), "node long, set array<long>"), "shingles")
    both = beside(beside(pairs, "a", "b", sets.withColumnRenamed("set", "x")), "b", "a", sets.withColumnRenamed("set", "y"))
    return both.select("a", "b", "x", "y").mapInArrow(lean(_alike(t)), "a long, b long")


def _keys() -> list[Column]:
    """Two hashes of doc_id and text, which together stand for a row."""
    text = F.col("text").cast("string")
    return [F.xxhash64("doc_id", text).alias("_k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("_k2")]


def similar_groups(docs: DataFrame, words: int = 5, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): (_k1, _k2, doc_id, fp, ...) of every row of docs, and (node, root) of the fp that links connect; root: a number.

    fp: the wide fingerprint and 16 bytes that stand for the set of shingles. Linked are texts whose Jaccard similarity is `similar` or more.
    """
    t = Fraction(str(similar))
    texts = docs.select(*_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(texts, words))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, bits, prefixes = [], [], [], []
            for x in b.column(3).cast(pa.large_binary()):
                h = shingle_hashes(x.as_py(), words)
                u = np.unique(h)
                fps.append(_majority(h) + xxhash.xxh3_128_digest(u.tobytes()))
                sizes.append(len(u))
                bits.append(_parities(u))
                prefixes.append(_prefix(u, *common.value, t).view(np.int64))
            more = [pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.record_batch([*b.columns[:3], *more], names=["_k1", "_k2", "doc_id", "fp", "n", "bits", "prefix"])

    rows = staged(texts.mapInArrow(lean(prints), "_k1 long, _k2 long, doc_id long, fp binary, n long, bits binary, prefix array<long>"), "wide")
    nodes = rows.select("fp", "_k1", "_k2", "n", "bits", "prefix").dropDuplicates(["fp"]).withColumn("node", F.monotonically_increasing_id())
    nodes = staged(nodes.withColumn("wide", F.substring("fp", 1, 32)), "nodes")
    # what the fingerprints find: the sets under one fingerprint, and the edges between fingerprints
    first = staged(nodes.groupBy("wide").agg(F.min("node").alias("node")), "first")
    met = staged(wide_links(first.select(F.col("wide").alias("fp"))), "met").select("a", "b").distinct()
    number = lambda side: first.select(F.col("wide").alias(side), F.col("node").alias(f"{side}_node"))
    met = met.join(number("a"), "a").join(number("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    under_one = nodes.select("wide", F.col("node").alias("b")).join(first, "wide").where("node <> b").select(F.col("node").alias("a"), "b")
    own = connected_components(_verified(staged(met.union(under_one), "candidates"), nodes, texts, words, t))
    # the rest: pairs that share a shingle of their prefixes
    have = nodes.join(own, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", F.posexplode("prefix").alias("place", "key"))
    dealt = have.select("key", "node", "root", "n", F.col("place").cast("long")).repartition(n_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    rest = staged(dealt.mapInArrow(lean(_prefix_pairs(t), RUNS), "a long, b long").distinct(), "open")
    linked = connected_components(_verified(rest, nodes, texts, words, t).union(own.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    linked = linked.union(linked.select("root", "root").distinct())  # a root stands for itself too
    return rows, linked.join(nodes, "node").select(F.col("fp").alias("node"), "root")


def deduplicate(docs: DataFrame, words: int = 5, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of every group of near duplicates: the one of smallest doc_id (null last)."""
    with small_batches(docs.sparkSession):
        rows, roots = similar_groups(docs, words, similar)
    group = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("_k1", "_k2", "doc_id", F.col("root"), F.when(F.col("root").isNull(), F.col("fp")).alias("alone"))
    first = group.groupBy("root", "alone").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_k1", "_k2")).alias("s"))
    kept = staged(first.select("s._k1", "s._k2"), "kept")
    gone = staged(rows.select("_k1", "_k2").join(kept, ["_k1", "_k2"], "left_anti").distinct(), "gone")
    again = staged(rows.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_k1", "_k2").join(kept, ["_k1", "_k2"], "left_semi"), "again")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *_keys()).join(gone, ["_k1", "_k2"], "left_anti")
    once = keyed.join(again, ["_k1", "_k2"], "left_anti").select("_row")
    repeated = keyed.join(again, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("_row").alias("_row")).select("_row")
    return once.union(repeated).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
