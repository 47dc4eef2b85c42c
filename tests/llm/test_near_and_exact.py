"""SimHash, substring and line dedup against brute force."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexforge.llm import _common, linededup, queries, simhash, substring
from tests.compare import connect, difference
from tests.llm import cases

SPLIT = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split((text or "").encode()) if w]


def brute_fingerprint(text, k=4):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, near):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = [r for r in df.select("doc_id", "text").collect() if len(r.text or "") < 50_000]
    small = df.where(F.length(F.coalesce("text", F.lit(""))) < 50_000)
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min((r.doc_id for r, x in zip(rows, comp) if x == c and r.doc_id is not None), default=None) for c in set(comp)}
    want = Counter((r.doc_id, np.uint64(f).view(np.int64).item(), least[c]) for r, f, c in zip(rows, fps, comp))
    assert Counter(map(tuple, simhash.near_duplicates(small).select("doc_id", "fp", "component_id").collect())) == want


def test_links_of_a_dense_group(spark):
    """A run far longer than SHORT_RUN, with links through chains only."""
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.cumsum(np.ones(1)).astype(np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64)), rng.integers(0, 1 << 62, 300).astype(np.uint64)]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 4, 2).collect()
    have = components(list(range(len(fps))), lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 4)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    linked = {(at[e.a], at[e.b]) for e in edges} | {(at[e.b], at[e.a]) for e in edges}
    got = components(list(range(len(fps))), lambda i, j: (i, j) in linked)
    assert [[have[i] == have[j] for j in range(i)] for i in range(len(fps))] == [[got[i] == got[j] for j in range(i)] for i in range(len(fps))]


def test_deduplicate_keeps_one_of_each_group(docs, clashing, empty):
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(0) == 1 and 1 not in ids and {9, 10, 12} <= set(ids)
    assert simhash.deduplicate(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def shingles(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)} - {b""}


def test_wide_fingerprint_is_a_majority():
    for text in ("", "one", "a b c d e", cases.prose(700, 3)):
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in ([b" ".join(words(text)[i : i + 5]) for i in range(len(words(text)) - 4)] or [b" ".join(words(text))] if text else [])], dtype=np.uint64)
        x = h[:, None] * simhash.LANES
        x ^= x >> np.uint64(29)
        x *= simhash.LANES[::-1]
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(h), 32), axis=1, bitorder="little")
        assert simhash.wide_fingerprint(text.encode()) == np.packbits(2 * bits.sum(axis=0) > len(h), bitorder="little").tobytes()


def test_near_copies_equal_brute_force(spark):
    """Pairs of similarity 0.8 or more are found but for one in ten, and nothing far below is linked; a big group is held together."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(150):
        base = cases.prose(200, 2000 + i).split()
        texts.append(" ".join(base))
        for changes in rng.integers(1, 12, 2):
            copy = list(base)
            for at in rng.integers(0, 200, changes):
                copy[at] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    hub = cases.prose(300, 77).split()
    for _ in range(200):
        copy = list(hub)
        for at in rng.integers(0, 300, 5):
            copy[at] = f"new{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, roots = simhash.similar_groups(df)
    group = {r.doc_id: r.fp if r.root is None else r.root for r in rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").collect()}
    sets = [shingles(t) for t in texts]
    alike = lambda a, b, least=0.8: len(a & b) >= least * len(a | b)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    want = components(sets, lambda a, b: alike(a, b, 0.72))  # what SURE bits may still take for 0.8
    assert np.mean([group[i] == group[j] for i, j in pairs]) >= 0.9
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if group[i] == group[j])
    assert len({group[i] for i in range(450, len(texts))}) <= 5


def test_groups_are_those_of_exact_similarity(spark, monkeypatch):
    """Pairs that segments miss, that a forest drops for nearer ones, and that repeated lines set apart are linked, those below 0.8 under like fingerprints are not."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(120):  # one passage replaced: similarities around 0.8
        base = cases.prose(100, 5000 + i).split()
        texts.append(" ".join(base))
        for size in rng.integers(3, 9, 3):
            at = rng.integers(0, 100 - size)
            texts.append(" ".join([*base[:at], *(f"new{rng.integers(1 << 30)}" for _ in range(size)), *base[at + size :]]))
    for i in range(20):
        base, line = cases.prose(80, 7000 + i), "one line that comes again and again " * 60
        texts += [f"{base} {line}", f"{base} {line[: len(line) // 30]}", f"{cases.prose(80, 8000 + i)} {line}"]
    texts += ["", " ", "a b", "A  b", "a b c", *["licence line of eight words in every text"] * 3, "the licence line of eight words in every text"]
    sets = [shingles(x) for x in texts]
    want = components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for short in (simhash.SHORT_RUN, 2):
        monkeypatch.setattr(simhash, "SHORT_RUN", short)
        monkeypatch.setattr(simhash, "HUB", short)
        rows, roots = simhash.similar_groups(df)
        group = {r.doc_id: r.fp if r.root is None else r.root for r in rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").collect()}
        assert [[want[i] == want[j] for j in range(i)] for i in range(len(texts))] == [[group[i] == group[j] for j in range(i)] for i in range(len(texts))]
        assert {r.doc_id for r in simhash.deduplicate(df).select("doc_id").collect()} == {min(i for i in range(len(texts)) if want[i] == c) for c in set(want)}


def test_near_dedup_hands_python_small_batches(spark, monkeypatch):
    """30 MB of texts in one partition never lie in one batch; the session's setting comes back."""
    rows = [(i, cases.prose(1500, i)) for i in range(200)]
    df = spark.createDataFrame([(200 * k + i, f"{k} {x}") for k in range(15) for i, x in rows], "doc_id long, text string").repartition(1)
    whole, most = type(df).mapInArrow, 3 * (_common.BATCH_MB << 20)
    assert df.agg(F.sum(F.length("text"))).head()[0] > 2 * most

    def watched(self, f, *a, **b):
        def run(batches):
            def small():
                for x in batches:
                    if x.nbytes > most:
                        raise MemoryError(f"a batch of {x.nbytes} bytes")
                    yield x

            yield from f(small())

        return whole(self, run, *a, **b)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    before = spark.conf.get(_common.BATCH_CONF, None)
    assert {r.doc_id for r in simhash.deduplicate(df).select("doc_id").collect()} == set(range(200))
    assert spark.conf.get(_common.BATCH_CONF, None) == before


def test_lean_passes_all_rows_and_leaves_no_memory():
    anonymous = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    sizes, pinned = [], []

    def run(batches):
        for b in batches:
            sizes.append(b.num_rows)
            freed = [b"%d" % i * 200 for i in range(150_000)]
            pinned.append(freed[-1])  # what lies below it isn't given back by itself
            del freed
            yield b

    batches = [pa.record_batch([pa.array(range(n), pa.int64())], names=["x"]) for n in (7, 0, 3)]
    _common.trim()
    before = anonymous()
    list(run(iter(batches[:1])))
    assert anonymous() - before > 100
    got = list(_common.lean(run, 3)(iter(batches)))
    assert sizes == [7, 3, 3, 1, 3] and pa.Table.from_batches(got) == pa.Table.from_batches(batches)
    assert anonymous() - before < 50


def brute_repeats(rows, window):
    counts = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in rows:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 2000])
def test_substring(monkeypatch, clashing, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BLOCK_WORDS", 500)
    rows = [(r.doc_id, words(r.text)) for r in clashing.select("doc_id", "text").collect()]
    assert Counter(map(tuple, substring.remove_repeats(clashing, 35, texts=False).collect())) == brute_repeats(rows, 35)


def test_automata_find_what_goes(monkeypatch, docs):
    """Without the automata nothing goes; a block's automaton finds passages wherever they stand."""
    shard = substring.compiled([b"a b c".split(), b"b c d".split()])
    assert substring.covered(*shard, b"x a b c d x b c d".split()).tolist() == [False, True, True, True, True, False, True, True, True]
    assert substring.covered(*shard, b"a b d".split()) is None and substring.covered(*substring.compiled([]), [b"a"]) is None
    some = docs.where("doc_id in (9, 10, 11)")
    assert some.count() == 3 and substring.remove_repeats(some).where("n_removed > 0").count() == 3
    monkeypatch.setattr(substring, "_passages", lambda window: lambda batches: iter(()))
    assert substring.remove_repeats(some).where("n_removed > 0").count() == 0


def test_millions_of_words(spark, monkeypatch):
    words = [b"%x" % i for i in range(2_000_000)]
    pieces = [words[i : i + 1034] for i in range(0, 1_500_000, 1000)]
    assert substring.covered(*substring.compiled([words[-40:], *pieces]), words).sum() == 1_500_000 + 34 + 40
    monkeypatch.setattr(substring, "PIECE", 7)
    texts = [cases.prose(300, 1), cases.prose(40, 2) + " " + cases.prose(300, 1) + " end"]
    out = substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(r.doc_id, r.n_removed) for r in out.orderBy("doc_id").collect()] == [(0, 300), (1, 300)]


def test_substring_texts(docs, empty):
    row = substring.remove_repeats(docs.where("doc_id = 10 or doc_id = 11")).where("doc_id = 11").head()
    assert row.kept_text == cases.prose(30, 6) and row.n_removed == 60
    assert substring.remove_repeats(empty).count() == 0


def brute_lines(rows, m=2, long=50):
    """rows: distinct (doc_id, text); text -> kept text."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    full = {k: [(p, strip(x)) for p, x in enumerate(t.split("\n")) if strip(x)] for k, t in rows.items()}
    seen, gone = {}, {k: set() for k in rows}
    for k in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1])):
        for i, (p, x) in enumerate(full[k]):
            run = tuple(y for _, y in full[k][i : i + m])
            if len(run) == m and seen.setdefault(run, (k, i)) != (k, i):
                gone[k].update(q for q, _ in full[k][i : i + m])
            if len(words(x)) >= long and seen.setdefault(x, (k, i)) != (k, i):
                gone[k].add(p)
    return {k: (len(full[k]), len(gone[k]), "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k])) for k, t in rows.items()}


@pytest.mark.parametrize(("m", "long"), [(2, 50), (3, 50), (2, 9)])
def test_lines(clashing, empty, m, long):
    rows = clashing.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null").collect()
    want = brute_lines({(r.doc_id, r.h): r.text for r in rows}, m, long)
    out = linededup.dedup_lines(clashing, m, long)
    assert set(out.columns) == set(clashing.columns) | {"n_removed"}
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.where("text is not null").collect())
    assert got == Counter((r.doc_id, *want[r.doc_id, r.h]) for r in rows)
    assert out.where("doc_id = 4").head().text is None
    short = linededup.dedup_lines(clashing, m, long, depth=m)
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in short.where("text is not null").collect()) == got
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.runs(clashing).where("doc = 13").head().n_lines == 12


def test_levels_are_the_suffix_array(spark):
    """At every length: who shares a prefix, in the order of the line ids' pairs; doubling ends with the repeats."""
    texts = ["\n".join(x) for x in ("abcabcabd", "zabcabc", "qq", "", "abcabcabd", "aaaaaaa")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = {i: t.split("\n") if t else [] for i, t in enumerate(texts)}
    lengths = []
    for n, level in linededup.levels(df):
        lengths.append(n)
        have = Counter(tuple(x[i : i + n]) for x in lines.values() for i in range(len(x) - n + 1))
        rank = {(r.doc, r.i): r["rank"] for r in level.collect()}
        assert set(rank) == {(d, i) for d, x in lines.items() for i in range(len(x) - n + 1) if have[tuple(x[i : i + n])] > 1}
        by = {}
        for (d, i), r in rank.items():
            assert by.setdefault(r, tuple(lines[d][i : i + n])) == tuple(lines[d][i : i + n])
        assert len(set(by.values())) == len(by)
    assert lengths == [1, 2, 4, 8]
    n = {(r.doc, r.i): r.n for r in linededup.later_copies(df).collect()}
    assert n[4, 0] == 8 and n[4, 1] == 8 and n[1, 1] == 4 and n[5, 1] == 4 and n[5, 5] == 2 and (0, 0) not in n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name], connect(sf_dir)) == ""


def test_hot_windows_are_asked_for_once_a_block():
    """Copies under a hot anchor cost a row a block and run, whatever their number."""
    import pyarrow as pa

    def rows(n):
        h = np.arange(3, dtype=np.int64)
        leads = [(1, 0, True, 0, i, int(x).to_bytes(8, "big", signed=True)) for i, x in enumerate(h)]
        held = leads + [(1, 0, False, k, 5, h.tobytes()) for k in range(n)] + [(1, 0, False, n, 0, h[1:].tobytes())]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["gram", "salt", "lead", "key", "start", "hashes"])

    for n in (10, 1000):
        out = [tuple(x.values()) for b in substring._led(2)(iter([rows(n)])) for x in b.to_pylist()]
        assert out == [(0, 0, -(1 << 31), 0, 3), (1, 0, -(1 << 31), 0, 3), (n, 0, 1 - (1 << 31), 1, 3)]


def test_hot_windows_between_other_neighbours(spark, monkeypatch):
    """Hot runs that one row of a block has beside others than the next row."""
    monkeypatch.setattr(substring, "HOT", 1)
    part = [cases.prose(90, 900 + i) for i in range(4)]
    own = iter(range(2000, 3000))
    texts = [" ".join(part[i] if i is not None else cases.prose(40, next(own)) for i in order) for order in ([0, 1], [1, 2], [0, 1, 2], [2, 3], [None, 1, None, 3], [3, 0], [2], [1, None], [None, 2, 1]) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substring.remove_repeats(df, 35, texts=False).collect())) == brute_repeats([(i, words(t)) for i, t in enumerate(texts)], 35)
