"""Exact removal of word passages that occur more than once, by repeated-phrase automata.

1. Anchors. Of every window of `window` words the 8-word phrase of smallest hash (leftmost at ties) is its
   anchor: equal windows have equal anchors, and about one position in fifteen is one. Anchor counts are
   added up before the shuffle; an anchor that occurs once clears all its windows.
2. Confirmation. For anchors that recur, the hashes of their windows meet under the anchor, and windows
   found twice or more are confirmed; the first of them by (row, place) represents it. Anchors with more than
   `HOT` occurrences don't meet in one task: their windows are counted where they are read, the counts are
   added up, and the occurrences meet the representatives of their anchor in several tasks, dealt by block (see 3);
   of the copies in a block the first stands for all, for they ask for the same passages.
3. Automata. Documents are dealt into blocks of about `BLOCK_WORDS` words. For every block the passages that its
   documents share with others, as far as they are confirmed, are cut out of their representatives' texts and
   shipped to it, once a block. The block compiles them into one Aho-Corasick automaton (a shard) over word
   numbers and streams all its documents through it; words inside an occurrence go. Documents bring no
   places along: what isn't found by the automaton stays.

An automaton over all passages would grow with the corpus; a shard holds what its own block can contain,
so every document meets one automaton and work stays in proportion to the text.

Defined results
- null, empty or blank text: no words, nothing removed, the hash of the empty string;
- fewer words than a window: nothing removed;
- repeated rows and equal texts: each other's copies, so every word of a text of one window or more goes;
- very long texts: blocks of their own size; word numbers have no limit;
- null doc_id: kept as a row; no rows: no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import n_partitions, staged, table

PHRASE = 8
#: Occurrences of an anchor above which its windows are counted by aggregation instead of meeting in a task.
HOT = 2000
#: Representatives up to whose number their keys are broadcast, after a count.
BROADCAST_ROWS = 2_000_000
#: Windows of a passage; longer ones are cut, each piece with all words of its windows, for automata go as deep as their passages are long.
PIECE = 1000
#: Parts that the occurrences of a hot window are dealt into.
SALT = 16
#: Words of a block, and so of an automaton; words to an anchor.
BLOCK_WORDS, SPACING = 400_000, 14
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """64-bit hashes of words, phrases and windows of a document."""

    def __init__(self, window: int) -> None:
        self.window, self.known = window, {}
        power = np.ones(1, dtype=np.uint64)
        self.powers, self.inverses = power, power

    def words(self, text: bytes | None) -> np.ndarray:
        known, digest, out = self.known, xxhash.xxh64_intdigest, []
        for w in (text or b"").split():
            h = known.get(w)
            if h is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def runs(self, h: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n consecutive words: a polynomial modulo 2**64, from prefix sums."""
        if len(h) < n:
            return np.empty(0, dtype=np.uint64)
        if len(self.powers) <= len(h):
            size = 2 * len(h) + 1
            step = np.full(size, BASE, dtype=np.uint64)
            step[0] = 1
            self.powers = np.cumprod(step, dtype=np.uint64)
            step[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.inverses = np.cumprod(step, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)])
        out = (sums[n:] - sums[:-n]) * self.inverses[: len(h) - n + 1]
        out ^= out >> np.uint64(32)
        out *= SPREAD
        return out ^ (out >> np.uint64(29))

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase hashes, and for every window the position of its anchor."""
        phrases = self.runs(h, PHRASE)
        span = self.window - PHRASE + 1
        if len(phrases) < span:
            return phrases, np.empty(0, dtype=np.int64)
        seen = np.lib.stride_tricks.sliding_window_view(phrases, span)
        at = np.concatenate([seen[i : i + 65536].argmin(axis=1) for i in range(0, len(seen), 65536)])
        return phrases, at + np.arange(len(seen))


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window)
        for b in batches:
            keys, grams, counts = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                phrases, at = hasher.anchors(hasher.words(text.as_py()))
                g, n = np.unique(phrases[np.unique(at)], return_counts=True)
                keys.append(np.full(len(g), key, dtype=np.int64))
                grams.append(g.view(np.int64))
                counts.append(n.astype(np.int32))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (grams, keys, counts)], names=["gram", "key", "n"])

    return run


def _window_rows(window: int):
    """Rows (gram, hot, key, start, hashes) of the windows whose anchors recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("gram", "hot", "key", "start", "hashes")}
            for key, text, grams, hots in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), b.column(2), b.column(3)):
                grams = np.array(grams.values, dtype=np.int64)
                order = np.argsort(grams)
                grams, hots = grams[order], np.array(hots.values.to_numpy(zero_copy_only=False), dtype=bool)[order]
                h = hasher.words(text.as_py())
                phrases, at = hasher.anchors(h)
                hashes = hasher.runs(h, window).view(np.int64)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                gram = phrases[at[starts]].view(np.int64)
                where = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                for g, hot, s, e in zip(gram.tolist(), hots[where].tolist(), starts.tolist(), np.r_[starts[1:], len(at)].tolist()):
                    if grams[np.searchsorted(grams, g) % len(grams)] != g:
                        continue
                    for name, value in zip(out, (g, hot, key, s, hashes[s:e].tobytes())):
                        out[name].append(value)
            if out["key"]:
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


NEED = "key long, rep long, delta int, low int, high int"


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, key, start, hashes) sorted by gram: (key, rep, delta, low, high), runs of windows found twice or more under a gram.

    The windows low .. high - 1 of row rep represent those of row key, delta places further on.
    """

    def flush(grams: np.ndarray, keys: np.ndarray, starts: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch | None:
        n = np.array([len(x) for x in blobs]) // 8
        h = np.frombuffer(b"".join(blobs), dtype=np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + starts[row]
        g, key = grams[row], keys[row]
        order = np.lexsort((at, key, h, g))
        first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        size = np.diff(np.r_[first, len(h)])
        hit = np.repeat(size > 1, size)
        if not hit.any():
            return None
        lead = order[np.repeat(first, size)[hit]]
        mine = order[hit]
        back = np.lexsort((at[mine], key[mine]))
        mine, lead = mine[back], lead[back]
        k, a, r, b = key[mine], at[mine], key[lead], at[lead]
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1] + 1) | (r[1:] != r[:-1]) | (b[1:] != b[:-1] + 1)])
        run = np.diff(np.r_[new, len(k)])
        return pa.record_batch([pa.array(k[new]), pa.array(r[new]), *(pa.array(x.astype(np.int32)) for x in ((a - b)[new], b[new], b[new] + run))], names=["key", "rep", "delta", "low", "high"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        gram = b.column(0).to_numpy(zero_copy_only=False)
        if size < 30_000 or gram[0] == gram[-1]:
            continue
        t = pa.Table.from_batches(held)
        gram = t.column(0).to_numpy()
        cut = int(np.searchsorted(gram, gram[-1]))
        if cut:
            s = t.slice(0, cut)
            if (out := flush(gram[:cut], s.column(1).to_numpy(), s.column(2).to_numpy(), s.column(3).to_pylist())) is not None:
                yield out
        held = t.slice(cut).to_batches()
        size = len(t) - cut
    if held:
        t = pa.Table.from_batches(held)
        if (out := flush(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist())) is not None:
            yield out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, key, start, hashes): every window hash under a gram, how often the batch has it, and its first (key, start)."""
    for b in batches:
        n = np.array([len(x) for x in b.column(3).to_pylist()], dtype=np.int64) // 8
        h = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + b.column(2).to_numpy()[row]
        g, key = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
        order = np.lexsort((at, key, h, g))
        first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(h) else order
        lead = order[first]
        yield pa.record_batch([*(pa.array(x) for x in (g[lead], h[lead], np.diff(np.r_[first, len(h)]), key[lead])), pa.array(at[lead].astype(np.int32))], names=["gram", "hash", "n", "key", "start"])


def _led(blocks: int):
    """Rows (gram, salt, lead, key, start, hashes) by gram and salt, leads first, then by key and start: NEED of the windows that have a lead.

    A lead is one window: its hash is big-endian in hashes. What several rows of a block ask for is returned once, for
    the smallest key, with a delta that keeps it apart from other runs of that key: joined to its neighbours there, it
    would not be found in the other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _led_rows(batches, blocks)

    return run


def _led_rows(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    at, leads, index, asked = None, [], None, set()
    for b in batches:
        parts = []
        for gram, salt, lead, key, start, blob in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (gram, salt) != at:
                at, leads, index, asked = (gram, salt), [], None, set()
            if lead:
                leads.append((int.from_bytes(blob, "big", signed=True), key, start))
                continue
            if not leads:
                continue
            if index is None:
                leads.sort()
                index = tuple(np.array(x, dtype=np.int64) for x in zip(*leads))
            h = np.frombuffer(blob, dtype=np.int64)
            hashes, reps, starts = index
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[place] == h)
            if not len(hit):
                continue
            rep, low = reps[place[hit]], starts[place[hit]]
            new = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (rep[1:] != rep[:-1]) | (np.diff(low) != 1)])
            size = np.diff(np.r_[new, len(hit)])
            runs = [(key % blocks, *run) for run in zip(rep[new].tolist(), low[new].tolist(), size.tolist())]
            fresh = [i for i, run in enumerate(runs) if run not in asked]
            asked.update(runs)
            if fresh:
                new, size = new[fresh], size[fresh]
                # a place of its own in the room below all true deltas, so that a run stays a passage for all that ask for it
                parts.append((np.full(len(new), key), rep[new], low[new] - (1 << 31), low[new], low[new] + size))
        if parts:
            arrays = [np.concatenate(x) for x in zip(*parts)]
            yield pa.record_batch([pa.array(x.astype(np.int64 if i < 2 else np.int32)) for i, x in enumerate(arrays)], names=["key", "rep", "delta", "low", "high"])


def n_blocks(words: int) -> int:
    """Blocks that documents of so many words are dealt into, by key."""
    return max(1, -(-words // BLOCK_WORDS))


def needs(keyed: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(rows, words): NEED, the runs of windows of keyed (key, text) whose word sequence starts elsewhere too, for every block that
    has them (hot ones once a block); and about how many words there are."""
    spark = keyed.sparkSession
    anchors = staged(keyed.mapInArrow(_anchor_rows(window), "gram long, key long, n int"), "anchors")
    words = SPACING * (anchors.agg(F.sum("n")).head()[0] or 0)
    blocks = n_blocks(words)
    recurring = anchors.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    grams = anchors.select("gram", "key").join(recurring, "gram").groupBy("key").agg(F.collect_list("gram").alias("grams"), F.collect_list(F.col("n") > HOT).alias("hots"))
    some = keyed.join(grams, "key").select("key", "text", "grams", "hots")
    rows = staged(some.mapInArrow(_window_rows(window), "gram long, hot boolean, key long, start int, hashes binary"), "windows")
    cold = rows.where("not hot").select("gram", "key", "start", "hashes").repartition(n_partitions(spark), "gram").sortWithinPartitions("gram")
    cold = cold.mapInArrow(_confirmed, NEED)
    hot = rows.where("hot").select("gram", "key", "start", "hashes", F.pmod(F.pmod("key", F.lit(blocks)), F.lit(SALT)).cast("long").alias("salt"))
    counted = hot.mapInArrow(_counted, "gram long, hash long, n long, key long, start int")
    lead = counted.groupBy("gram", "hash").agg(F.sum("n").alias("n"), F.min(F.struct("key", "start")).alias("lead")).where("n > 1")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))
    lead = lead.select("gram", salts.alias("salt"), F.lit(True).alias("lead"), "lead.key", "lead.start", F.unhex(F.lpad(F.hex("hash"), 16, "0")).alias("hashes"))
    met = lead.union(hot.select("gram", "salt", F.lit(False), "key", "start", "hashes"))
    led = met.repartition(n_partitions(spark), "gram", "salt").sortWithinPartitions("gram", "salt", F.desc("lead"), "key", "start").mapInArrow(_led(blocks), NEED)
    return cold.union(led), words


def _passages(window: int):
    """Rows (block, text, needs array<struct<key, delta, low, high>>) of representatives: the block's passages, each a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, texts = [], []
            for block, text, need in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), b.column(2)):
                words, own = text.as_py().split(), need.values
                key, delta, low, high = (own.field(i).to_numpy() for i in range(4))
                order = np.lexsort((low, delta, key))
                key, delta, low, high = key[order], delta[order], low[order], high[order]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (delta[1:] != delta[:-1]) | (low[1:] > high[:-1])])
                for x, y in {(int(low[i]), int(high[j - 1])) for i, j in zip(new, np.r_[new[1:], len(key)])}:
                    for piece in range(x, y, PIECE):
                        blocks.append(block)
                        texts.append(b" ".join(words[piece : min(y, piece + PIECE) - 1 + window]))
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["block", "text"])

    return run


def compiled(passages: list[list[bytes]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """The automaton of passages, and the numbers that stand for their words; 0 stands for all others."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words in passages:
        automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]))
    if len(automaton):
        automaton.make_automaton()
    return automaton, numbers


def covered(automaton: ahocorasick.Automaton, numbers: dict[bytes, int], words: list[bytes]) -> np.ndarray | None:
    """Which words lie in an occurrence of a passage; None if none does."""
    edge = None
    if len(automaton):
        for end, length in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
            if edge is None:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
            edge[end + 1 - length] += 1
            edge[end + 1] -= 1
    return None if edge is None else np.cumsum(edge[:-1]) > 0


def _strip(window: int, texts: bool):
    """Rows (block, passage, doc_id, text) by block, passages first: every document after its block's automaton."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, passages, shard = None, [], None
        for b in batches:
            out: list[list] = [[] for _ in names]
            for at, passage, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.large_binary())):
                if at != block:
                    block, passages, shard = at, [], None
                words = (text.as_py() or b"").split()
                if passage:
                    passages.append(words)
                    continue
                if shard is None:
                    shard, passages = compiled(passages), []
                inside = covered(*shard, words) if len(words) >= window else None
                kept = words if inside is None else [w for w, c in zip(words, inside.tolist()) if not c]
                left = b" ".join(kept)
                for column, value in zip(out, (doc_id, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            yield pa.record_batch([*arrays, *(pa.array(c, pa.binary()).cast(pa.string()) for c in out[4:])], names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = 35, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `texts`, kept_text of every row of docs."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    rows, words = needs(keyed.select("key", "text"), window)
    block = F.pmod(F.col("key"), F.lit(n_blocks(words)))
    wanted = rows.withColumn("block", block).groupBy("block", "rep").agg(F.collect_list(F.struct("key", "delta", "low", "high")).alias("needs"))
    wanted = staged(wanted, "wanted")
    names = staged(wanted.select("rep").distinct(), "reps")
    if names.count() <= BROADCAST_ROWS:  # 8 bytes each; more of them meet by a shuffle
        names = F.broadcast(names)
    reps = keyed.select(F.col("key").alias("rep"), "text").join(names, "rep", "left_semi")
    cut = wanted.join(reps, "rep").select("block", "text", "needs").mapInArrow(_passages(window), "block long, text string")
    passages = cut.select("block", F.lit(True).alias("passage"), F.lit(None).cast("long").alias("doc_id"), "text")
    both = passages.union(keyed.select(block.alias("block"), F.lit(False), "doc_id", "text"))
    dealt = both.repartition(n_partitions(docs.sparkSession), "block").sortWithinPartitions("block", F.desc("passage"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return dealt.mapInArrow(_strip(window, texts), schema)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 35, texts=False)


#: Windows of 35 words, counted over all documents; a word goes if a window over it has a count above one.
OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT rid, p, md5(array_to_string(ws[p:p + 34], ' ')) AS k FROM s),
many AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, p + unnest(range(0, 35)) AS q FROM h WHERE k IN (SELECT k FROM many)),
word AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY q) AS text, count(*) AS n FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = word.rid AND gone.q = word.q) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
