"""Bounded-space online packing of tokenised documents into fixed windows.

Each scan partition keeps `open_windows` windows. A document longer than a window gives full windows of
its own; its rest goes into the open window that it fills best; where none has room, the fullest is
emitted and a new one opened. What is open at the end of a partition is merged: the open windows of
`FAN_IN` partitions meet in one task (at most FAN_IN * open_windows of them) and are joined whole, best fit
by decreasing size. Memory doesn't grow with the input anywhere.

Tokens: the tokenizer cuts at white space, so a text's ids are those of its white-space-free chunks one
after the other; chunks are remembered per worker, up to `REMEMBERED`.

Defined results
- null or blank text: one piece with the end id alone; null doc_id: packed like any other row;
- repeated rows: packed once each; very long texts: many full windows; no rows: no rows.
- Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import n_partitions, staged, table

END_ID = 1
#: Partitions whose open windows one task merges.
FAN_IN = 64
#: Chunks whose ids a worker remembers, about 0.2 kB each; twice as many while an older set is kept.
REMEMBERED = 250_000
#: A chunk of plain letters below U+0250 (in UTF-8; without U+0130, which lowers to two) and at most one mark after them.
PLAIN = re.compile(rb"\n((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+[,.]?)(?=\n|\Z)")
_MEMO: dict[str, ChunkTokenizer] = {}


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells bytes: printable ones as themselves, the rest from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class ChunkTokenizer:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    A chunk of plain letters (below U+0250, so already composed) is one word to the tokenizer, whose
    normaliser only lowers it; its model is asked directly, which takes a third of the time. A comma or
    full stop after it is a word of its own. All other chunks take the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.marks = {m: self.whole([m])[0] for m in (b",", b".")}

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        if path not in _MEMO:
            _MEMO[path] = cls(path)
        return _MEMO[path]

    def whole(self, chunks: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def learn(self, new: set[bytes]) -> None:
        """Remembers the ids of lower-cased chunks."""
        tokenize, marks, letters = self.model.tokenize, self.marks, self.letters
        plain = PLAIN.findall(b"\n" + b"\n".join(new))
        for chunk in plain:
            core = chunk.rstrip(b",.")
            word = core.decode() if core.isascii() else core.decode().lower().encode().decode("latin-1").translate(letters)
            ids = array("I", [t.id for t in tokenize(word)]).tobytes()
            self.known[chunk] = ids if len(core) == len(chunk) else ids + marks[chunk[-1:]]
        if odd := list(new.difference(plain)):
            self.known.update(zip(odd, self.whole(odd)))

    def ids(self, text: bytes | None) -> bytes:
        if b"<|" in (text or b""):  # the tokenizer looks for its special tokens before it lowers letters
            return b"".join(self.whole(text.split()))
        chunks = (text or b"").lower().split()
        if new := set(chunks).difference(self.known):
            if len(self.known) + len(new) > REMEMBERED:
                self.older, self.known = self.known, {}
                new = set(chunks)
            unseen = new.difference(self.older)
            seen = list(new.difference(unseen))
            self.known.update(zip(seen, map(self.older.__getitem__, seen)))
            self.learn(unseen)
        return b"".join(map(self.known.__getitem__, chunks))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean, used int, part int"


def _pack(path: str, capacity: int, open_windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = ChunkTokenizer.of(path), TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4").tobytes()
        windows: list[list] = []  # [used, number, rows]
        n = 0
        done: list[tuple] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open", "used", "part"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int32(), pa.int32()] + [pa.binary()] * with_ids

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(kinds)
            done.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def close(w: list, still_open: bool) -> None:
            for row in w[2]:
                done.append((*row[:5], w[1], row[5], still_open, w[0], part, *row[6:]))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                ids = tokenizer.ids(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    size = len(piece) // 4
                    row = [doc_id, start, size, zlib.crc32(piece), total]
                    tail = [piece] * with_ids
                    fits = [w for w in windows if w[0] + size <= capacity]
                    if size < capacity and fits:
                        w = max(fits, key=lambda w: w[0])
                    else:
                        w = [0, part << 32 | n, []]
                        n += 1
                        if size < capacity:
                            if len(windows) >= open_windows:
                                fullest = max(windows, key=lambda w: w[0])
                                windows.remove(fullest)
                                close(fullest, False)
                            windows.append(w)
                    w[2].append((*row, w[0], *tail))
                    w[0] += size
                    if w[0] == capacity:
                        if size < capacity:
                            windows.remove(w)
                        close(w, False)
                if len(done) >= 20_000:
                    yield out()
        for w in windows:
            close(w, True)
        yield out()

    return run


def _merge(capacity: int):
    """Rows (team, used, window), sorted by team and falling size: where each open window goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, room, bins, rows = None, [], {}, []
        for b in batches:
            for t, used, window in zip(*(b.column(i).to_pylist() for i in range(3))):
                if t != team:
                    team, room = t, []
                at = bisect_left(room, (used, -1))
                if at < len(room):
                    free, to = room.pop(at)
                else:
                    free, to = capacity, window
                rows.append((window, to, capacity - free))
                insort(room, (free - used, to))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], names=["window", "sequence_id", "base"])
            rows = []

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_windows: int = 64, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (binary)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = staged(rows.mapInArrow(_pack(tokenizer, capacity, open_windows, with_ids), SCHEMA + ", ids binary" * with_ids), "pieces")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    full = pieces.where("not open").withColumnRenamed("window", "sequence_id").select(*keep)
    left = pieces.where("open")
    windows = left.where("offset = 0").select((F.col("part") / FAN_IN).cast("int").alias("team"), "used", "window")
    dealt = windows.repartition(n_partitions(docs.sparkSession), "team").sortWithinPartitions("team", F.desc("used"), "window")
    places = dealt.mapInArrow(_merge(capacity), "window long, sequence_id long, base long")
    moved = left.join(places, "window").withColumn("offset", F.col("offset") + F.col("base")).select(*keep)
    return full.union(moved)


def sequences(pieces: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """sequence_id, length and ids (array<int> of capacity ids, padded) from pieces packed with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32)
                out.append((len(ids), np.pad(ids, (0, capacity - len(ids)), constant_values=pad)))
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int32()))], names=["sequence_id", "length", "ids"])

    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.mapInArrow(run, "sequence_id long, length long, ids array<int>")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
