"""Awkward rows that every operator must take."""

from __future__ import annotations

import random

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "r", "ll") for c in ("a", "e", "o", "um", "is")]


def prose(n: int, seed: int, sentence: int = 12) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if i % sentence == sentence - 1 else "") for i in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)."""
    base = prose(120, 1)
    shared = prose(60, 2)
    lines = "\n".join(prose(9, 100 + i) for i in range(12))
    texts = [
        base, base, base.replace(WORDS[3], "changed", 1), base + " tail",  # copies and near copies
        None, "", " \t\n ", "one", "two words",  # hardly any text
        prose(80, 3) + " " + shared + " " + prose(50, 4), shared + " " + prose(70, 5), prose(30, 6) + " " + shared,  # a shared passage
        lines, prose(20, 7) + "\n" + lines, lines + "\n\n" + prose(15, 8),  # shared runs of lines
        prose(30_000, 9), "x" * 200_000, "\n".join(["same line here"] * 3000),  # very long
        "Ünï çödé — 東京     ß ﬁ 👍 " * 10, "<|endoftext|> <|STARTOFTEXT|> İstanbul don't can't",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t) if t else 0) for i, t in enumerate(texts)]
    rows.append((0, base, "en", "s", len(base)))  # a row twice
    rows.append((None, prose(60, 10), None, None, None))
    rows.append((None, base, None, None, None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of names that operators use themselves.
CLASHES = ["shard", "slot", "size", "fp", "key", "hash", "bucket", "place", "n_lines", "component_id", "row", "_row", "at", "gone", "severity", "stratum", "sequence_id"]
