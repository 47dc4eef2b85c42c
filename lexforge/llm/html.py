"""Main text of web pages by nearest-URL page differencing.

1. Every page is cut into text lines, one a block, and leaves (host, path, hashes of its lines).
2. Pages in the order (host, path, url) get their global rank: a range sort of these small rows, whose
   partition sizes are added up. Blocks of `BLOCK` ranks, each with the `NEAR` pages before and after it,
   are differenced: a page is paired with the `NEAR` pages of nearest path on its host (longest common
   beginning, then nearest rank), and the lines of each pair are aligned by longest common subsequence. A
   host of any size spreads over many blocks, and ranks don't depend on partitions.
3. A line beside the article (<article>, <main>; the whole page where there is none) goes if a neighbour shares
   it. A line of the article goes if all of three or more witnesses share it, which is what a site puts into
   every story; a paragraph that a few stories share is their text and stays. A neighbour that is a copy is
   no witness: one with the very same lines, or, for the article, with over half of its characters.
4. Mark-up is the second check: lines within nav, header, footer, aside, form and the like, and hidden ones,
   go; so do lines of an element of which a whole class, id, role or aria-label is made up of words like menu,
   advert or comments, where no neighbour could tell because their text is the page's own. html, body, main
   and article go by hidden only. On a host of one page the article decides alone.

Defined results
- null or empty html, or nothing but template: empty text, 0 characters;
- null url: never paired (host is empty); null page_id: kept; equal rows are one page, and each gets its text;
- cut-off mark-up: an unfinished tag, quote, comment, script or style runs to the end of the page;
- ties between neighbours: all of them count alike; very long pages: alignment by bit rows, no square memory;
- no rows: no rows; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import n_partitions, staged, table
from .urlfilter import parts

#: Pages that a page is compared with, and ranks of a block.
NEAR, BLOCK = 4, 128
#: Witnesses that it takes to delete a line of the article.
WITNESSES = 3
#: Pairs of equal lines above which an alignment goes by bit rows.
MATCHES = 200_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|object|math|canvas|audio|video)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-z][a-z0-9-]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[^\W\d_]+")
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "col", "source", "area", "base", "embed", "param", "track"}
WHOLE = {"html", "body", "main", "article"}
TEMPLATE = set("nav header footer aside form menu dialog button fieldset head".split())
NAMED = set(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus footer"
    " gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup print promo promoted promotion recommended related reply replies"
    " respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar tooltip topbar widget widgets complementary contentinfo alert".split()
)


def named(attributes: str, tag: str = "") -> bool:
    """Whether the element is hidden, or a whole class, id, role or label names something other than main text."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            return True
        if name in ("class", "id", "role", "aria-label") and tag not in WHOLE:
            for token in [value] if name == "aria-label" else value.split():
                if (words := WORD.findall(token)) and NAMED.issuperset(words):
                    return True
    return False


def lines_of(html: str | None) -> list[tuple[str, bool, bool]]:
    """(line, in an article, named as template) of every block with text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in an article, template
    open_tags: Counter[str] = Counter()  # of the stack; "" counts entries in an article
    piece: list[str] = []
    article = template = False

    def flush() -> None:
        if piece:
            line = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if line:
                out.append((line, article, template))

    def drop(size: int) -> tuple[str, bool, bool]:
        while len(stack) > size:
            t, a, _ = stack.pop()
            open_tags[t] -= 1
            open_tags[""] -= a
        return stack[-1] if stack else ("", False, False)

    at, html = 0, html or ""
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            piece.append(" ")
        block = tag in BLOCKS
        if block:
            flush()
        if tag in VOID:
            continue
        if m[2]:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not block and stack[i][2] and not (i and stack[i - 1][2]):
                        flush()  # an inline element of the template ends
                    _, article, template = drop(i)
                    break
            continue
        attributes = m[4]
        marked = bool(attributes) and named(attributes, tag)
        if tag == "p" and stack and stack[-1][0] == "p":
            _, article, template = drop(len(stack) - 1)
        if tag in ("article", "main") and not marked:
            # an article starts anew: what was left open before it doesn't hold it
            article, template = True, any(open_tags[t] for t in ("nav", "aside", "footer")) or (template and open_tags[""] > 0)
        elif marked or tag in TEMPLATE and not (tag == "header" and article):
            if not block and not template:
                flush()
            template = True
        elif not block:
            continue
        stack.append((tag, article, template))
        open_tags[tag] += 1
        open_tags[""] += article
    if at < len(html):
        piece.append(html[at:])
    flush()
    return out


def _by_matches(a: list[int], b: list[int], where: dict[int, list[int]]) -> set[int]:
    """Places in a of a longest common subsequence, by increasing runs over the matches (Hunt and Szymanski)."""
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a with each beginning of b, by bit rows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b.

    Equal beginnings and ends are taken off. Few matches go by increasing runs; many (pages that repeat a
    line) by halving a where both halves' bit rows add up to most (Hirschberg), with memory for one row.
    """
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            found.add(lo)
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            found.add(hi - 1)
            hi, high = hi - 1, high - 1
        if lo == hi or low == high:
            continue
        mine, theirs = a[lo:hi], b[low:high]
        where: dict[int, list[int]] = {}
        for j in range(len(theirs) - 1, -1, -1):
            where.setdefault(theirs[j], []).append(j)
        if hi - lo == 1 or sum(len(where.get(x, ())) for x in mine) <= MATCHES:
            found.update(lo + i for i in _by_matches(mine, theirs, where))
            continue
        half = len(mine) // 2
        ahead, behind = _lengths(mine[:half], theirs), _lengths(mine[half:][::-1], theirs[::-1])[::-1]
        at = int((ahead + behind).argmax())
        todo += [(lo, lo + half, low, low + at), (lo + half, hi, low + at, high)]
    return found


def hashes(lines: list[tuple[str, bool, bool]]) -> list[int]:
    return [xxhash.xxh64_intdigest(x[0]) >> 1 for x in lines]


def template_lines(own: list[int], article: list[int], size: list[int], others: list[list[int]]) -> list[int]:
    """Places of the lines of a page that its neighbours show to be the site's.

    own: hashes of its lines; article: places of those of its article; size: characters of each line;
    others: the hashes of each neighbour's lines.
    """
    story, out = set(article), set()
    whole = sum(size[i] for i in article)
    every, witnesses = None, 0
    for other in others:
        if other == own or not other:
            continue
        shared = common(own, other)
        mine = shared & story
        out |= shared - story
        if 2 * sum(size[i] for i in mine) <= whole:
            every = mine if every is None else every & mine
            witnesses += 1
    if witnesses >= WITNESSES:
        out |= every
    return sorted(out)


def main_text(own: list[tuple[str, bool, bool]], others: list[list[tuple[str, bool, bool]]] = ()) -> tuple[str, int]:
    """The lines of a page that stay, and how many its neighbours show to be the site's."""
    shared = template_lines(hashes(own), story_of(own), [len(x[0]) for x in own], [hashes(x) for x in others])
    return kept_text(own, shared, any(o != own for o in others)), len(shared)


def story_of(own: list[tuple[str, bool, bool]]) -> list[int]:
    """Places of the article's lines."""
    return [i for i, (_, article, template) in enumerate(own) if article and not template]


def kept_text(own: list[tuple[str, bool, bool]], shared: list[int], paired: bool) -> str:
    alone = not paired and any(a and not t for _, a, t in own)
    gone = set(shared)
    return "\n".join(line for i, (line, article, template) in enumerate(own) if not template and i not in gone and (article or not alone))


def _near(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page shows its neighbours: its key, place and the hashes, article places and sizes of its lines."""
    longs = pa.list_(pa.int64())
    for b in batches:
        rows = []
        for html in b.column(5).cast(pa.large_binary()):
            lines = lines_of(html.as_py().decode("utf-8", "replace")) if html.is_valid else []
            rows.append((hashes(lines), story_of(lines), [len(x[0]) for x in lines]))
        yield pa.record_batch([*(b.column(i) for i in range(5)), *(pa.array([r[k] for r in rows], longs) for k in range(3))], names=["k1", "k2", "host", "path", "url", "lines", "story", "size"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place in it."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        place = pa.array(np.arange(n, n + b.num_rows, dtype=np.int64))
        n += b.num_rows
        yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part, dtype=np.int32)), place], names=[*b.schema.names, "part", "place"])


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rank, own, k1, k2, host, path, lines, story, size) by block and rank: k1, k2, shared, paired of the own ones."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("shared", longs), ("paired", pa.bool_())])
    held: list[tuple] = []

    def settle() -> pa.RecordBatch:
        at = {row[1]: row for row in held}
        out = []
        for _, rank, own, k1, k2, host, path, lines, story, size in held:
            if own:
                near = [(-_near(path, n[6]), abs(d), d, n[7]) for d in range(-NEAR, NEAR + 1) if d and (n := at.get(rank + d)) and n[5] == host]
                others = [x[3] for x in sorted(near)[:NEAR]]
                out.append((k1, k2, template_lines(lines, story, size, others), any(o != lines for o in others)))
        held.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, schema)], schema=schema)

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(10))):
            if held and held[0][0] != row[0]:
                yield settle()
            held.append(row)
    yield settle()


def ranked(pages: DataFrame, by: list[str]) -> DataFrame:
    """pages with `rank`, their place from 0 in the order of `by` (total), in a written table."""
    dealt = pages.repartitionByRange(n_partitions(pages.sparkSession), *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", part int, place long"
    placed = staged(dealt.mapInArrow(_numbered, schema), "ranked")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("place")).drop("part", "place", "first")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with what their neighbours have shown: the text."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64())])
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        texts, found = [], []
        for packed, shared, paired in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
            html = unpack.decompress(packed.as_py()).decode("utf-8", "replace") if packed.is_valid else None
            texts.append(kept_text(lines_of(html), shared or [], bool(paired)))
            found.append(len(shared or ()))
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, t) for x, t in ((texts, pa.string()), ([len(t) for t in texts], pa.int64()), (found, pa.int64())))], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [pack.compress(h.as_py()) if h.is_valid else None for h in b.column(4).cast(pa.large_binary())]
        yield pa.record_batch([*(b.column(i) for i in range(4)), pa.array(packed, pa.binary())], names=["k1", "k2", "page_id", "url", "html"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines that neighbours show to be the site's) of every row of pages."""
    page_id, url, html = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    host, path = parts(url)
    keys = [F.xxhash64(page_id, url, html).alias("k1"), F.xxhash64(F.lit(1), page_id, url, html).alias("k2")]
    rows = pages.select(*keys, host.alias("host"), path.alias("path"), url.alias("url"), html.alias("html"))
    shown = rows.mapInArrow(_measured, "k1 long, k2 long, host string, path string, url string, lines array<long>, story array<long>, size array<long>")
    shown = ranked(shown.where("host <> ''").dropDuplicates(["k1", "k2"]), ["host", "path", "url", "k1", "k2"])
    block, inner = F.expr(f"rank div {BLOCK}"), F.expr(f"rank % {BLOCK}")
    beside = F.array(block, F.when(inner < NEAR, block - 1), F.when(inner >= BLOCK - NEAR, block + 1))
    dealt = shown.withColumn("block", F.explode(F.filter(beside, lambda x: x.isNotNull()))).withColumn("own", F.col("block") == block)
    dealt = dealt.select("block", "rank", "own", "k1", "k2", "host", "path", "lines", "story", "size").repartition(n_partitions(pages.sparkSession), "block").sortWithinPartitions("block", "rank")
    shared = dealt.mapInArrow(_differenced, "k1 long, k2 long, shared array<long>, paired boolean")
    packed = pages.select(*keys, page_id.alias("page_id"), url.alias("url"), html.alias("html")).mapInArrow(_pack, "k1 long, k2 long, page_id long, url string, html binary")
    joined = packed.join(shared, ["k1", "k2"], "left").select("page_id", "url", "html", "shared", "paired")
    return joined.mapInArrow(_written, "page_id long, url string, text string, n_chars long, n_shared long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
