"""URL filter, sharding, HTML, quality, decontamination, toxicity, packing and the pipeline on awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import decontam, html, packing, quality, queries, sharding, toxicity, urlfilter
from tests.llm import cases

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")


# URL filter


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://b.net", "http://b.net/", "https://x.example.com/de/1?q#f", "http://x.org/fr/", "http://X.org/en?x", "http://www.x.org/en.html", "http://badexample.com/de/", "ftp://net/x", "http:///p"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("x.org/en",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/1", "example.net/en/", "allow"), 4: ("b.net", "", None, "allow"), 5: ("b.net", "/", "net/", "block"),
        6: ("x.example.com", "/de/1", "example.com/de/", "block"), 7: ("x.org", "/fr/", "org/fr/", "allow"), 8: ("x.org", "/en", None, "block"), 9: ("www.x.org", "/en.html", None, "block"), 10: ("badexample.com", "/de/", None, "allow"),
        11: ("net", "/x", "net/", "block"), 12: ("", "/p", None, "allow"),
    }
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert urlfilter.judge(pages, listed.limit(0)).where("listed").count() == 0


def test_bloom_never_misses(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("url"))
    for blocks in (1, 10, 200):
        pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
        old = urlfilter.MAX_BLOCKS
        urlfilter.MAX_BLOCKS = blocks
        try:
            assert urlfilter.judge(pages, listed, []).where("listed").count() == 3000
        finally:
            urlfilter.MAX_BLOCKS = old


# Sharding


def test_shards(clashing, empty):
    out = sharding.shard(clashing, 4, bucket_bytes=100_000)
    assert set(out.columns) == set(clashing.columns)
    rows = out.select("doc_id", "text", "shard", "slot", "size").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 1
    sizes = [len(by[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(map(tuple, clashing.select("doc_id", "text").collect()))
    assert sharding.shard(empty).count() == 0


def test_shuffle_is_uniform(spark, tmp_path):
    rows = spark.range(4000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard(rows, 4).collect()
    for part in range(4):
        n = sum(1 for r in out if r.shard == part and r.doc_id < 1000)
        assert abs(n - 250) < 6 * math.sqrt(250)
    sharding.write_shards(rows, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().where("count = 1000").count() == 4


def test_sharding_query(spark, sf_dir):
    """The query's digests against the standard library, its law and its slots."""
    out = queries.QUERIES["op2_sharding"](spark, sf_dir)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = out.collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items()} and len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(16)]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


# HTML

ARTICLE = "<article><header><h1>T&amp;x</h1></header><p>a <b>b</b>c<br>d&nbsp;e<p class=ad>buy<p>more<aside>x</aside><footer>f</footer><div id=comments><p>hi</div></article>"


def test_lines_of():
    page = f"<html><head><title>no</title><style>p</style></head><body><header>Top</header><nav>a</nav><div class='cookie-notice'>We</div>{ARTICLE}<p>out</p><form>q</form><script>var x='</p>'"
    assert html.main_text(html.lines_of(page))[0] == "T&x\na bc d e\nmore"
    assert html.lines_of(None) == html.lines_of("") == html.lines_of("<!-- never ends") == []
    assert [x[0] for x in html.lines_of("plain &lt;text&gt; <")] == ["plain <text> <"]


def test_only_whole_names_are_template():
    kept = ['style="overflow:hidden"', 'aria-hidden="false"', 'data-id="ad"', 'class="has-sidebar"', 'class="content no-ads"', 'class="social-science"', 'class="article-header"', 'id=tags-page', 'title="hidden"', 'aria-label="Comments on the law"']
    gone = ["hidden", 'class="x ad"', "class='cookie-notice'", "id=ad_2", 'role="navigation"', 'aria-label="Related"', 'CLASS="Sidebar"']
    for a in kept + gone:
        page = f"<main><p>first</p><div {a}><p>second</p></div></main>"
        assert html.main_text(html.lines_of(page))[0] == ("first\nsecond" if a in kept else "first"), a
    for tag in ("body", "main", "article"):
        lines = html.lines_of(f"<{tag} class='search'><p>text</p></{tag}>")
        assert html.main_text(lines)[0] == "text" and not html.lines_of(f"<{tag} hidden><p>text</p></{tag}>")[0][1]


def test_common():
    for a, b, n in (("abcde", "xbyd", 2), ("", "abc", 0), ("aaaa", "aa", 2), ("abcabc", "cabcab", 5)):
        assert len(html.common(list(a), list(b))) == n


def test_neighbour_decides_beside_an_article():
    page = "<body><p>Site</p><article><p>{0}</p></article><div>{1}</div><p>Rights</p>"
    own, other = (html.lines_of(page.format(*x)) for x in (("story", "its second part"), ("other", "its own part")))
    assert html.main_text(own, [other]) == ("story\nits second part", 2)


def test_every_witness_decides_in_an_article():
    """A line that all neighbours' stories hold is the site's; one that some hold is text; copies don't tell."""
    page = "<article><p>{0}</p><p>Free to use.</p><p>Read more</p></article>"
    lines = [html.lines_of(page.format(f"A story about the number {i}, told at some length")) for i in range(5)]
    without = [html.lines_of(page.format(f"Story {i}, told at length").replace("<p>Free to use.</p>", "")) for i in range(2)]
    assert html.main_text(lines[0], [lines[1], lines[2], *without])[0].split("\n")[1:] == ["Free to use."]
    assert html.main_text(lines[0], lines[1:3])[1] == 0 and html.main_text(lines[0], [lines[0]] * 4)[1] == 0


def test_class_names_and_hyphens():
    page = '<article><p class="share-price">Shares of the firm rose</p><div id="print-edition"><p>second</p></div><section class="search-results-analysis">third</section></article>'
    assert html.main_text(html.lines_of(page))[0] == "Shares of the firm rose\nsecond\nthird"


def test_differencing_alone_finds_the_frame(spark, monkeypatch):
    """Two sites without any mark-up but blocks: their frames go by their neighbours, and no story's line does."""
    monkeypatch.setattr(html, "TEMPLATE", set())
    monkeypatch.setattr(html, "NAMED", frozenset())
    story = {i: [cases.prose(12, 1000 + 10 * i + k) for k in range(3)] + ["Free to use."] * (i % 7 == 0) for i in range(60)}
    page = lambda i: f"<div>Site {i % 2}</div><ul><li>Home<li>News {i % 2}</ul>" + "".join(f"<p>{x}" for x in story[i]) + f"<div>Rights {i % 2}"
    pages = spark.createDataFrame([(i, f"http://s{i % 2}/{i // 10}/{i}", page(i)) for i in range(60)], "page_id long, url string, html string")
    got = {r.page_id: (r.text.split("\n"), r.n_shared) for r in html.extract(pages).collect()}
    assert all(n >= 4 and set(lines) <= set(story[i]) and set(story[i]) - set(lines) <= {"Free to use."} for i, (lines, n) in got.items())


def test_long_pages_end():
    equal, mixed = [1] * 20_000, [1, 2] * 10_000
    assert len(html.common(equal, equal[:-1])) == 19_999 and len(html.common(mixed, [2] + mixed)) == 20_000
    assert len(html.lines_of("<div>" * 20_000 + "x" + "</p>" * 20_000)) == 1 and len(html.lines_of("<p>x" * 50_000)) == 50_000
    assert html.lines_of("<a " * 20_000 + "'") == []


@pytest.mark.parametrize("matches", [0, 200_000])
def test_common_is_longest(monkeypatch, matches):
    monkeypatch.setattr(html, "MATCHES", matches)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 14)).tolist() for _ in range(2))
        assert len(html.common(a, b)) == decontam.lcs(a, b)


@pytest.mark.parametrize("partitions", [1, 5])
def test_pages_equal_brute_force(spark, sf_dir, partitions):
    """Every page against its nearest on the host by a plain search; the number of partitions makes no difference."""
    own = [(1, "http://h/a/1", "<p>x" * 3), (1, "http://h/a/1", "<p>x" * 3), (None, "http://h/a/1", "<p>y"), (7, None, "<p>alone"), (8, "http://h/b", None), (9, "HTTP://H/a/", "")]
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(own, "page_id long, url string, html string"))
    keyed = df.select(*html.parts(F.col("url")), "url", F.xxhash64("page_id", "url", "html"), F.xxhash64(F.lit(1), "page_id", "url", "html"), "page_id", "html").collect()
    order = sorted({tuple(r[:5]): html.lines_of(r[6]) for r in keyed if r[0]}.items())
    want = Counter()
    for r in keyed:
        near = []
        if r[0]:
            at = next(i for i, (k, _) in enumerate(order) if k == tuple(r[:5]))
            near = sorted((-len(__import__("os").path.commonprefix([r[1], order[at + d][0][1]])), abs(d), d) for d in range(-4, 5) if d and 0 <= at + d < len(order) and order[at + d][0][0] == r[0])[:4]
        text = html.main_text(html.lines_of(r[6]), [order[at + d][1] for _, _, d in near])[0]
        want[r[5], r[2], text, len(text)] += 1
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df.withColumn("lines", F.lit(1)).repartition(3)).collect()) == want
        assert html.extract(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_differencing(spark):
    frame = "<body><p>Site name</p><p>Menu</p><p>{0}</p><p>All rights</p></body>"
    pages = [(1, "http://h/a/1", frame.format("first story")), (2, "http://h/a/2", frame.format("second story")), (3, "http://other/a", frame.format("third")), (4, None, None), (5, "http://h/z", ""), (1, "http://h/a/1", frame.format("first story"))]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect())
    assert got[2, "second story", 12] == 1 and got[1, "first story", 11] == 2 and got[4, "", 0] == 1 and got[5, "", 0] == 1
    assert got[3, "Site name\nMenu\nthird\nAll rights", 31] == 1


# Quality


def test_signals_and_bounds():
    assert quality.signals(None) == (0, 0, 0, 0, 0)
    assert quality.signals("a b c a b c\nx\nx\n#".encode()) == (9, 9, 1, 1, 6)
    assert math.isclose(quality.binomial_cdf(2, 10, 0.3), sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    assert quality.admissible(0, 300, 0.01, 0.05) and not quality.admissible(0, 298, 0.01, 0.05) and not quality.admissible(0, 0, 0.5, 0.5)


def test_risk_is_controlled(spark):
    """Cutoffs certified on labelled rows keep to the risk on unseen ones, and reject the bad."""
    good = [(i, cases.prose(60, i), "en") for i in range(3000)]
    bad = [(10_000 + i, cases.prose(60, i).replace(" ", " *** "), "en") for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(10_000 + i, 0) for i in range(30)] + [(None, 1), (1, None), (3, 1), (3, 1)], "doc_id long, quality int")
    out = quality.judge(docs, labels)
    fresh = out.where("doc_id between 2000 and 9999")
    assert fresh.where("not kept").count() <= 0.02 * fresh.count()
    assert out.where("doc_id >= 10000 and kept").count() == 0


def test_the_bound_holds_when_it_should():
    """Of many draws from a law whose every step loses more than the risk, at most the level certify one."""
    rng = np.random.default_rng(0)
    certified = 0
    for _ in range(2000):
        hit = (rng.random(400) < 0.025).astype(np.int64)
        bins = np.where(hit[:, None] == 1, 1, quality.STEPS + 1) * np.ones((1, 5), dtype=np.int64)
        certified += quality.certified([(1, 0, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 1, 0, 0)], bins, np.ones(400, dtype=np.int64), 0.02, 0.05) is not None
    assert certified <= 0.05 * 2000 + 3 * math.sqrt(0.05 * 2000)


def test_the_path_takes_what_rejects_most():
    s = quality.STEPS + 1
    bins = np.array([[1, s], [2, s], [2, s], [s, 1], [s, 3], [s, s]])
    good, bad = np.array([0, 0, 4, 0, 0, 90]), np.array([3, 1, 0, 2, 2, 0])
    assert quality.path(bins, good, bad, 3) == [(0, 3), (1, 3)]
    assert quality.path(bins, good, bad, 10) == [(0, 3), (1, 3), (2, 3)]
    assert quality.certified([(0, 3), (1, 3), (2, 3)], bins, 40 * good, 0.02, 0.05) == (1, 3)
    assert quality.certified([], bins, good, 0.02, 0.05) is None and quality.certified([(0, 3)], bins, 0 * good, 0.02, 0.05) is None


def brute_signals(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.strip(" \t\n\x0b\x0c\r"):
            dup += x in lines
            lines.add(x)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_query_equals_brute_force(spark, sf_dir, tmp_path):
    """The query on sf0.001 and awkward rows against a plain search for path and cutoffs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(10**6 + i, t, "en" if i % 2 else "", None, None) for i, t in enumerate([None, "", "a " * 60, "x\n" * 80])]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    made = [(2 * 10**6 + i, cases.prose(60, i) if i % 3 else cases.prose(60, i).replace(" ", " *** "), ["en", "en", None, "en", ""][i % 5], "s", 1) for i in range(2000)]
    docs = docs.union(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").union(spark.createDataFrame([(i, int((i - 2 * 10**6) % 3 > 0), 0) for i, *_ in made], "doc_id long, quality int, toxic int"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs.select("doc_id", "lang", "text", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half")).collect()
    worst = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            worst[r.doc_id] = min(r.quality, worst.get(r.doc_id, 9))
    own = {r.doc_id: brute_signals(r.text) for r in rows}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in own.items()}
    values = lambda s: [s[2] / s[0], s[4] / s[0], s[3] / s[0], s[1] / s[0], -s[1] / s[0]] if s[0] else [0.0] * 5
    place = lambda s: [next((t for t, c in enumerate(g, 1) if v > c), quality.STEPS + 1) for v, (_, g) in zip(values(s), quality.RULES.values())]
    cut, strata = {}, {r.lang for r in rows if worst.get(r.doc_id, 0) > 0 and not failed[r.doc_id]}
    for lang in {r.lang for r in rows}:
        mine = [(r.half, place(own[r.doc_id]), worst[r.doc_id] > 0) for r in rows if r.lang == lang and r.doc_id in worst and not failed[r.doc_id]]
        array = lambda h: (np.array([b for x, b, _ in mine if x == h]).reshape(-1, 5), np.array([int(g) for x, _, g in mine if x == h], dtype=np.int64))
        (b0, g0), (b1, g1) = array(0), array(1)
        cut[lang] = quality.certified(quality.path(b0, g0, 1 - g0, 0.04 * g0.sum()), b1, g1, 0.02, 0.05 / max(1, len(strata))) or (0,) * 5
    assert any(map(any, cut.values()))
    want = {(r.doc_id, *own[r.doc_id], failed[r.doc_id], not failed[r.doc_id] and not any(b <= t for b, t in zip(place(own[r.doc_id]), cut[r.lang]))) for r in rows}
    out = queries.QUERIES["op5_quality"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {tuple(r) for r in out.collect()} == want and any(not x[-1] and not x[-2] for x in want)


def test_quality_rows(docs, clashing, empty):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(clashing, labels)
    assert out.count() == docs.count() and out.where("doc_id = 4 and n_words = 0 and base_failed and not kept").count() == 1
    assert out.where("kept = base_failed").count() == 0
    assert quality.judge(empty, labels).count() == 0


# Decontamination


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs(a, b) == t[-1, -1]


def test_leaks(spark, clashing, empty):
    items = [(1, cases.prose(40, 500)), (2, cases.prose(16, 501)), (3, cases.prose(90, 502)), (4, None), (5, "tiny"), (None, cases.prose(30, 503))]
    reworded = items[0][1].split()
    reworded[3::9] = ["other"] * len(reworded[3::9])
    planted = [(100, cases.prose(200, 50) + " " + items[0][1].upper() + " " + cases.prose(300, 51)), (101, items[1][1]), (102, cases.prose(90, 52) + " " + items[2][1]), (103, cases.prose(70, 53) + " " + " ".join(reworded) + " " + cases.prose(40, 54)), (104, items[5][1])]
    docs = clashing.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(100, 1), (101, 2), (102, 3), (103, 1), (104, None)}
    assert decontam.clean(docs, bench).count() == docs.count() - 5
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_more_passages_than_directions(spark):
    """Copies of every item are found where the rank is far below the number of passages; exact cosines are those of all words."""
    items = [(i, " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 900, 40))) for i in range(60)]
    docs = spark.createDataFrame([(i, cases.prose(50, i) + " " + t + " " + cases.prose(60, 100 + i)) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, rank=4).collect()} == {(i, i) for i, _ in items}
    rng = np.random.default_rng(1)
    a = rng.random((30, 80)) * (rng.random((30, 80)) < 0.2)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    row, place = np.nonzero(a)
    columns = np.arange(0, 30, 2)
    words = rng.integers(-1, 80, (200, decontam.WINDOW))
    weights = np.where(words >= 0, rng.random(words.shape), 0)
    norm = np.sqrt((weights**2).sum(axis=1))
    want = np.einsum("nw,pnw->np", weights, a[:, words]) / norm[:, None]
    got = np.zeros((200, 30))
    decontam.Postings(row, place, a[row, place], columns, 80).lift(got, words, weights, norm)
    ours = np.where(want >= decontam.COSINE, want, 0)
    ours[:, 1::2] = 0
    assert ours.any() and np.allclose(got, ours, atol=1e-5)


def test_basis_equals_svd(spark):
    words = [[int(x) for x in np.random.default_rng(i).integers(0, 60, 20)] for i in range(30)]
    rows = spark.createDataFrame([(w,) for w in words], "words array<long>").repartition(3)
    features, v = decontam.latent_basis(rows, np.ones(decontam.BUCKETS, dtype=np.float32), rank=50)
    row, at, weight = decontam._vectors([np.array(w) for w in words], features, np.ones(decontam.BUCKETS, dtype=np.float32))
    a = np.zeros((30, len(features)))
    a[row, at] = weight
    assert np.allclose(np.linalg.norm(a @ v, axis=1), 1, atol=1e-3)  # rank 50 holds all 30 rows


# Toxicity


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(3)
    docs = [np.sort(rng.choice(200, 20, replace=False)) for _ in range(600)]
    grades = np.array([min(2, int((d < 12).sum())) for d in docs])
    m = toxicity.fit(docs, grades)
    p = np.array([m.severity(sum(m.weights.get(int(h), 0) for h in d)).sum() for d in docs])
    means = [p[grades == g].mean() for g in range(3)]
    assert means[0] < 0.4 < means[1] < means[2] and m.thresholds[0] < m.thresholds[1]
    assert not toxicity.fit([], np.array([])).weights and not toxicity.fit(docs, np.zeros(600, dtype=int)).weights


def test_toxicity_held_out(spark, clashing, empty):
    rows = [(i, cases.prose(40, i) + (" Scumbag, " + ["foulword", "foulworse"][i % 2] if i % 4 == 0 else ""), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows if i < 300] + [(None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    got = {r.doc_id: r.rejected for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == x for i, _, x in rows)
    assert toxicity.score(clashing, model).count() == clashing.count()
    assert toxicity.keep_mild(clashing, model).columns == clashing.columns
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(docs, toxicity.trained(docs, labels.limit(0))).where("rejected").count() == 0


# Packing


@pytest.mark.parametrize(("capacity", "windows"), [(2048, 64), (64, 2)])
def test_packing_round_trip(clashing, empty, capacity, windows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in clashing.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), capacity):
            p = ids[s : s + capacity]
            want[r.doc_id, s, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    out = packing.pack(clashing, TOKENIZER, capacity, windows, with_ids=True)
    rows = out.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.sequences(out, capacity).where(F.size("ids") != capacity).count() == 0
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    from lexforge.llm._common import staged

    sizes = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, last.select("doc_id", "start", "ids_crc32").collect()))
