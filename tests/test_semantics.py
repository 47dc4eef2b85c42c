"""Small cases whose results are fixed by definition."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import fusion, graph, index, metrics, vectors
from lexforge.plans import all as _all  # noqa: F401  registers the queries
from lexforge.plans import registry
from tests.compare import difference


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).head()[0]


@pytest.mark.parametrize(("text", "tokens"), [("straße C++ 10", ["stra", "e", "c", "10"]), ("", []), (None, []), ("Åre-ÄÖ éÜ ñ", ["åre", "äö", "éü"])])
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokens(F.col("x")), x=text) == tokens


def test_norm(spark):
    assert one(spark, T.norm(F.col("x")), x="  Große   Straße ") == "grosse strasse"
    assert one(spark, T.word_tokens(F.col("x")), x="C++ und C#") == ["c++", "und", "c#"]


def test_ngrams(spark):
    assert one(spark, T.char_ngrams(F.col("x"), 4), x="abc") == []
    assert one(spark, T.padded_ngrams(F.array("x")), x="ab") == [" ab", "ab ", " ab "]


@pytest.mark.parametrize(("word", "stem"), [("flickorna", "flick"), ("jaktkarlarne", "jaktkarl"), ("klokast", "klok"), ("kristallen", "kristall"), ("bok", "bok")])
def test_stems(word, stem):
    assert T.swedish_stem(word) == stem


def test_bm25_by_hand(spark):
    docs = {1: ["a", "b", "a"], 2: ["b"], 3: [], 4: ["a", "c"]}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(9, ["a", "c", "a", "zz"])], "query_id long, tokens array<string>")
    got = {r.doc_id: r.score for r in index.scores(asked, index.postings(frame)).collect()}
    n, avgdl = 4, 6 / 4
    df = Counter(t for d in docs.values() for t in set(d))
    for doc, tokens in docs.items():
        want = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tokens.count(t) * 2.2 / (tokens.count(t) + 1.2 * (0.25 + 0.75 * len(tokens) / avgdl)) for t in {"a", "c"} if t in tokens)
        assert math.isclose(got.get(doc, 0.0), want, abs_tol=1e-12)


def ranked(spark, rows):
    return spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(rows)], "query_id long, doc_id long, rank int")


def test_quota_of_zero_admits_none(spark):
    out = fusion.quotas(ranked(spark, [1, 2]), ranked(spark, [3, 4]), ranked(spark, [5, 6]), 0, 4)
    assert [r.doc_id for r in out.orderBy("rank").collect()] == [1, 5, 6, 3, 4]


def test_slots_without_a_first_list(spark):
    out = fusion.slots(ranked(spark, []), ranked(spark, [3, 4]), 1)
    assert [r.doc_id for r in out.orderBy("rank").collect()] == [3, 4]


def test_routes(spark):
    nodes = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", True), (4, "a", False), (5, "a", False), (6, "a", False), (7, "a", True)], "id long, kind string, active boolean")
    edges = spark.createDataFrame([(1, 2), (4, 5), (5, 4), (6, 2), (6, 7)], "src long, dst long")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    start = nodes.where("not active").select("id")
    got = {r.id: r.status for r in graph.replacement_routes(nodes, edges, start).collect()}
    assert got == {1: "UNIQUE", 4: "CYCLE_OR_INVALID", 5: "CYCLE_OR_INVALID", 6: "MULTIPLE"}


def test_wilson_and_mcnemar(spark):
    row = spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0)).alias("none"), metrics.wilson(F.lit(0), F.lit(0), 0.0).alias("zero"), metrics.exact_mcnemar(F.lit(11), F.lit(0)).alias("p"), metrics.exact_mcnemar(F.lit(0), F.lit(0)).alias("q")).head()
    assert row.none.low is None and row.zero.low == 0.0
    assert math.isclose(row.p, 2 * 0.5**11) and row.q == 1.0


def test_passive_aggressive_separates(spark):
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y", {("fx" if i % 2 else "fy"): 1.0}) for i in range(10)], "row long, cls string, features map<string,double>")
    w = {(r.cls, r.feature): r.w for r in vectors.passive_aggressive(rows).collect()}
    assert w["x", "fx"] > w.get(("y", "fx"), 0) and w["y", "fy"] > w.get(("x", "fy"), 0)


def test_online_training_takes_all_turns(spark, sf_dir):
    from lexforge.plans import all as _all  # noqa: F401
    from lexforge.plans import registry

    roles = {r.role for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("length(trim(text)) > 0").select("role").distinct().collect()}
    assert "assistant" in roles and {r.cls for r in registry.QUERIES["online_training"](spark, sf_dir).select("cls").distinct().collect()} == roles


def test_logistic_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(60) > 0).astype(int)
    frame = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    theta, _ = vectors.logistic(frame, ["a", "b"], "y", steps=5, rate=0.5)
    want, z = np.zeros(3), np.c_[np.ones(60), x]
    cw = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    for _ in range(5):
        g = z.T @ (cw * (1 / (1 + np.exp(-z @ want)) - y)) / 60
        g[1:] += 0.01 * want[1:]
        want = want - 0.5 * g
    assert np.allclose(theta, want)


def test_pair_signal_by_hand(spark):
    """Shared beginnings count against the shorter word; near words by the lesser limit, as specific as longer less edits."""
    cases = [("abcdefg", "abcdexyzwvut", 2, 5), ("abcde", "abcdf", 0, 0), ("abcdefghi", "bcdefghj", 0, 0), ("kittens", "kittenz", 2, 6), ("xkitten", "ykitten", 1, 6), ("sales", "salesman", 3, 5), ("same", "same", 4, 4), ("abcd", "abcdefgh", 0, 0)]
    got = spark.createDataFrame([(a, b) for a, b, *_ in cases], "a string, b string").select("a", "b", T.pair_signal(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r.a, r.b, r.s.signal, r.s.specificity) for r in got] == cases


def test_words_meet_under_shared_keys(spark):
    import itertools
    import random

    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 10))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "a string")
    from lexforge.plans.text_pack import alike_words

    got = {(x.a, x.b): (x.signal, x.specificity) for x in alike_words(df, "a", df.withColumnRenamed("a", "b"), "b").collect()}
    every = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string").select("a", "b", T.pair_signal(F.col("a"), F.col("b")).alias("s")).where("s.signal > 0").collect()
    assert got == {(x.a, x.b): (x.s.signal, x.s.specificity) for x in every}


def test_scrub_by_hand(spark):
    texts = {"ring 070-123 45 67 nu": "ring nu", "2024-01-15 10:30": "2024-01-15 10:30", "se www.exempel.se/jobb eller http://a.b": "se eller", "+4670 123 45 67": "", "+46 70": "+46 70", "order 12345678": "order 12345678", "a.b@c.se, x": ", x"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.scrub(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == texts


def test_all_unicode_spaces_are_white_space(spark):
    row = spark.createDataFrame([("\u2003A\u00a0\u3000B\u2028c\u1680",)], "t string").select(T.norm(F.col("t")).alias("n")).head()
    assert row.n == "a b c"


def test_passive_aggressive_by_hand(spark):
    """Starts at the unit sums; unit rows; half the loss to either side."""
    rows = spark.createDataFrame([(1, "x", {"f": 2.0}), (2, "y", {"f": 3.0, "g": 4.0})], "row long, cls string, features map<string,double>")
    assert {(r.cls, r.feature): round(r.w, 9) for r in vectors.passive_aggressive(rows, epochs=0).collect()} == {("x", "f"): 1.0, ("y", "f"): 0.6, ("y", "g"): 0.8}
    w = {"x": {"f": 1.0, "g": 0.0}, "y": {"f": 0.6, "g": 0.8}}
    import hashlib

    data = {1: ("x", {"f": 1.0, "g": 0.0}), 2: ("y", {"f": 0.6, "g": 0.8})}
    for i in sorted(data, key=lambda i: hashlib.sha256(f"pa|0|{i}".encode()).digest()):
        c, v = data[i]
        k = "y" if c == "x" else "x"
        loss = 1 - sum(w[c][f] * v[f] for f in v) + sum(w[k][f] * v[f] for f in v)
        for f in v:
            w[c][f] += max(loss, 0) / 2 * v[f]
            w[k][f] -= max(loss, 0) / 2 * v[f]
    got = {(r.cls, r.feature): r.w for r in vectors.passive_aggressive(rows, epochs=1).collect()}
    assert all(math.isclose(got.get((c, f), 0.0), w[c][f], abs_tol=1e-12) for c in w for f in "fg")


def test_task_query_by_hand(spark):
    text = "Vi är stora. I rollen gör du mycket och mer och ännu mer. Titeln är Kock. Du lagar mat varje dag i ett stort kök. Du städar. Sen går du hem. Slut."
    got = spark.createDataFrame([(text,), ("Inget här.",), (None,), ("I rollen. Kort.",)], "t string").select(T.task_query(F.col("t"), ["i rollen"], ["kock"]).alias("q"), T.leak_free(F.col("t"), ["kock"], 25, 26).alias("l")).collect()
    assert got[0].q == "I rollen gör du mycket och mer och ännu mer. Du lagar mat varje dag i ett stort kök. Du städar."
    assert got[0].l is not None and len(got[0].l.split()) == 26 and "Kock" not in got[0].l
    assert all(r.q is None and r.l is None for r in got[1:])


def test_stems_beside_tokens(spark):
    from lexforge.plans.text_pack import stemmed

    df = spark.createDataFrame([(1, ["bilarna", "bil"]), (2, [])], "doc_id long, tokens array<string>")
    both = {r.doc_id: r.tokens for r in stemmed(df, "doc_id", True).collect()}
    assert sorted(both[1]) == ["bil", "bilarna", "m:bil", "m:bil"] and both[2] == []
    assert {r.doc_id: sorted(r.tokens) for r in stemmed(df, "doc_id", False).collect()} == {1: ["m:bil", "m:bil"], 2: []}


def test_compatibility_normalisation(spark):
    import unicodedata

    texts = ["ﬁ ① Å e\u0301", "", None, "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_unicode(F.col("t"), F.lit("NFKC")).alias("n")).collect()
    assert [r.n for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_sentences_keep_digits_at_their_ends(spark):
    """A sentence's place in the text is not a character to trim."""
    assert one(spark, T.sentences(F.col("x")), x="0 a 0. 1 b 1. 2 c 2") == ["0 a 0.", "1 b 1.", "2 c 2"]


@pytest.mark.parametrize("features", [lambda w: [w], lambda w: [w[i : i + 4] for i in range(len(w) - 3)], lambda w: [w, "m:" + w[:3]]])
def test_two_passes_equal_the_index(spark, monkeypatch, features):
    """Scores without postings are those of the index: empty, repeated and very frequent texts, ties, exact surfaces, blocks of few rows."""
    import random

    from lexforge.operators import matched

    monkeypatch.setattr(matched, "BLOCK", 900)
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ab", "cde", "f") for b in ("gh", "i", "jkl") for c in ("", "mn", "opq")]
    texts = [" ".join(r.choice(words[: 4 + i % 23]) for _ in range(r.randrange(40))) for i in range(150)] + [None, "", "fi", "nothing shared"] + ["abgh cdei fjkl"] * 30
    asked = [(7, "abgh cdei fjkl"), (3, "abgh abgh fjklopq"), (5, ""), (9, None), (11, "unheardof"), (4, texts[20])]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").select(key, T.tokens(F.col("text")).alias("tokens"), T.norm(F.col("text")).alias("surface"))
    docs, queries = frame(list(enumerate(texts)), "doc_id").repartition(3), frame(asked, "query_id")
    split = F.udf(lambda x: [f for w in x for f in features(w)], "array<string>")
    whole = lambda df: df.withColumn("tokens", split("tokens"))
    scored = index.with_exact(index.scores(whole(queries), index.postings(whole(docs))), index.exact_hits(queries, docs))
    for exact, want in ((True, scored), (False, index.scores(whole(queries), index.postings(whole(docs))))):
        found = matched.top(docs, queries, 10, features, exact=exact)
        have = {(x.query_id, x.rank): (x.doc_id, round(x.score, 6)) for x in found.collect()}
        assert have == {(x.query_id, x.rank): (x.doc_id, round(x.score, 6)) for x in index.ranked(want, 10).collect()}
    assert matched.top(docs.union(docs.limit(1)), queries, 10) is None


def test_dense_neighbours_in_one_pass(spark, tmp_path, monkeypatch):
    """Ties, copies, null, empty, zero and short vectors as in the SQL; the plan crosses nothing, however small the blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    for i in (0, 20, *range(100, 140)):
        rows[i] = (i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    rows[41], rows[60], rows[62], rows[81] = (41, [1.0, 2.0, 3.0]), (60, None), (62, []), (81, [2.0, 4.0, 6.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    for zero in (False, True):
        if zero:
            rows[160], rows[163] = (160, [0.0] * 8), (163, [0.0] * 8)
        spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        for sizes in ((4096, 1024), (16, 4)):
            monkeypatch.setattr(vectors, "TABLE_BLOCK", sizes[0])
            monkeypatch.setattr(vectors, "QUERY_BLOCK", sizes[1])
            assert difference(spark, "", lambda s, _: registry.QUERIES["dense_neighbours"](s, str(tmp_path)), registry.ORACLE_SQL["dense_neighbours"], con) == ""
    plan = registry.QUERIES["dense_neighbours"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
