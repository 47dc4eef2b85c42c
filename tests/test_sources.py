import json
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from lexforge.operators import index
from lexforge.sources import files
from lexforge.streaming import queries as S


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nnot json\n')
    assert files.read_jsonl_counting(spark, str(tmp_path / "b.jsonl"), "id long").cache().where("_bad is not null").count() == 1
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id long").collect()
    (tmp_path / "c.json").write_text(json.dumps({"data": {"concepts": [{"id": "x"}, {"id": "y"}]}}))
    assert [r.id for r in files.read_json_document(spark, str(tmp_path / "c.json"), "data struct<concepts:array<struct<id:string>>>", "data.concepts").collect()] == ["x", "y"]
    (tmp_path / "d.json.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"id": 7}\n'))
    assert files.read_jsonl(spark, str(tmp_path / "d.json.zst"), "id long").head().id == 7


def test_zip_and_pinned(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/rows.jsonl", '{"a": 1}\n{"a": 2}\n')
        z.writestr("readme.txt", "no")
    assert files.read_zip_json(spark, str(tmp_path / "z.zip")).count() == 2
    (tmp_path / "p.bin").write_bytes(b"abc")
    assert files.read_pinned(spark, str(tmp_path / "p.bin"), files.content_sha256(b"abc")).count() == 1
    with pytest.raises(Exception, match="content drift"):
        files.read_pinned(spark, str(tmp_path / "p.bin"), "0" * 64).collect()


@pytest.mark.parametrize(("budget", "n", "status"), [(1000, 3, "complete_array"), (22, 2, "byte_budget_reached")])
def test_array_prefix(spark, tmp_path, budget, n, status):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    rows = files.read_array_prefix(spark, str(tmp_path / "a.json"), budget, chunk=5).collect()
    assert len(rows) == n and {r.status for r in rows} == {status}


@pytest.mark.parametrize("chunk", [5, 10, 11, 1 << 16])
def test_characters_and_numbers_across_chunks(spark, tmp_path, chunk):
    (tmp_path / "a.json").write_text('["ööööö", 12345, {"å": "ä"}]', encoding="utf-8")
    rows = files.read_array_prefix(spark, str(tmp_path / "a.json"), 1000, chunk=chunk).collect()
    assert [json.loads(r.item) for r in rows] == ["ööööö", 12345, {"å": "ä"}]
    assert [json.loads(r.item) for r in files.read_array_prefix(spark, str(tmp_path / "a.json"), 18, chunk=chunk).collect()] == ["ööööö"]


def test_merge_and_leaves(spark):
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    assert files.merge_by_id([a, a], "id").count() == 1
    with pytest.raises(Exception, match="inconsistent"):
        files.merge_by_id([a, a.withColumn("v", F.lit("y"))], "id").collect()
    rows = files.leaves(spark.createDataFrame([(1, '{"a": [1, {"b": "t"}]}'), (2, None)], "k long, j string"), "j").collect()
    assert {(r.path, r.value) for r in rows} == {("a[0]", "1"), ("a[1].b", "t")}
    assert files.shape({"b": [1], "a": {"x": {"y": {}}}}) == {"a": {"x": {"y": "..."}}, "b": ["int"]}


def test_postings_asset(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "doc_id long, tokens array<string>")
    files.write_postings(index.postings(docs), str(tmp_path / "p"))
    assert files.read_postings(spark, str(tmp_path / "p"), ["b"]).count() == 2
    files.write_jsonl(docs, str(tmp_path / "j"), ["doc_id"])
    assert files.read_jsonl(spark, str(tmp_path / "j"), "doc_id long").count() == 2


def test_judging_resumes(spark, tmp_path):
    cases = spark.range(5).select(F.col("id").alias("key"))
    verdict = F.when(F.col("key") % 2 == 0, "keep").otherwise("drop")
    assert S.judged(cases.where("key < 3"), str(tmp_path / "v"), verdict, "p1", spark).count() == 3
    assert S.judged(cases, str(tmp_path / "v"), verdict, "p1", spark).count() == 5
    assert spark.read.parquet(str(tmp_path / "v")).count() == 5
    with pytest.raises(ValueError, match="other cases"):
        S.judged(cases.where("key < 3"), str(tmp_path / "v"), verdict, "p1", spark)
    with pytest.raises(ValueError, match="another protocol"):
        S.judged(cases, str(tmp_path / "v"), verdict, "p2", spark)


def test_late_rows(spark, tmp_path):
    spark.sql("SELECT 1 AS event_id, timestamp_ntz'2024-01-01 00:10:00' AS ts, 'view' AS event_type").write.parquet(str(tmp_path / "e"))
    stream = S.event_stream(spark, str(tmp_path / "e"))
    assert S.drain(S.windowed_counts(stream), "late_rows").count() == 1
