import pytest
from pyspark.sql import functions as F

from lumenloom.sources import artifacts, ingest
from lumenloom.streaming import corpus_stream as cs


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('"bare"\n\n{broken\n{"text": "obj"}\n42\n["tag", "arr", {}]\n["short"]\n{"text": 5}\n', encoding="utf-8")
    lines = ingest.scan_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none.jsonl")])
    assert lines.count() == 7
    records = ingest.parse_lines(lines)
    assert records.count() == 6
    as_object = [r.text for r in ingest.extract_text(records.withColumn("shape", F.lit("object"))).orderBy("line").collect()]
    assert as_object == ["bare", "obj", None, None, None, None]
    as_array = [r.text for r in ingest.extract_text(records.withColumn("shape", F.lit("json_array"))).orderBy("line").collect()]
    assert as_array == [None, None, None, "arr", None, None]
    assert ingest.count_lines(spark, str(tmp_path / "none.jsonl")) == 0
    spec = ingest.SourceSpec("s", (str(tmp_path / "a.jsonl"),))
    assert ingest.stream_source(spark, spec, limit=2).count() == 2


def test_pairs(spark):
    values = ['{"ms": "a", "en": "b"}', '{"src": "c", "tgt": 4}', '{"translation": {"ms": "e", "en": "f"}}', '{"input": "`x` terjemah ke inggeris", "output": "y"}', "3"]
    rows = ingest.parse_lines(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string"))
    got = [(r.malay, r.english) for r in ingest.extract_pair(rows).orderBy("i").collect()]
    assert got == [("a", "b"), (None, None), ("e", "f"), ("x", "y"), (None, None)]


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        artifacts.read_artifact(spark, path)
    assert artifacts.fingerprint_of(spark, path) is None
    artifacts.write_artifact(spark.range(3), path, "abc", "phase0")
    assert artifacts.is_complete(spark, path, "abc") and not artifacts.is_complete(spark, path, "xyz")
    assert set(artifacts.STAMP) <= set(artifacts.read_artifact(spark, path).columns)
    found, missing = artifacts.bundle(spark, {"t": path, "u": path + "-none"})
    assert list(found) == ["t"] and missing == ["u"]


def test_csv_metrics(spark):
    df = spark.createDataFrame([("Time To First Token (ms)", "1,234.5", "x")], "Metric string, avg string, note string")
    assert [tuple(r) for r in artifacts.csv_metrics(df).collect()] == [("time_to_first_token_ms_avg", 1234.5)]
    name = spark.createDataFrame([("vllm_request_throughput_avg",), ("other",)], "m string").select(artifacts.canonical_metric(F.col("m")).alias("c"))
    assert [r.c for r in name.collect()] == ["request_throughput", None]


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"avg": 2.5, "on": true}, "s": "x"}')], "k int, j string")
    assert sorted((r.metric, r.value) for r in artifacts.flatten_json(df, "j", ["k"]).collect()) == [("a", 1.0), ("b_avg", 2.5)]


def test_report(spark):
    df = spark.range(50).select("id", (F.col("id") / 3).alias("x"), F.lit(1).alias("_hidden"))
    text = artifacts.report("R", {"One": df.orderBy("id"), "Two": None})
    assert "First 40 of 50 rows." in text and "_hidden" not in text and "- Two" in text and "| 1 | 0.3333 |" in text


def test_stream_quota(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(3)], "c string, i int").write.parquet(str(tmp_path / "documents.parquet"))
    stream = cs.document_stream(spark, str(tmp_path))
    got = {r.c: r["count"] for r in cs.drain(cs.class_quota(stream, "c", 5), "append").groupBy("c").count().collect()}
    assert got == {"a": 5, "b": 3}


def test_discovery_and_tracking(spark, tmp_path):
    (tmp_path / "a_raw.jsonl").write_text('{"request_throughput": 1}\n')
    (tmp_path / "m.json").write_text('{"request_throughput": {"avg": 2.5}, "other": 1}')
    found = artifacts.discover_metrics(spark, str(tmp_path))
    assert sorted((r.metric, r.value) for r in found.collect()) == [("other", 1.0), ("request_throughput_avg", 2.5)]
    assert artifacts.track(found, str(tmp_path / "runs"), "r1") and spark.read.parquet(str(tmp_path / "runs")).count() == 2
    (tmp_path / "empty").mkdir()
    assert artifacts.discover_metrics(spark, str(tmp_path / "empty")) is None
