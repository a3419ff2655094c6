import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.vectors import centroids
from tessera.plans.lineage import Workspace, shared_dir
from tessera.sources import files as S
from tessera.sources.tables import one_delivery
from tessera.streaming.coverage import stream_coverage


def test_sentence_forms(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "video_id": "v1"}\n\n{"text": "two"}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x", "race_id": "r"}]))
    (tmp_path / "c.json").write_text(json.dumps({"s1": ["bare", "two"], "s2": [{"text": "rec", "channel": "ch"}]}))
    rows = lambda p: sorted((r.session, r.text, r.idx) for r in S.read_sentences(spark, str(tmp_path / p)).collect())
    assert rows("a.jsonl") == [("all", "two", None), ("v1", "one", None)]
    assert rows("b.json") == [("r", "x", None)]
    assert rows("c.json") == [("s1", "bare", 0), ("s1", "two", 1), ("s2", "rec", None)]


def test_gazetteer_and_absent_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"_meta": {}, "entries": [{"canonical": "A", "category": "TEAM", "variants": ["a"], "total_freq": 2}]}))
    assert S.read_gazetteer(spark, str(tmp_path / "g.json")).first().variants == ["a"]
    assert S.read_gazetteer(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "jsonl"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "k long, t string, x double")
    path = S.write_any(df, str(tmp_path / f"t.{kind}"))
    back = S.read_any(spark, path, df.schema)
    assert S.fingerprint(back.select("k", "t", "x")) == S.fingerprint(df)
    with pytest.raises(ValueError):
        S.require_fingerprint(df, "0-0")


def test_cache_follows_content(spark, tmp_path):
    calls = []

    def run(df):
        return S.cached(spark, str(tmp_path), "t", {"q": 1}, [df], lambda: calls.append(1) or df.withColumn("y", F.lit(1)))

    df = spark.range(3).toDF("k")
    run(df), run(df), run(df.filter("k > 0"))
    assert len(calls) == 2


def test_report_forms(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert S.markdown(df).splitlines()[2] == "| a\\|b | 1 |" and "\\begin{tabular}" in S.latex(df)
    with pytest.raises(ValueError):
        S.markdown(spark.range(600).toDF("k"))
    out = S.Outputs(spark, str(tmp_path))
    out.put("one", df)
    with pytest.raises(ValueError):
        out.put("one", df)
    assert out.manifest().count() == 1


def test_workspace_lives_in_the_shared_folder(spark):
    ws = Workspace(spark, "t")
    a = ws.write(spark.range(10).toDF("k"), "a")
    assert ws.root.startswith(shared_dir(spark)) and a.count() == 10
    ws.drop(a)
    ws.clear()


def test_one_delivery(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "x"), (None, "x"), (2, None)], "k long, t string")
    assert one_delivery(df, "k").count() == 4


def test_streaming_coverage(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 2}", i % 2, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)], "id long, session string, label int, vec array<double>").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_coverage(live, centroids(df), 0.5, "ts").writeStream.outputMode("complete").format("memory").queryName("cov").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.session, r.n, r.covered) for r in spark.sql("select * from cov").collect()) == [("s0", 10, 10), ("s1", 10, 10)]


def test_single_deliveries_are_those_of_one_delivery(spark):
    from tessera.sources.tables import one_delivery, single_deliveries

    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (None, "a", "n"), (None, "a", "n"), (3, None, "m")]
    df = spark.createDataFrame(rows, "k int, l string, text string").repartition(3)
    got = sorted(map(tuple, single_deliveries(df, "k", "l").collect()), key=str)
    assert got == sorted(map(tuple, one_delivery(df, "k", "l").collect()), key=str) and len(got) == 6
    assert single_deliveries(df, "k").count() == 5 and single_deliveries(df.limit(0), "k").count() == 0
