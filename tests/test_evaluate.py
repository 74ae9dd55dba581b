"""Scoring and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenprep import DatasetSpec
from lumenprep.operators import evaluate, report
from lumenprep.plans.prepare import with_messages
from lumenprep.sources.schema import ENCODED_IMAGE, reconcile
from lumenprep.streaming import streams


def test_argmax_takes_the_first(spark):
    df = spark.sql("SELECT array(1.0, 3.0, 3.0) AS s")
    assert df.select(evaluate.argmax(F.col("s"))).first()[0] == 1


def test_strip(spark):
    df = spark.sql("SELECT concat(' \t\n', 'a b', '\r\n ') AS t")
    assert df.select(evaluate.strip(F.col("t"))).first()[0] == "a b"


def test_accuracy_of_nothing_and_of_missing_answers(spark):
    df = spark.createDataFrame([("Fake ", "Fake"), (None, "Real"), ("Real", "Fake")], "p string, l string")
    metrics = evaluate.answer_metrics(F.col("p"), F.col("l"))
    assert tuple(evaluate.evaluate(df, metrics).first()) == (3, 1, pytest.approx(1 / 3))
    assert tuple(evaluate.evaluate(df.where("p = 'x'"), metrics).first()) == (0, 0, 0.0)


def test_generated_suffix(spark):
    df = spark.sql("SELECT array(1, 2, 3) AS o, array(1, 2) AS i, array() AS none")
    got = df.select(
        evaluate.generated_suffix(F.col("o"), F.col("i")), evaluate.generated_suffix(F.col("i"), F.col("o"))
    ).first()
    assert (list(got[0]), list(got[1])) == ([3], [])


@pytest.mark.parametrize("entries", [0, 500_000])
def test_decode_by_both_ways(spark, entries):
    vocab = spark.createDataFrame([(3, "a"), (4, "b"), (7, "c")], "id int, token string")
    rows = [(1, [3, 0, 4, 3]), (2, []), (3, [0]), (4, None), (5, [9, 7])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(3)
    got = evaluate.decode_ids(df, "k", "ids", vocab, unknown="?", broadcast_bytes=entries)
    assert {r["k"]: r["text"] for r in got.collect()} == {1: "a b a", 2: "", 3: "", 4: None, 5: "? c"}


def test_replace_ignored(spark):
    df = spark.sql("SELECT array(-100, 5) AS ids")
    assert list(df.select(evaluate.replace_ignored(F.col("ids"), 0)).first()[0]) == [0, 5]


def test_score_loads_the_model_in_the_task(spark):
    df = spark.range(50, numPartitions=3).withColumn("text", F.col("id").cast("string")).withColumn("heavy", F.lit("x"))
    out = evaluate.score(
        df, ["text"], lambda: {"suffix": "!"}, lambda m, p: [t + m["suffix"] for t in p["text"]], keep=["id"]
    )
    assert out.columns == ["id", "prediction"]
    assert all(r["prediction"] == f"{r['id']}!" for r in out.collect())
    assert "heavy" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_run_size(spark):
    assert tuple(report.run_size(spark.range(103), 4, 2, 3, 2).first()) == (103, 8)
    assert tuple(report.run_size(spark.range(1), 2, 2, num_total_samples=700_000).first()) == (700_000, 175_000)


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.range(30).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.base64(F.col("id").cast("string").cast("binary")).alias("video")
    )
    for i in range(3):
        raw.where(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "src" / "train"))
    schema = "id bigint, label int, video string"
    specs = [
        DatasetSpec(n, path=str(tmp_path / "src"), schema=schema, id_column="id", image_type=ENCODED_IMAGE)
        for n in ("a", "b")
    ]
    inputs = [(s, streams.read_stream(spark, s, "train", max_files=1)) for s in specs]
    prepared = streams.prepare_stream(inputs)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    streams.write_stream(prepared, out, ck, n_datasets=2).awaitTermination()
    done = spark.read.parquet(out)
    assert done.select("micro_batch").distinct().count() > 1
    assert done.count() == 60 and done.select("example_id").distinct().count() == 60
    keyed = raw.withColumns({"example_id": F.concat(F.lit("a/train/"), F.col("id").cast("string")), "dataset": F.lit("a")})
    batch = with_messages(reconcile(keyed, {}, ENCODED_IMAGE))
    columns = ["example_id", "label", "video", "prompt", "completion"]
    assert sorted(map(str, done.where("dataset = 'a'").select(columns).collect())) == sorted(
        map(str, batch.select(columns).collect())
    )
    for row in done.groupBy("micro_batch").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("d")).collect():
        assert row["n"] == row["d"] == row["last"] + 1
    streams.write_stream(prepared, out, ck, n_datasets=2).awaitTermination()
    assert spark.read.parquet(out).count() == 60


def test_stream_refusals(spark):
    spec = DatasetSpec("a", path="/x", schema="id bigint", id_column="id", eval_split=0.1)
    with pytest.raises(ValueError, match="stream"):
        streams.prepare_stream([(spec, spark.range(1))])
    with pytest.raises(ValueError, match="schema"):
        streams.read_stream(spark, DatasetSpec("a", path="/x"), "train")
    with pytest.raises(ValueError, match="id column"):
        streams.prepare_stream([(DatasetSpec("a", path="/x"), spark.range(1))])


def test_running_accuracy(spark, tmp_path):
    for i, rows in enumerate([[("x", "Fake", "Fake")], [("x", "Real", "Fake"), ("y", "Real", "Real ")]]):
        spark.createDataFrame(rows, "d string, p string, l string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = (
        spark.readStream.schema("d string, p string, l string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    )
    running = streams.stream_accuracy(stream, F.col("p"), F.col("l"), ["d"])
    out = str(tmp_path / "out")
    streams.write_running(running, out, str(tmp_path / "ck")).awaitTermination()
    got = {r["d"]: (r["n_rows"], r["accuracy"]) for r in streams.latest_running(spark, out).collect()}
    assert got == {"x": (2, 0.5), "y": (1, 1.0)}
