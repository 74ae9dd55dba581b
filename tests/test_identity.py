"""Rows stay what they are when ids are NULL, repeated or shared by datasets."""

from __future__ import annotations

import os

import pytest

from pyspark.sql import functions as F

from lumenprep import DatasetSpec, JobSpec, prepare
from lumenprep.operators import evaluate, images, mix, split
from lumenprep.sources import sinks
from lumenprep.sources.slices import slice_rows


def ids(spark, values):
    return spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "id bigint, label int")


def spec(frame, **options):
    return DatasetSpec("a", frames={"train": frame}, id_column="id", **options)


@pytest.mark.parametrize("values", [[1, 2, None, None], [1, 1, 2, 3]])
def test_ids_without_meaning_are_refused(spark, values):
    with pytest.raises(ValueError, match="rows without a key|with one that others have"):
        prepare(spark, JobSpec([spec(ids(spark, values))], seed=1))


@pytest.mark.parametrize("order", ["concat", "interleave"])
def test_a_row_may_be_trained_on_and_held_out(spark, order):
    job = JobSpec([spec(ids(spark, range(100)), eval_split="train[:10%]+train[-10%:]")], seed=1, mix=order)
    got = prepare(spark, job).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("p"), F.max("pos").alias("m")).collect()
    assert {(r.split, r.n, r.p, r.m) for r in got} == {("train", 100, 100, 99), ("eval", 20, 20, 19)}


@pytest.mark.parametrize("put", [mix.concat, mix.interleave])
def test_datasets_may_share_keys(spark, put):
    a, b = ids(spark, range(10)), ids(spark, range(5, 12))
    got = put([a, b], ["id"], key="id").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(17))
    plain = put([a, b], ["id"]).orderBy("pos").collect()
    assert [(r.ds_pos, r.id) for r in got] == [(r.ds_pos, r.id) for r in plain]
    with pytest.raises(ValueError, match="others have"):
        put([a, ids(spark, [1, 1])], ["id"], key="id")


def test_slices_refuse_rows_without_a_key(spark):
    with pytest.raises(ValueError, match="no order key"):
        slice_rows(ids(spark, [1, 2, None, 4]), "train[:50%]", ["id"])


def test_split_is_exact_or_refused(spark):
    with pytest.raises(ValueError, match="share a key"):
        split.random_split(ids(spark, [1] * 50 + [2] * 50), 0.1, "id", 1)
    some = ids(spark, [7, 7, *range(100, 198)])
    assert split.random_split(some, 0.2, "id", 3).where("split = 'eval'").count() == 20


def test_rows_without_images_have_no_plan(spark):
    profile = spark.createDataFrame([(0, 1.0, 8, 8)], "idx bigint, blur double, height int, width int")
    rows = spark.createDataFrame([(1, 0), (2, 2)], "id bigint, n int")
    plans = images.plan_rows(rows, "id", F.col("n"), profile, images.DegradeParams(), 1)
    assert sorted((r.id, r.image_pos) for r in plans.collect()) == [(2, 0), (2, 1)]


def test_profile_index_must_be_dense(spark):
    gaps = spark.createDataFrame([(0, 1.0, 8, 8), (2, 1.0, 8, 8)], "idx bigint, blur double, height int, width int")
    with pytest.raises(ValueError, match="without gaps"):
        images.profile_size(gaps)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decoding_refuses_what_is_ambiguous(spark, limit):
    vocab = spark.createDataFrame([(1, "a"), (2, "b")], "id int, token string")
    rows = spark.createDataFrame([(1, [1, 2]), (1, [2])], "k int, ids array<int>")
    with pytest.raises(ValueError, match="rows to decode"):
        evaluate.decode_ids(rows, "k", "ids", vocab, broadcast_bytes=limit)
    with pytest.raises(ValueError, match="vocabulary"):
        evaluate.decode_ids(rows.limit(1), "k", "ids", vocab.union(vocab), broadcast_bytes=limit)


def test_written_rows_are_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    rows = spark.range(1000).select(counted("id").alias("media"), F.col("id").alias("pos"), F.lit("train").alias("split"))
    sinks.write_prepared(rows, str(tmp_path / "out"), shards=4)
    assert calls.value == 1000
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and len(list((tmp_path / "out/split=train").glob("*.parquet"))) == 4


def test_job_from_a_dict_takes_everything(spark):
    job = JobSpec.from_dict(
        {
            "dataset_name": ["a", "b"],
            "dataset_path": ["/x", "/y"],
            "format": ["parquet", "json"],
            "options": {"multiLine": "true"},
            "schema": [None, "id bigint"],
            "image_type": "struct<bytes:binary,path:string>",
            "id_column": "id",
            "seed": 1,
            "degrade": {"probability": 0.5},
        }
    )
    assert [d.format for d in job.datasets] == ["parquet", "json"] and job.datasets[1].options == {"multiLine": "true"}
    assert job.datasets[0].schema is None and job.degrade.probability == 0.5


def test_stream_degrades_like_a_batch_and_leaves_nothing_staged(spark, tmp_path):
    from lumenprep.operators.staging import staging_root
    from lumenprep.sources.schema import IMAGE
    from lumenprep.streaming import streams

    picture = F.struct(F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("data")).cast(IMAGE)
    rows = spark.range(60).select("id", F.pmod("id", F.lit(2)).cast("int").alias("label"), F.array(picture).alias("images"))
    rows = rows.withColumn("images", F.transform("images", lambda i: i.withField("data", F.substring(i["data"], 1, 64))))
    rows.write.parquet(str(tmp_path / "set/train"))
    spec_ = DatasetSpec("a", path=str(tmp_path / "set"), id_column="id", schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    profile = spark.createDataFrame([(0, 1.0, 8, 8), (1, 50.0, 16, 4)], "idx bigint, blur double, height int, width int")
    params = images.DegradeParams(probability=0.7)
    prepared = streams.prepare_stream([(spec_, streams.read_stream(spark, spec_, "train"))], profile=profile, params=params, seed=5)
    root = staging_root(spark).removeprefix("file:")
    staged = set(os.listdir(root)) if os.path.isdir(root) else set()
    streams.write_stream(prepared, str(tmp_path / "out"), str(tmp_path / "check"), n_datasets=1).awaitTermination()
    assert (set(os.listdir(root)) if os.path.isdir(root) else set()) == staged
    got = spark.read.parquet(str(tmp_path / "out"))
    job = JobSpec([spec_], seed=5, degrade=params)
    want = prepare(spark, job, profile=profile)
    take = lambda df: sorted((r.example_id, r.pos, bytes(r.images[0].data)) for r in df.collect())
    assert take(got) == take(want) and len(take(got)) == 60
