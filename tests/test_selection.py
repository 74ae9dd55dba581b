"""Places found by counting, ranks and columns joined by keys alone, samples that merge, streams whose places go on."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from lumenprep.operators import images, index, rows
from lumenprep.operators.selection import selectable
from lumenprep.sources import sinks, stats
from lumenprep.sources.schema import ENCODED_IMAGE
from lumenprep.sources.slices import ends_by_counting, ends_by_sort, slice_rows
from lumenprep.plans.spec import DatasetSpec
from lumenprep.streaming import streams
from registry.fixtures import gray_images


def keys_of(kind, rng):
    if kind == "numbers":
        return [("", i) for i in rng.sample(range(-(10**18), 10**18), 300)] + [("", -(2**63)), ("", 2**63 - 1)]
    if kind == "dense":
        return [("", i) for i in range(500)]
    if kind == "texts":
        return [(f"photos/train/{i:06d}é{i % 7}", 0) for i in rng.sample(range(10**6), 300)] + [("photos", 0), ("", 0), ("ü", 0), ("\U0001f600", 0), ("￿", 0)]
    return [(f"file{f}", i) for f, n in (("a", 300), ("b", 1), ("cc", 90)) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"buckets": 4, "sort_rows": 5}, {"buckets": 64, "sort_rows": 0}])
@pytest.mark.parametrize("kind", ["numbers", "dense", "texts", "files"])
def test_keys_by_counting(spark, kind, options):
    rng = random.Random(3)
    keys = keys_of(kind, rng)
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "src_file string, src_row bigint").repartition(5)
    order = ["src_file", "src_row"]
    n, at = ends_by_counting(df, order, **options)
    want = sorted(keys, key=lambda k: (k[0].encode(), k[1]))
    places = sorted({0, n - 1, n // 2, *rng.sample(range(n), 4)})
    assert n == len(keys) and at(places) == {p: list(want[p]) for p in places} and at([]) == {}


def test_slices_by_counting_equal_those_by_sorting(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("wide").alias("text")).dropDuplicates(["k"])
    for text in ("train[:2%]+train[-2%:]+train[35%:65%]", "train[10:-10]", "train[5:5]", "train"):
        rows_of = lambda ends: sorted(map(tuple, slice_rows(df, text, ["k"], ends=ends).collect()))
        assert rows_of(ends_by_counting) == rows_of(ends_by_sort)


def test_other_keys_are_sorted(spark):
    df = spark.createDataFrame([(0.5,), (0.1,)], "k double")
    assert not selectable(df, ["k"]) and ends_by_counting(df, ["k"])[1]([1]) == {1: [0.5]}
    with pytest.raises(ValueError, match="no order key"):
        ends_by_counting(spark.createDataFrame([(1,), (None,)], "k int"), ["k"])


def wide(spark, n):
    """Rows with a column that would show in a staged table."""
    return spark.range(n).select((F.col("id") * 37 % 101).alias("k"), (F.col("id") % 3).alias("g"), F.lit("x").alias("media"))


def staged_columns(monkeypatch, *modules):
    from lumenprep.operators import staging

    seen = []

    def spy(df, name):
        seen.extend(df.columns)
        return staging.stage(df, name)

    for m in modules:
        monkeypatch.setattr(m, "stage", spy)
    return seen


def test_ranks_write_keys_alone(spark, monkeypatch):
    seen = staged_columns(monkeypatch, index)
    got = index.rank_within(wide(spark, 100), "g", ["k"]).collect()
    assert "media" not in seen and len(got) == 100
    for g in range(3):
        mine = sorted((r.k, r["rank"]) for r in got if r.g == g)
        assert [x for _, x in mine] == list(range(1, len(mine) + 1))


def test_columns_beside_rows_write_keys_alone(spark, monkeypatch):
    seen = staged_columns(monkeypatch, index, rows)
    values = spark.range(100).select((100 - F.col("id")).alias("at"), F.concat(F.lit("v"), 100 - F.col("id")).alias("value"), F.lit("y").alias("media"))
    got = rows.add_column(wide(spark, 100), values, ["k"], ["at"])
    assert "media" not in seen and "value" not in seen and got.columns == ["k", "g", "media", "at", "value"]
    listed = sorted((r.k, r.at, r.value, r.media) for r in got.collect())
    assert [(a, v, m) for _, a, v, m in listed] == [(i, f"v{i}", "x") for i in range(1, 101)]
    with pytest.raises(ValueError, match="99 values for 100 rows"):
        rows.add_column(wide(spark, 100), values.where("at > 1"), ["k"], ["at"])
    with pytest.raises(ValueError, match="share their order keys"):
        rows.add_column(wide(spark, 100).withColumn("k", F.lit(1)), values, ["k"], ["at"])


def test_null_keys_have_a_place(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c")], "k int, t string")
    values = spark.createDataFrame([(10,), (20,), (30,)], "v int")
    assert sorted((r.t, r.v) for r in rows.add_column(df, values, ["k"], ["v"]).collect()) == [("a", 10), ("b", 30), ("c", 20)]
    assert sorted((r.t, r["rank"]) for r in index.rank_within(df, "k", ["t"]).collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_samples_merge(spark, sf_dir, tmp_path):
    rows_ = gray_images(spark, sf_dir).withColumn("images", F.array("image"))
    whole = images.sampled_profile(rows_, "vec_id", 30, 7)
    assert images.profile_size(whole) == (30, 30)
    halves = [images.sampled_profile(rows_.where(c), "vec_id", 30, 7) for c in ("vec_id % 3 = 0", "vec_id % 3 > 0")]
    stats.write_profile(halves[0], str(tmp_path / "half"))
    merged = images.merge_profiles([stats.read_sample(spark, str(tmp_path / "half")), halves[1]], 30)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    assert stats.read_profile(spark, str(tmp_path / "half")).columns == ["idx", "blur", "height", "width"]
    more = images.sampled_profile(rows_, "vec_id", 10**6, 7)
    assert more.count() == rows_.where("label = 0").count()


def test_places_of_a_stream_go_on(spark, tmp_path):
    """Two files a dataset, a file of each a micro-batch, then a restart with one more: the places of a batch job."""
    schema = "id bigint, label int, video string"
    sources = {name: str(tmp_path / name) for name in ("a", "b")}

    def add(lo, hi):
        for path in sources.values():
            part = spark.range(lo, hi).select("id", F.lit(0).alias("label"), F.lit("v").alias("video"))
            part.coalesce(1).write.mode("append").parquet(f"{path}/train")

    def run():
        datasets = [DatasetSpec(n, path=p, schema=schema, id_column="id", image_type=ENCODED_IMAGE) for n, p in sources.items()]
        rows_ = streams.prepare_stream([(d, streams.read_stream(spark, d, "train", max_files=1)) for d in datasets])
        streams.write_stream(rows_, str(tmp_path / "out"), str(tmp_path / "state"), n_datasets=2, continued=True).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()

    add(0, 5)
    run()
    add(5, 12)
    out = run()
    want = [(p, f"{n}/train/{i}") for p, (i, n) in enumerate((i, n) for i in range(12) for n in ("a", "b"))]
    assert [(r.pos, r.example_id) for r in out] == want and len({r.micro_batch for r in out}) >= 2


def test_checked_rows(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("x"))
    counts = sinks.write_checked(df, str(tmp_path / "out"), F.col("x") == 2, {"n_none": F.col("x").isNull()})
    assert counts == {"n_rows": 100, "n_bad": df.where("x = 2").count(), "n_none": 10}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("bad = 1").count() == counts["n_bad"] and back.where("bad = 0").count() == 100 - counts["n_bad"]
    with pytest.raises(ValueError, match="column named bad"):
        sinks.write_checked(df.withColumn("Bad", F.lit(1)), str(tmp_path / "x"), F.lit(True))
