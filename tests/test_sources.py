"""Slices, specs, schemas and files."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep import DatasetSpec, JobSpec, prepare
from lumenprep.functions.labels import cast_label
from lumenprep.operators import collate, index, rows, split
from lumenprep.operators.staging import clear_staged, shared_folder, stage
from lumenprep.plans.spec import DegradeParams, check_eval_split
from lumenprep.sources import load, media, schema, sinks, slices
from lumenprep.sources.slices import parse_slices, slice_rows


@pytest.mark.parametrize(
    "text, n, want",
    [
        ("train[:2%]+train[-2%:]", 1000, [(0, 20), (980, 1000)]),
        ("train[:50%]", 5, [(0, 2)]),  # half to even
        ("train[10:20]", 15, [(10, 15)]),
        ("train[-3:]", 10, [(7, 10)]),
        ("train[:-3]", 10, [(0, 7)]),
        ("train[5:2]", 10, [(5, 5)]),
        ("train[-20:]", 10, [(0, 10)]),
        ("train", 10, [(0, 10)]),
        ("train[1%:2%](pct1_dropremainder)", 250, [(2, 4)]),
    ],
)
def test_slice_bounds(text, n, want):
    assert [t.bounds(n) for t in parse_slices(text)] == want


@pytest.mark.parametrize("text", ["train[", "train[1%:2]", "train[:120%]", "", "train[a:b]"])
def test_bad_slices(text):
    with pytest.raises(ValueError):
        parse_slices(text)


def test_slice_rows_filters_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).withColumn("text", F.lit("x")).write.parquet(path)
    df = spark.read.parquet(path)
    got = slice_rows(df, "t[:10]+t[5:15]+t[-1:]+t[3:3]", ["id"])
    found = sorted((r["slice_term"], r["id"]) for r in got.collect())
    assert found == [(0, i) for i in range(10)] + [(1, i) for i in range(5, 15)] + [(2, 999)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,5)" in plan and "Exchange" not in plan


def test_slice_by_two_columns(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in "xyz"], "a int, b string")
    got = slice_rows(df, "t[2:8]", ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(0, "z"), (1, "x"), (1, "y"), (1, "z"), (2, "x"), (2, "y")]


def test_cast_label(spark):
    df = spark.createDataFrame([("Real",), ("Fake",), ("1",), ("0",), (None,)], "label string")
    assert [r[0] for r in df.select(cast_label(F.col("label"))).collect()] == [0, 1, 1, 0, None]


@pytest.mark.parametrize("value, kind", [("2", "int"), ("'real'", "string"), ("-1", "bigint"), ("'3'", "string")])
def test_bad_label_fails(spark, value, kind):
    df = spark.sql(f"SELECT CAST({value} AS {kind}) AS label")
    for integral in {False, kind != "string"}:
        with pytest.raises(Exception, match="not a class label"):
            df.select(cast_label(F.col("label"), integral=integral)).collect()


def test_reconcile(spark):
    df = spark.sql("SELECT 'e' AS example_id, named_struct('bytes', X'01', 'path', 'p') AS image, 'Fake' AS label, 5 AS extra")
    out = schema.reconcile(df, {"dataset": "d", "degrade_fake": True}, schema.ENCODED_IMAGE)
    assert out.columns == schema.signature(schema.ENCODED_IMAGE).fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in schema.signature(schema.ENCODED_IMAGE)]
    row = out.first()
    assert row["label"] == 1 and row["images"][0]["path"] == "p" and row["video"] is None
    assert out.schema["label"].metadata == {"names": ["Real", "Fake"]}


def test_reconcile_refuses_bad_casts(spark):
    df = spark.sql("SELECT 'x' AS example_id, 'no' AS ds_pos, 0 AS label")
    with pytest.raises(Exception):
        schema.reconcile(df).collect()


def test_is_conversational():
    chat = T.StructType.fromJson(
        {"type": "struct", "fields": [{"name": "prompt", "nullable": True, "metadata": {}, "type": {
            "type": "array", "containsNull": True, "elementType": {"type": "struct", "fields": [
                {"name": n, "type": "string", "nullable": True, "metadata": {}} for n in ("role", "content")]}}}]}
    )
    assert schema.is_conversational(chat)
    assert not schema.is_conversational(T.StructType([T.StructField("prompt", T.StringType())]))
    assert not schema.is_conversational(T.StructType([]))
    assert not schema.completion_only_default(chat)
    assert schema.completion_only_default(chat, True)


def test_specs():
    job = JobSpec.from_dict(
        {
            "dataset_name": ["a", "b"],
            "dataset_path": ["/a", "/b"],
            "dataset_config": ["c", None],
            "train_split": "train",
            "eval_split": [0.1, None],
            "degrade_fake": [True, False],
            "seed": 1,
        }
    )
    assert [d.config for d in job.datasets] == ["c", None]
    assert [d.eval_split for d in job.datasets] == [0.1, None]
    assert [d.degrade_fake for d in job.datasets] == [True, False]
    assert JobSpec.from_dict({"dataset_name": "a", "eval_split": "test", "seed": 1}).datasets[0].eval_split == "test"
    with pytest.raises(ValueError, match="unknown"):
        JobSpec.from_dict({"dataset_name": "a", "max_epochs": 3, "seed": 1})
    with pytest.raises(ValueError, match="entries"):
        JobSpec.from_dict({"dataset_name": ["a", "b"], "eval_split": [0.1], "seed": 1})
    for bad in (1, True, 1.5, [0.1]):
        with pytest.raises(ValueError):
            check_eval_split(bad)
    with pytest.raises(ValueError, match="stream"):
        check_eval_split(0.1, streaming=True)
    with pytest.raises(ValueError):
        JobSpec([DatasetSpec("a", path="/a")], 1, mix="zip")
    with pytest.raises(ValueError):
        DegradeParams(noise_channels="green")
    assert DegradeParams().noise_sigma == 5


def labelled_rows(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))


def test_files_without_ids(spark, tmp_path):
    """Rows of Parquet files are keyed by file and row; slices and named eval splits work."""
    labelled_rows(spark, 100).repartition(3).write.parquet(str(tmp_path / "ds" / "cfg" / "train"))
    labelled_rows(spark, 10, 500).write.parquet(str(tmp_path / "ds" / "cfg" / "test"))
    labelled_rows(spark, 20, 900).write.json(str(tmp_path / "other" / "train"))
    specs = [
        DatasetSpec("ds", path=str(tmp_path / "ds"), config="cfg", train_split="train[:30%]+train[-10:]", eval_split="test"),
        DatasetSpec("other", path=str(tmp_path / "other"), format="json", schema="id bigint, label int", id_column="id", eval_split=0.25),
    ]
    out = prepare(spark, JobSpec(specs, 3, mix="interleave"))
    counts = {(r["dataset"], r["split"]): r["count"] for r in out.groupBy("dataset", "split").count().collect()}
    assert counts == {("ds", "train"): 40, ("ds", "eval"): 10, ("other", "train"): 15, ("other", "eval"): 5}
    for part in ("train", "eval"):
        pos = sorted(r["pos"] for r in out.where(F.col("split") == part).collect())
        assert pos == list(range(len(pos)))
    assert out.select("example_id").distinct().count() == 70


def test_missing_split_and_id(spark):
    frames = {"train": labelled_rows(spark, 3)}
    with pytest.raises(ValueError, match="no split"):
        load.read_split(spark, DatasetSpec("d", frames=frames, id_column="id"), "test")
    with pytest.raises(ValueError, match="id column"):
        load.read_split(spark, DatasetSpec("d", frames=frames), "train")


def test_prompt_policies_and_budget(spark):
    raw = labelled_rows(spark, 12).withColumn(
        "prompt", F.expr("array(named_struct('role', 'user', 'content', 'own'))")
    )
    spec = DatasetSpec("d", frames={"train": raw}, id_column="id", eval_split=0.5)

    def prompts(**options):
        rows = prepare(spark, JobSpec([spec], 3, **options)).collect()
        return {r["prompt"][0]["content"] for r in rows}, len(rows)

    assert prompts() == ({"own"}, 12)
    kept, n = prompts(prompt_policy="regenerate", num_total_samples=4)
    assert n == 10 and kept == {"Is this video real or fake? Answer with one word: Real or Fake."}


def test_dataset_order_of_shuffle_does_not_depend_on_partitions(spark):
    def order(parts):
        spec = DatasetSpec("d", frames={"train": labelled_rows(spark, 200).repartition(parts)}, id_column="id", eval_split=0.1)
        rows = prepare(spark, JobSpec([spec], 3, shuffle=True)).collect()
        return sorted((r["split"], r["pos"], r["example_id"]) for r in rows)

    assert order(1) == order(4) == order(17)


def png(pixels, color_type):
    """A PNG file from rows of bytes."""

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    height = len(pixels)
    width = len(pixels[0]) // {0: 1, 2: 3, 6: 4}[color_type]
    head = struct.pack(">IIBBBBB", width, height, 8, color_type, 0, 0, 0)
    data = zlib.compress(b"".join(b"\x00" + bytes(r) for r in pixels))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def test_image_scan(spark, tmp_path):
    (tmp_path / "color.png").write_bytes(png([[255, 0, 10, 1, 2, 3]], 2))
    (tmp_path / "gray.png").write_bytes(png([[7, 8], [9, 10]], 0))
    (tmp_path / "alpha.png").write_bytes(png([[1, 2, 3, 128]], 6))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    rows = {r["path"].split("/")[-1]: r["image"] for r in media.read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"color.png", "gray.png", "alpha.png"}
    assert bytes(rows["color.png"]["data"]) == bytes([10, 0, 255, 3, 2, 1])
    assert bytes(rows["gray.png"]["data"]) == bytes([7, 7, 7, 8, 8, 8, 9, 9, 9, 10, 10, 10])
    assert bytes(rows["alpha.png"]["data"]) == bytes([3, 2, 1])
    assert all(r["nChannels"] == 3 and r["mode"] == 16 for r in rows.values())


def test_binary_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mp4").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    rows = media.read_binary(spark, str(tmp_path), "*.mp4").collect()
    assert [(r["length"], bytes(r["content"])) for r in rows] == [(5, b"12345")]


def test_sink_order_and_files(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("pos"), F.when(F.col("id") < 90, "train").otherwise("eval").alias("split"))
    path = str(tmp_path / "out")
    sinks.write_prepared(rows.repartition(7), path, shards=4, rows_per_file=10)
    back = spark.read.parquet(path)
    assert back.count() == 100
    sizes = back.groupBy(F.input_file_name()).agg(
        F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    ).collect()
    assert max(r["n"] for r in sizes) <= 10
    assert all(r["hi"] - r["lo"] + 1 == r["n"] for r in sizes)
    assert spark.read.parquet(path).where("split = 'eval'").count() == 10


def test_encode_and_decode_images(spark):
    image = F.expr(
        "array(named_struct('origin', 'o', 'height', 1, 'width', 2, 'nChannels', 1, 'mode', 0, 'data', X'0A0B'))"
    ).cast(f"array<{schema.IMAGE}>")
    df = spark.range(1).select(image.alias("images"))

    def encode(i):
        return base64.b64encode(i["data"])

    def decode(b):
        return {"height": 1, "width": 2, "nChannels": 1, "mode": 0, "data": base64.b64decode(b)}

    encoded = df.select(sinks.encode_images(F.col("images"), encode).alias("images"))
    assert bytes(encoded.first()["images"][0]["bytes"]) == b"Cgs="
    back = encoded.select(sinks.decode_images(F.col("images"), decode).alias("images")).first()["images"][0]
    assert bytes(back["data"]) == b"\x0a\x0b" and back["origin"] == "o"


def test_staging_uses_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(3), "x")
    assert staged.count() == 3
    assert staged.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark))


def test_clear_staged(spark):
    stage(spark.range(3), "x")
    assert clear_staged(spark)
    assert not clear_staged(spark)


def test_map_rows_and_columns_by_position(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, "bb", 9), (3, None, 9)], "id int, t string, unused int").repartition(2)
    out = rows.map_rows(
        df, lambda r: {"n": len(r["t"] or ""), "t": None}, "id int, n int", inputs=["id", "t"], remove_columns=["t"]
    )
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (2, 2), (3, 0)]
    values = spark.createDataFrame([(30, "z"), (10, "x"), (20, "y")], "o int, v string")
    got = rows.add_column(df.select("id"), values, ["id"], ["o"]).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError, match="values for"):
        rows.add_column(df.select("id"), values.where("o > 10"), ["id"], ["o"])


def test_slices_of_whole_files_equal_the_sort(spark, tmp_path):
    """Slice ends from file sizes alone: same rows, and the scan skips the other files."""
    path = str(tmp_path / "ds" / "train")
    spark.range(500).withColumn("label", F.lit(0)).repartition(7).write.parquet(path)
    spec = DatasetSpec("ds", path=str(tmp_path / "ds"))
    raw = load.read_split(spark, spec, "train")
    text = "train[:2%]+train[-2%:]+train[100:300]+train[7:7]"
    order = list(schema.SOURCE_ORDER)
    by_sort = slice_rows(raw, text, order, ends=slices.ends_by_sort)
    by_files = slice_rows(raw, text, order, ends=slices.ends_by_files)
    rows_of = lambda df: sorted((r["slice_term"], r["example_id"]) for r in df.collect())
    assert rows_of(by_files) == rows_of(by_sort)
    assert len(rows_of(by_files)) == 10 + 10 + 200
    indexed = index.file_index(raw).select("example_id", "idx").collect()
    sorted_ = index.global_index(raw.select("example_id", *order), order).select("example_id", "idx").collect()
    assert sorted(map(tuple, indexed)) == sorted(map(tuple, sorted_))
    plan = by_files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    few = slice_rows(raw, "train[:5]", order, ends=slices.ends_by_files)
    assert few.count() == 5
    assert few._jdf.queryExecution().executedPlan().toString().count("file_path") > 0


def test_tokenizer_with_its_own_model(spark):
    """A vectorised function that loads its model once per worker serves as tokenizer."""

    def load_model():
        return {"a": 5}

    @F.pandas_udf("array<int>")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for part in parts:
            yield part.map(lambda t: [model.get(w, 0) for w in t.split()])

    df = spark.createDataFrame([("a b a",)], "text string")
    assert list(collate.tokenise(df, {"text": "ids"}, tokens).first()["ids"]) == [5, 0, 5]


def test_hash_split_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(1000).write.parquet(path)
    stream = split.approximate_hash_split(spark.readStream.schema("id bigint").parquet(path), 0.2, "id", 3)
    out = str(tmp_path / "out")
    stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(
        out, format="parquet"
    ).awaitTermination()
    got = spark.read.parquet(out)
    batch = split.approximate_hash_split(spark.range(1000), 0.2, "id", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert abs(got.where("split = 'eval'").count() - 200) < 50
