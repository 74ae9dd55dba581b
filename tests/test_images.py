"""Pixel kernels against direct loops, and the degradation chain."""

from __future__ import annotations

import subprocess
import sys
import zlib

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenprep import DatasetSpec, JobSpec, prepare
from lumenprep.operators import images, pixels
from lumenprep.plans.spec import DegradeParams
from lumenprep.sources import sinks, stats
from lumenprep.sources.schema import ENCODED_IMAGE, IMAGE

RNG = np.random.default_rng(5)


def random_stack(n, h, w, c=3):
    return RNG.integers(0, 256, (n, h, w, c)).astype(np.uint8)


def mirror(i, n):
    return 0 if n == 1 else (-i if i < 0 else (2 * (n - 1) - i if i >= n else i))


@pytest.mark.parametrize("h, w", [(1, 1), (1, 5), (4, 3), (9, 7)])
def test_laplacian_by_loops(h, w):
    stack = random_stack(2, h, w)
    for image, got in zip(stack, pixels.laplacian_variance(stack)):
        g = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                b, gr, r = (int(v) for v in image[y, x])
                g[y, x] = (3735 * b + 19235 * gr + 9798 * r + (1 << 14)) >> 15
        lap = [
            g[mirror(y - 1, h), x] + g[mirror(y + 1, h), x] + g[y, mirror(x - 1, w)] + g[y, mirror(x + 1, w)] - 4 * g[y, x]
            for y in range(h)
            for x in range(w)
        ]
        assert got == pytest.approx(np.var(lap))


def test_gray_weights_sum_to_one():
    assert sum(pixels.GRAY_WEIGHTS) == 1 << pixels.GRAY_BITS
    assert (pixels.gray(np.full((1, 2, 2, 3), 200, np.uint8)) == 200).all()


def resized_by_loops(plane, n_out):
    """One axis (the last) of a plane, with the triangle filter in plain numbers."""
    n_in = plane.shape[-1]
    ratio = n_in / n_out
    reach = max(1.0, ratio)
    out = np.zeros(plane.shape[:-1] + (n_out,))
    for o in range(n_out):
        centre = (o + 0.5) * ratio
        weights = {p: max(0.0, 1 - abs((p + 0.5 - centre) / reach)) for p in range(n_in)}
        total = sum(weights.values())
        out[..., o] = sum(plane[..., p] * w / total for p, w in weights.items())
    return np.clip(np.floor(out + 0.5), 0, 255)


@pytest.mark.parametrize("size", [(8, 8), (3, 20), (16, 5), (1, 1), (11, 13)])
def test_resize_by_loops(size):
    stack = random_stack(2, 9, 12)
    got = pixels.resize(stack, *size)
    across = resized_by_loops(stack.transpose(0, 1, 3, 2).astype(float), size[1])
    down = resized_by_loops(across.transpose(0, 3, 2, 1), size[0]).transpose(0, 3, 1, 2)
    assert got.shape == (2, *size, 3)
    assert np.abs(got.astype(int) - down).max() <= 1
    assert (pixels.resize(np.full((1, 6, 7, 3), 77, np.uint8), *size) == 77).all()


def test_resize_to_same_size_is_identity():
    stack = random_stack(1, 5, 6)
    assert (pixels.resize(stack, 5, 6) == stack).all()


def test_blur_kernel_and_mean():
    assert pixels.blur_kernel(0.3).tolist() == [1, 254, 1]
    assert pixels.blur_kernel(2.0).sum() == 256
    flat = np.full((1, 5, 5, 3), 131, np.uint8)
    assert (pixels.gaussian_blur(flat, 0.3) == flat).all()
    stack = random_stack(3, 20, 20)
    for sigma in (0.3, 1.5):
        assert abs(pixels.gaussian_blur(stack, sigma).mean() - stack.mean()) < 2
    assert pixels.laplacian_variance(pixels.gaussian_blur(stack, 1.5)).max() < pixels.laplacian_variance(stack).min()


def test_noise():
    image = np.full((100, 100, 3), 128, np.uint8)
    noisy = pixels.add_noise(image, 5, 1).astype(int) - 128
    assert abs(noisy.mean()) < 0.1 and abs(noisy.std() - 5) < 0.1
    assert (pixels.add_noise(image, 5, 1) == pixels.add_noise(image, 5, 1)).all()
    assert (pixels.add_noise(image, 5, 1) != pixels.add_noise(image, 5, 2)).any()
    assert (pixels.add_noise(image, 0, 1) == image).all()
    red = pixels.add_noise(image, 5, 1, "first")
    assert (red[..., :2] == 128).all() and (red[..., 2] != 128).any()
    assert pixels.add_noise(np.full((9, 9, 3), 255, np.uint8), 5, 1).max() == 255


def test_recompress():
    flat = np.full((2, 20, 30, 3), 90, np.uint8)
    quality = np.array([70, 94])
    assert np.abs(pixels.recompress(flat, quality).astype(int) - 90).max() <= 2
    ramp = np.linspace(0, 255, 40)[None, :, None, None] * np.ones((1, 40, 33, 3))
    noisy = np.clip(ramp + RNG.normal(0, 12, ramp.shape), 0, 255).astype(np.uint8)
    error = [np.abs(pixels.recompress(noisy, np.array([q])).astype(float) - noisy).mean() for q in (10, 70, 94)]
    assert error[0] > error[1] > error[2]
    both = pixels.recompress(np.concatenate([noisy, noisy]), np.array([70, 94]))
    assert (both[0] == pixels.recompress(noisy, np.array([70]))[0]).all()
    assert (both[1] == pixels.recompress(noisy, np.array([94]))[0]).all()


def test_tables():
    assert pixels.quantisation_tables(np.array([50]), pixels.LUMA_TABLE)[0][0, :3].tolist() == [16, 11, 10]
    assert (pixels.quantisation_tables(np.array([100]), pixels.LUMA_TABLE) == 1).all()
    assert pixels.quantisation_tables(np.array([1]), pixels.CHROMA_TABLE).max() == 255


def image_row(pixels_):
    h, w, c = pixels_.shape
    return ("o", h, w, c, {1: 0, 3: 16, 4: 24}[c], pixels_.tobytes())


def back(image):
    return np.frombuffer(bytes(image["data"]), np.uint8).reshape(image["height"], image["width"], image["nChannels"])


@pytest.fixture(scope="module")
def pictures(spark):
    """Rows with none, one or three images of mixed sizes."""
    rows = []
    for i in range(120):
        size = (8 + i % 3, 10 + i % 4)
        n = (1, 3, 0)[i % 3]
        pics = [image_row(random_stack(1, *size, c=(3, 1)[i % 5 == 0])[0]) for _ in range(n)]
        rows.append((f"k{i}", pics if i % 7 else (pics or None), i % 2, i % 4 != 1, "eval" if i % 10 == 9 else "train"))
    schema = f"example_id string, images array<{IMAGE}>, label int, degrade_fake boolean, split string"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def by_key(df):
    return {r["example_id"]: r["images"] and [(i["height"], i["width"], bytes(i["data"])) for i in r["images"]] for r in df.collect()}


@pytest.fixture(scope="module")
def profile(spark, pictures):
    return images.real_profile(pictures, "example_id").cache()


def test_profile(pictures, profile):
    want = {}
    for r in pictures.where("label = 0").collect():
        for i, image in enumerate(r["images"] or []):
            want[(r["example_id"], i)] = pixels.laplacian_variance(back(image)[None])[0]
    got = profile.orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(len(want)))
    assert [r["blur"] for r in got] == pytest.approx([want[k] for k in sorted(want)])


def test_degrade_touches_only_what_it_should(pictures, profile):
    params = DegradeParams(probability=1.0)
    before, after = by_key(pictures), by_key(images.degrade(pictures, profile, params, 3))
    rows = {r["example_id"]: r for r in pictures.collect()}
    for key, row in rows.items():
        needed = row["label"] == 1 and row["degrade_fake"] and row["split"] == "train" and row["images"]
        if needed:
            assert len(after[key]) == len(before[key])
            assert all(a != b for a, b in zip(after[key], before[key]))
        else:
            assert after[key] == before[key]
    with_eval = by_key(images.degrade(pictures, profile, params, 3, needed=images.needs_degradation(True)))
    assert any(with_eval[k] != before[k] for k, r in rows.items() if r["split"] == "eval" and r["images"])


def test_images_of_a_row_differ(pictures, profile):
    """Each image gets its own choices, and is degraded itself."""
    same = pictures.withColumn("images", F.transform("images", lambda i: F.col("images")[0]))
    done = by_key(images.degrade(same, profile, DegradeParams(probability=1.0), 3))
    fakes = [r["example_id"] for r in pictures.where("label = 1 AND degrade_fake AND split = 'train' AND size(images) = 3").collect()]
    assert fakes and all(len(set(done[k])) == 3 for k in fakes)


def test_large_profile_gives_the_same(pictures, profile):
    params = DegradeParams(probability=0.5)
    small = by_key(images.degrade(pictures, profile, params, 3))
    large = by_key(images.degrade(pictures, profile, params, 3, broadcast_rows=0))
    assert small == large


def test_chain_equals_kernels(pictures, profile):
    """The chain against the kernels called one by one with the stored plan."""
    params = DegradeParams(probability=0.6)
    fakes = pictures.where("label = 1 AND degrade_fake AND split = 'train' AND size(images) > 0")
    plans = images.plan_rows(fakes, "example_id", F.size("images"), profile, params, 3).collect()
    before = {r["example_id"]: r["images"] for r in fakes.collect()}
    after = by_key(images.degrade(pictures, profile, params, 3))
    for row in plans:
        image, plan = back(before[row["example_id"]][row["image_pos"]]), row["plan"]
        if plan["resize"]:
            h, w = image.shape[:2]
            scale = (row["target_h"] * row["target_w"] / (h * w)) ** 0.5
            image = pixels.resize(image[None], max(1, int(h * scale)), max(1, int(w * scale)))[0]
        if plan["blur"] and pixels.laplacian_variance(image[None])[0] > 1.2 * row["target_blur"]:
            image = pixels.gaussian_blur(image[None], 0.3)[0]
        if plan["noise"]:
            image = pixels.add_noise(image, 5, plan["noise_seed"])
        if plan["jpeg"]:
            image = pixels.recompress(image[None], np.array([plan["quality"]]))[0]
        assert after[row["example_id"]][row["image_pos"]] == (*image.shape[:2], image.tobytes())


def test_gate_rates(spark):
    plan = images.draw_plan(F.col("id"), (10, 10), DegradeParams(), 3)
    row = spark.range(20_000).select(plan.alias("p")).agg(
        *[F.avg(F.col(f"p.{g}").cast("int")).alias(g) for g in ("resize", "blur", "noise", "jpeg")],
        F.avg((F.col("p.resize") | F.col("p.blur") | F.col("p.noise") | F.col("p.jpeg")).cast("int")).alias("any"),
        F.min("p.quality").alias("lo"),
        F.max("p.quality").alias("hi"),
    ).first()
    assert all(abs(row[g] - 0.2) < 0.02 for g in ("resize", "blur", "noise", "jpeg"))
    assert abs(row["any"] - (1 - 0.8**4)) < 0.02
    assert (row["lo"], row["hi"]) == (70, 94)


def test_empty_profile(pictures, profile):
    with pytest.raises(ValueError, match="empty"):
        images.degrade(pictures, profile.where("idx < 0"), DegradeParams(), 3)


def test_pixels_of_real_rows_stay_in_the_jvm(pictures, profile):
    plan = images.degrade(pictures, profile, DegradeParams(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "CASE WHEN" in plan


def test_null_images(spark, pictures):
    df = spark.sql(f"SELECT CAST(NULL AS {IMAGE}) AS image")
    assert df.select(images.blur_estimate(F.col("image"))).first()[0] is None
    assert df.select(images.to_rgb(F.col("image"))).first()[0] is None
    assert df.select(images.gaussian_blur(F.col("image"), 0.3)).first()[0] is None


def test_noise_column(spark):
    df = spark.createDataFrame([(image_row(np.full((4, 4, 3), 100, np.uint8)), 1)], f"image {IMAGE}, seed bigint")
    got = back(df.select(images.add_noise(F.col("image"), 5, F.col("seed"))).first()[0])
    assert (got == pixels.add_noise(np.full((4, 4, 3), 100, np.uint8), 5, 1)).all()


def test_profile_from_arrays_of_different_length(spark, pictures, tmp_path):
    profile = stats.profile_from_arrays(spark, [1.0, 2.0, 3.0], [(4, 5)])
    stats.write_profile(profile, str(tmp_path / "profile"))
    profile = stats.read_profile(spark, str(tmp_path / "profile"))
    assert images.profile_size(profile) == (1, 3)
    params = DegradeParams(probability=1.0)
    fakes = pictures.where("label = 1 AND size(images) > 0")
    plans = images.plan_rows(fakes, "example_id", F.size("images"), profile, params, 3).collect()
    assert {(r["target_h"], r["target_w"]) for r in plans} == {(4, 5)}
    assert {r["target_blur"] for r in plans} == {1.0, 2.0, 3.0}
    small = by_key(images.degrade(pictures, profile, params, 3))
    assert small == by_key(images.degrade(pictures, profile, params, 3, broadcast_rows=0))


def raw_codec():
    """A codec for the test: the sizes, then compressed pixels."""

    def encode(image):
        head = bytes([image["height"], image["width"], image["nChannels"]])
        return head + zlib.compress(bytes(image["data"]))

    def decode(data):
        h, w, c = data[:3]
        return {"height": h, "width": w, "nChannels": c, "mode": 16, "data": zlib.decompress(data[3:])}

    return encode, decode


def test_encoded_images_are_degraded_through_a_codec(spark):
    """A whole job on image files in a table: only fakes of the train part change."""
    encode, decode = raw_codec()
    stacks = random_stack(60, 9, 12)
    rows = [(i, (encode({"height": 9, "width": 12, "nChannels": 3, "data": s.tobytes()}), f"p{i}"), i % 2) for i, s in enumerate(stacks)]
    raw = spark.createDataFrame(rows, "id bigint, image struct<bytes:binary,path:string>, label int")
    profile = stats.profile_from_arrays(spark, [1.0], [(5, 6)])
    spec = DatasetSpec("d", frames={"train": raw}, id_column="id", eval_split=0.2, image_type=ENCODED_IMAGE)
    job = JobSpec([spec], 3, degrade=DegradeParams(probability=1.0))
    out = prepare(spark, job, profile, codec=(decode, encode)).collect()
    assert len(out) == 60
    for r in out:
        before = stacks[int(r["example_id"].split("/")[-1])]
        after = back(decode(bytes(r["images"][0]["bytes"])))
        if r["label"] == 1 and r["split"] == "train":
            assert after.shape != before.shape
        else:
            assert (after == before).all()
        assert r["images"][0]["path"] == f"p{r['example_id'].split('/')[-1]}"
    with pytest.raises(ValueError, match="encoded"):
        prepare(spark, job, profile)


# --- output of a batch -------------------------------------------------------------------


def test_pieces():
    assert list(images.pieces(np.array([3, 3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(images.pieces(np.array([], int), 6)) == [] and list(images.pieces(np.zeros(5, int), 6)) == [(0, 5)]


def test_small_pieces_give_the_same(spark, pictures, profile):
    params = DegradeParams(probability=0.7)
    whole = by_key(images.degrade(pictures, profile, params, 3))
    for limit in (1, 700):
        assert by_key(images.degrade(pictures, profile, params, 3, output_bytes=limit)) == whole
    each = pictures.select("example_id", F.posexplode_outer("images").alias("i", "image"), F.pmod(F.hash("example_id"), F.lit(20)).alias("h"))
    sized = lambda limit: each.select("example_id", "i", images.resize_image(F.col("image"), F.when(F.col("h") > 0, F.col("h")), F.lit(9), limit).alias("image"))
    plain = lambda df: sorted((r.example_id, r.i, r.image and bytes(r.image["data"])) for r in df.collect() if r.i is not None)
    assert plain(sized(1)) == plain(sized(1 << 26)) and len(plain(sized(1))) > 100


def test_codecs_cut_their_output(spark):
    encode, decode = raw_codec()
    rows = spark.createDataFrame([(i, [image_row(x) for x in random_stack(i % 3, 6, 5)] if i % 5 else None) for i in range(40)], f"k int, images array<{IMAGE}>")
    packed = rows.select("k", sinks.encode_images(F.col("images"), encode, 10).alias("images"))
    opened = packed.select("k", sinks.decode_images(F.col("images"), decode, 100).alias("images"))
    plain = lambda df: {r.k: r.images and [bytes(i["data"]) for i in r.images] for r in df.collect()}
    assert plain(opened) == plain(rows)


def test_planned_shapes_are_those_that_come_out(spark, pictures, profile):
    params = DegradeParams(probability=0.7)
    fakes = pictures.where("label = 1 AND degrade_fake AND split = 'train' AND size(images) > 0")
    after = by_key(images.degrade(pictures, profile, params, 3))
    for r in images.plan_rows(fakes, "example_id", F.size("images"), profile, params, 3).join(fakes, "example_id").collect():
        flat = pa.array([r["images"][r["image_pos"]].asDict()], sinks._IMAGES.value_type)
        plan = {k: np.array([r["plan"][k]]) for k in ("resize", "jpeg")}
        h, w, size = images.planned_shapes(flat, plan, tuple(np.array([r[t]]) for t in ("target_h", "target_w", "target_blur")))
        got = after[r["example_id"]][r["image_pos"]]
        assert (h[0], w[0], size[0]) == (got[0], got[1], len(got[2]))


SMALL_WORKER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from lumenprep.operators import images
from lumenprep.sources.schema import IMAGE
spark = (
    SparkSession.builder.master("local[1]").config("spark.executor.pyspark.memory", "2400m").config("spark.driver.memory", "3g")
    .config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
image = F.struct(F.lit("").alias("origin"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(3).alias("nChannels"),
                 F.lit(16).alias("mode"), F.unhex(F.repeat(F.lit("40"), 64 * 64 * 3)).alias("data")).cast(IMAGE)
rows = spark.range(0, 60, 1, 1).select(image.alias("image"))
large = rows.select(images.resize_image(F.col("image"), F.lit(3000), F.lit(4000), output_bytes={limit}).alias("image"))
print("BYTES", large.agg(F.sum(F.octet_length("image.data"))).first()[0])
"""


@pytest.mark.parametrize("limit, fits", [(64 << 20, True), (1 << 40, False)])
def test_memory_is_bounded_by_the_piece(limit, fits):
    """60 images of 64x64 towards 12 megapixels each: 2.2 GB from one batch, in a worker that may take 2.4 GB, libraries included; what it returns is copied once."""
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", SMALL_WORKER.format(root=root, limit=limit)], capture_output=True, text=True, timeout=300)
    assert (f"BYTES {60 * 3000 * 4000 * 3}" in run.stdout) == fits, run.stderr[-2000:]
