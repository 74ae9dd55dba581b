"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprep.functions import draws, labels, messages, sizing, template
from lumenprep.operators import collate, dictionary, evaluate, images, index, mix, report, split
from lumenprep.operators import rows as row_functions
from lumenprep.operators.staging import stage, staged_path
from lumenprep.plans.prepare import prepare
from lumenprep.plans.session import ship_package
from lumenprep.plans.spec import DatasetSpec, DegradeParams, JobSpec
from lumenprep.sources.schema import ENCODED_IMAGE, reconcile
from lumenprep.sources.sinks import write_checked, write_prepared
from lumenprep.sources.slices import slice_rows
from lumenprep.sources.stats import read_profile, read_sample, write_profile
from lumenprep.streaming import streams
from registry.fixtures import (
    LANGUAGES,
    SEED,
    coarse_levels,
    dialogues,
    exchanges,
    frame_size,
    gray_images,
    in_language,
    joined,
    labelled,
    next_turns,
    or_minus_one,
    stream_of,
    table,
    text_image,
)

HELD_OUT = {"en": 0.1, "fr": 0.2, "de": 0.05}
TEMPLATE = template.ChatTemplate()
BATCH = 8

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    REGISTRY[function.__name__] = run
    return function


# --- whole jobs ------------------------------------------------------------------------


def language_datasets(spark: SparkSession, sf_dir: str) -> list[DatasetSpec]:
    """Languages as datasets: English has images, the others videos, each in its own columns."""
    rows = labelled(spark, sf_dir)
    specs = []
    for lang in LANGUAGES:
        media = F.col("text").cast("binary")
        raw = rows.where(in_language(lang)).select("doc_id", "text", "source", "label")
        if lang == "en":
            raw = raw.withColumn("image", F.struct(media.alias("bytes"), F.col("source").alias("path")))
        else:
            raw = raw.withColumn("video", F.base64(media))
        specs.append(
            DatasetSpec(
                lang,
                frames={"train": raw},
                id_column="doc_id",
                eval_split=HELD_OUT.get(lang),
                degrade_fake=lang != "en",
                image_type=ENCODED_IMAGE,
            )
        )
    return specs


def _mixed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    job = JobSpec(language_datasets(spark, sf_dir), SEED, **options)
    return prepare(spark, job).select(
        "split",
        "pos",
        "example_id",
        "dataset",
        "label",
        F.col("prompt")[0]["content"].alias("prompt"),
        F.col("completion")[0]["content"].alias("completion"),
    )


@query
def prepared_interleave(spark, sf_dir):
    return _mixed(spark, sf_dir, mix="interleave")


@query
def prepared_concat(spark, sf_dir):
    return _mixed(spark, sf_dir, mix="concat")


@query
def prepared_shuffle(spark, sf_dir):
    return _mixed(spark, sf_dir, shuffle=True)


@query
def prepared_write(spark, sf_dir):
    """The prepared set written by split and read back."""
    path = staged_path(spark, "prepared")
    job = JobSpec(language_datasets(spark, sf_dir), SEED, mix="interleave")
    write_prepared(prepare(spark, job), path, shards=8, rows_per_file=1000, row_group_bytes=1 << 24)
    back = spark.read.parquet(path)
    return back.select(
        F.col("split").cast("string").alias("split"),
        "pos",
        "example_id",
        or_minus_one(F.octet_length(F.col("images")[0]["bytes"])).alias("image_bytes"),
        or_minus_one(F.length("video")).alias("video_chars"),
    )


@query
def prepared_named_eval(spark, sf_dir):
    """A slice of one split to train on, another split held out, one dataset more."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label", "quality", "lang")
    english = {"train": rows.where("lang = 'en' AND quality = 1"), "test": rows.where("lang = 'en' AND quality = 0")}
    others = {"train": rows.where("lang <> 'en'")}
    specs = [
        DatasetSpec("en", frames=english, id_column="doc_id", train_split="train[:40%]+train[60%:]", eval_split="test"),
        DatasetSpec("others", frames=others, id_column="doc_id", eval_split=0.1, degrade_fake=False),
    ]
    job = JobSpec(specs, SEED, mix="interleave")
    return prepare(spark, job).select("split", "pos", "example_id", "dataset", "label", "degrade_fake")


@query
def prepared_overlap(spark, sf_dir):
    """All labelled documents to train on, their first and last tenth also held out."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label")
    spec = DatasetSpec("docs", frames={"train": rows}, id_column="doc_id", eval_split="train[:10%]+train[-10%:]")
    return prepare(spark, JobSpec([spec], SEED)).select("split", "pos", "example_id", "label")


def _files_by_language(spark: SparkSession, sf_dir: str) -> str:
    """Folder of ``language/default/split`` with the documents in files, in the order of their ids."""
    root = staged_path(spark, "files")
    docs = table(spark, sf_dir, "documents").withColumn("label", F.pmod("doc_id", F.lit(2)).cast("int"))
    for lang in LANGUAGES:
        for name, part in (("train", F.pmod("doc_id", F.lit(10)) > 0), ("test", F.pmod("doc_id", F.lit(10)) == 0)):
            rows = docs.where(in_language(lang) & part).select("doc_id", F.col("text").alias("video"), "label")
            rows.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{root}/{lang}/default/{name}")
    return root


@query
def prepared_files(spark, sf_dir):
    """A job over Parquet files by path, config and split; positions come from the files."""
    root = _files_by_language(spark, sf_dir)
    splits = {"en": ("train[:80%]+train[-10%:]", "test"), "fr": ("train", "test[:50]"), "de": ("train", None), "es": ("train[5:]", "train[:5]")}
    job = JobSpec.from_dict(
        {
            "dataset_name": list(splits),
            "dataset_path": [f"{root}/{lang}" for lang in splits],
            "dataset_config": "default",
            "train_split": [t for t, _ in splits.values()],
            "eval_split": [e for _, e in splits.values()],
            "seed": SEED,
            "mix": "interleave",
        }
    )
    return prepare(spark, job).select(
        "split", "pos", "dataset", "label", F.md5("video").alias("digest"), F.col("completion")[0]["content"].alias("completion")
    )


@query
def prepared_degraded(spark, sf_dir):
    """Real images of many sizes give a stored profile; flagged fakes are degraded towards it, resizing included."""
    rows = gray_images(spark, sf_dir)
    height, width = F.pmod("vec_id", F.lit(13)) + 1, F.pmod("vec_id", F.lit(11)) + 3
    real = rows.where("label = 0").withColumn("image", images.resize_image(F.col("image"), height, width))
    path = staged_path(spark, "profile")
    write_profile(images.real_profile(real.withColumn("images", F.array("image")), "vec_id"), path)
    fakes = rows.where("label = 1")
    specs = [
        DatasetSpec("real", frames={"train": real}, id_column="vec_id", eval_split=0.1),
        DatasetSpec("fake", frames={"train": fakes.where("vec_id % 5 > 0")}, id_column="vec_id", eval_split=0.1),
        DatasetSpec("kept", frames={"train": fakes.where("vec_id % 5 = 0")}, id_column="vec_id", degrade_fake=False),
    ]
    job = JobSpec(specs, SEED, mix="interleave", degrade=DegradeParams(probability=0.5))
    out = prepare(spark, job, read_profile(spark, path), recompress=coarse_levels, output_bytes=1 << 16)
    image = F.col("images")[0]
    return out.select(
        "split", "pos", "example_id", "label", image["height"].alias("height"), image["width"].alias("width"),
        image["nChannels"].alias("channels"), F.hex(image["data"]).alias("pixels"),
    )


# --- sources and schema ----------------------------------------------------------------


@query
def percent_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    picked = slice_rows(docs, "train[:2%]+train[-2%:]+train[35%:65%]", ["doc_id"])
    return picked.select("doc_id", "slice_term", "source", F.length("text").cast("bigint").alias("n"))


@query
def row_slice(spark, sf_dir):
    """Absolute bounds over a two-column order."""
    turns = table(spark, sf_dir, "conversations")
    return slice_rows(turns, "train[10:-10]", ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query
def mix_signature(spark, sf_dir):
    """Three datasets with different columns in one signature."""
    rows = labelled(spark, sf_dir)
    image = F.struct(F.col("text").cast("binary").alias("bytes"), F.col("source").alias("path"))
    with_image = rows.where("lang = 'en'").select("doc_id", image.alias("image"), "label", "n_chars")
    with_video = rows.where("lang = 'fr'").select("doc_id", F.col("text").alias("video"), "label")
    with_prompt = rows.where("lang NOT IN ('en', 'fr')").select(
        "doc_id", messages.message("user", F.col("text")).alias("prompt"), F.col("label").cast("string")
    )
    parts = [
        reconcile(
            raw.withColumn("example_id", F.col("doc_id").cast("string")),
            {"dataset": name, "ds_pos": i, "degrade_fake": i == 0, "split": "train"},
            ENCODED_IMAGE,
        )
        for i, (name, raw) in enumerate(
            [("image", with_image), ("video", with_video), ("prompt", with_prompt)]
        )
    ]
    merged = mix.union_tagged(parts)
    return merged.select(
        "example_id",
        "dataset",
        "ds_pos",
        "label",
        "degrade_fake",
        messages.media_count(F.col("images")).alias("n_images"),
        or_minus_one(F.octet_length(F.col("images")[0]["bytes"])).alias("image_bytes"),
        or_minus_one(F.length("video")).alias("video_chars"),
        F.col("prompt")[0]["content"].alias("prompt"),
        F.col("completion").isNull().alias("no_completion"),
    )


@query
def label_cast(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    name = F.when(F.col("quality") == 1, "Fake").when(F.col("quality") == 0, "Real")
    return rows.select(
        "doc_id",
        labels.cast_label(F.col("toxic")).alias("from_index"),
        labels.cast_label(name).alias("from_name"),
        labels.cast_label(F.col("toxic").cast("string")).alias("from_text"),
        or_minus_one(labels.cast_label(F.nullif(F.col("toxic"), F.lit(1)))).alias("with_null"),
    )


@query
def video_decode(spark, sf_dir):
    """Base64 videos; those of one language are broken."""
    docs = table(spark, sf_dir, "documents")
    encoded = F.base64(F.col("text").cast("binary"))
    video = F.when(F.col("lang") == "de", F.concat(F.lit("*"), encoded)).otherwise(encoded)
    decoded = messages.decode_video(F.col("video"))
    return docs.withColumn("video", video).select(
        "doc_id",
        or_minus_one(F.octet_length(decoded)).alias("n_bytes"),
        F.md5(decoded).alias("digest"),
        messages.bad_video(F.col("video")).alias("bad"),
    )


# --- messages --------------------------------------------------------------------------


@query
def modality_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n_images = F.when(F.col("lang") == "en", 1).otherwise(0)
    kind = messages.modality(n_images)
    return docs.select(
        "doc_id",
        kind.alias("modality"),
        messages.prompt_for(kind)[0]["role"].alias("role"),
        messages.prompt_for(kind)[0]["content"].alias("prompt"),
    )


@query
def completion_from_label(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    inverted = {0: "Fake", 1: "Real"}
    kept = messages.keep_or_derive(
        F.when(F.col("quality") == 0, messages.message("assistant", F.lit("Unsure"))),
        messages.completion_from_label(F.col("toxic")),
        "keep",
    )
    return rows.select(
        "doc_id",
        messages.completion_from_label(F.col("toxic"))[0]["content"].alias("completion"),
        messages.completion_from_label(F.col("toxic"), inverted)[0]["content"].alias("inverted"),
        kept[0]["content"].alias("kept"),
    )


@query
def normalise_messages(spark, sf_dir):
    """Two turns as messages with images and a video, flattened to parts."""
    turns = next_turns(spark, sf_dir)
    plain = F.array(
        F.struct(F.col("role"), F.col("text").alias("content")),
        F.struct(F.col("next_role").alias("role"), F.col("next_text").alias("content")),
    )
    n_images = F.pmod(F.col("conv_id"), F.lit(3)).cast("int")
    has_video = F.pmod(F.col("conv_id"), F.lit(4)) == 0
    done = turns.select(
        "conv_id", "turn", messages.normalise_messages(plain, n_images, has_video).alias("m")
    )
    parts = done.select("conv_id", "turn", F.posexplode("m").alias("message", "m")).select(
        "conv_id", "turn", "message", F.col("m.role").alias("role"), F.posexplode("m.content").alias("part", "p")
    )
    return parts.select(
        "conv_id", "turn", "message", "role", "part", "p.type", "p.text", or_minus_one(F.col("p.media_idx")).alias("media_idx")
    )


@query
def chat_render(spark, sf_dir):
    pairs = exchanges(spark, sf_dir)
    return pairs.select(
        "conv_id",
        "turn",
        template.render_messages(F.col("prompt"), TEMPLATE, add_answer_header=True).alias("prompt_text"),
        template.render_messages(F.concat("prompt", "completion"), TEMPLATE).alias("full_text"),
    )


@query
def chat_render_media(spark, sf_dir):
    """Every turn with two images and a video, rendered with placeholders."""
    turns = table(spark, sf_dir, "conversations")
    plain = F.array(F.struct("role", F.col("text").alias("content")))
    parts = messages.normalise_messages(plain, F.lit(2), F.lit(True))
    return turns.select("conv_id", "turn", template.render_normalised(parts, TEMPLATE).alias("rendered"))


@query
def completion_suffix(spark, sf_dir):
    pairs = chat_render(spark, sf_dir)
    return pairs.select(
        "conv_id",
        "turn",
        template.completion_suffix(F.col("full_text"), F.col("prompt_text")).alias("completion_text"),
    )


@query
def chat_render_conversations(spark, sf_dir):
    """Whole conversations with their system turns."""
    whole = dialogues(spark, sf_dir)
    return whole.select(
        "conv_id",
        template.render_messages(F.col("prompt"), TEMPLATE, add_answer_header=True).alias("prompt_text"),
        template.render_messages(F.concat("prompt", "completion"), TEMPLATE).alias("full_text"),
    )


# --- sizes -----------------------------------------------------------------------------


@query
def resize_plan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    h, w = frame_size(F.col("l_orderkey"), F.col("l_linenumber"))
    new_h, new_w = sizing.resize_plan(F.col("h"), F.col("w"), 262_144, 1_310_720)
    return lines.select("l_orderkey", "l_linenumber", h.alias("h"), w.alias("w")).select(
        "*", new_h.alias("new_h"), new_w.alias("new_w")
    )


@query
def area_matched_size(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    h, w = frame_size(F.col("l_orderkey"), F.col("l_linenumber"))
    new_h, new_w = sizing.area_matched_size(F.col("h"), F.col("w"), F.col("l_quantity") * 10, F.lit(480))
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", h.alias("h"), w.alias("w")).select(
        "l_orderkey", "l_linenumber", new_h.alias("new_h"), new_w.alias("new_w")
    )


@query
def frame_indices(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n_all, last = sizing.frame_range(F.col("n_chars"))
    return docs.select(
        "doc_id",
        n_all.alias("n_all"),
        last.alias("last"),
        joined(sizing.spread_frames(F.col("n_chars"), 30)).alias("spread"),
    )


@query
def run_sizing(spark, sf_dir):
    """Steps per batch size, and the counted run of the labelled documents."""
    n = report.run_size(labelled(spark, sf_dir), 2, 2, epochs=3).first()
    parts = table(spark, sf_dir, "part")
    steps = sizing.run_steps(
        F.lit(700_000), F.col("p_size"), F.lit(2), F.pmod("p_partkey", F.lit(4)) + 1, F.lit(3)
    )
    return parts.select(
        "p_partkey",
        steps.alias("n_steps"),
        F.lit(n["n_samples"]).cast("bigint").alias("labelled_rows"),
        F.lit(n["n_steps"]).cast("bigint").alias("labelled_steps"),
    )


# --- images ----------------------------------------------------------------------------


@query
def blur_estimate(spark, sf_dir):
    rows = gray_images(spark, sf_dir)
    return rows.select("vec_id", F.round(images.blur_estimate(F.col("image")), 6).alias("blur"))


@query
def blur_of_texts(spark, sf_dir):
    """Whole documents as colour images of any height; an empty one has no pixels and no estimate."""
    docs = table(spark, sf_dir, "documents")
    image = text_image(F.col("text"))
    return docs.select("doc_id", F.round(images.blur_estimate(image) + 1e-7, 4).alias("blur"))


@query
def real_profile(spark, sf_dir):
    rows = gray_images(spark, sf_dir).withColumn("images", F.array("image"))
    profile = images.real_profile(rows, "vec_id")
    return profile.select("idx", F.round("blur", 6).alias("blur"), "height", "width")


@query
def profile_sample(spark, sf_dir):
    """A sample of the real images, from two stored samples of halves of them."""
    rows = gray_images(spark, sf_dir).withColumn("images", F.array("image"))
    stored = []
    for half in (0, 1):
        stored.append(staged_path(spark, "sample"))
        write_profile(images.sampled_profile(rows.where(F.pmod(F.col("vec_id"), F.lit(4)) == 2 * half), "vec_id", 100, SEED), stored[-1])
    rest = images.sampled_profile(rows.where("vec_id % 2 = 1"), "vec_id", 200, SEED)
    whole = images.merge_profiles([*[read_sample(spark, path) for path in stored], rest], 100)
    return whole.select("idx", F.round("blur", 6).alias("blur"), "height", "width", "hash")


@query
def checked_messages(spark, sf_dir):
    """Turns with their bad roles set aside and counted in the pass that writes them."""
    turns = table(spark, sf_dir, "conversations")
    path = staged_path(spark, "checked")
    counts = write_checked(turns, path, F.col("role") == "system", {"n_answers": F.col("role") == "assistant", "n_empty": F.col("text") == ""})
    back = spark.read.parquet(path).groupBy((F.col("bad") == 1).alias("bad"), "role").agg(F.count("*").alias("n_turns"))
    return back.withColumns({name: F.lit(n).cast("bigint") for name, n in counts.items()})


@query
def profile_summary(spark, sf_dir):
    rows = gray_images(spark, sf_dir).withColumn("images", F.array("image"))
    summary = images.profile_summary(images.real_profile(rows, "vec_id"))
    return summary.select(
        "n_images",
        F.round("min_blur", 6).alias("min_blur"),
        F.round("max_blur", 6).alias("max_blur"),
        F.round("avg_blur", 4).alias("avg_blur"),
        "avg_area",
        *[F.round(F.col("blur_quantiles")[i], 6).alias(f"blur_q{i}") for i in range(5)],
        *[F.col("area_quantiles")[i].alias(f"area_q{i}") for i in range(5)],
    )


@query
def gaussian_blur(spark, sf_dir):
    rows = gray_images(spark, sf_dir)
    done = images.gaussian_blur(F.col("image"), 0.3)
    return rows.select("vec_id", done.alias("image")).select("vec_id", F.hex("image.data").alias("pixels"))


@query
def resize_pixels(spark, sf_dir):
    rows = gray_images(spark, sf_dir).withColumns(
        {"h": F.pmod("vec_id", F.lit(13)) + 1, "w": F.pmod("vec_id", F.lit(11)) + 3}
    )
    done = images.resize_image(F.col("image"), F.col("h"), F.col("w"))
    return rows.select("vec_id", done.alias("image")).select(
        "vec_id", "image.height", "image.width", F.hex("image.data").alias("pixels")
    )


@query
def jpeg_recompress(spark, sf_dir):
    quality = (draws.pick(F.col("vec_id"), SEED, "quality", 25) + 70).cast("int")
    rows = gray_images(spark, sf_dir).withColumn("quality", quality)
    done = images.recompress(F.col("image"), F.col("quality"))
    return rows.select("vec_id", "quality", done.alias("image")).select(
        "vec_id", "quality", F.col("image.nChannels").alias("channels"), F.hex("image.data").alias("pixels")
    )


@query
def degrade_plan(spark, sf_dir):
    """The choices for two images of every labelled document, with their targets."""
    real = gray_images(spark, sf_dir).withColumn("images", F.array("image"))
    profile = stage(images.real_profile(real, "vec_id"), "profile")
    planned = images.plan_rows(
        table(spark, sf_dir, "labels"), "doc_id", F.lit(2), profile, DegradeParams(), SEED
    )
    return planned.select(
        "doc_id",
        "image_pos",
        "plan.resize",
        F.col("plan.blur").alias("blur"),
        "plan.noise",
        "plan.jpeg",
        "plan.quality",
        "plan.noise_seed",
        "target_h",
        "target_w",
        F.round("target_blur", 6).alias("target_blur"),
    )


@query
def degrade_apply(spark, sf_dir):
    """Fake gray images degraded towards the real ones; no noise, so that SQL can follow."""
    rows = gray_images(spark, sf_dir).select(
        "vec_id",
        "label",
        F.array("image").alias("images"),
        (F.pmod("vec_id", F.lit(5)) > 0).alias("degrade_fake"),
        F.lit("train").alias("split"),
    )
    profile = images.real_profile(rows, "vec_id")
    done = images.degrade(rows, profile, DegradeParams(noise_var=0.0), SEED, key="vec_id")
    image = F.col("images")[0]
    return done.select(
        "vec_id",
        "label",
        F.size("images").alias("n_images"),
        image["nChannels"].alias("channels"),
        F.hex(image["data"]).alias("pixels"),
    )


@query
def degrade_noise(spark, sf_dir):
    """The whole chain with noise, on both images of every row."""
    rows = gray_images(spark, sf_dir).select(
        "vec_id",
        "label",
        F.array("image", "image").alias("images"),
        F.lit(True).alias("degrade_fake"),
        F.lit("train").alias("split"),
    )
    done = images.degrade(rows, images.real_profile(rows, "vec_id"), DegradeParams(), SEED, key="vec_id")
    return done.select("vec_id", "label", F.posexplode("images").alias("image_pos", "image")).select(
        "vec_id",
        "label",
        "image_pos",
        F.col("image.nChannels").alias("channels"),
        F.hex("image.data").alias("pixels"),
    )


# --- splits and order ------------------------------------------------------------------


@query
def seeded_draws(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    key = F.col("doc_id")
    return rows.select(
        "doc_id",
        draws.u01(key, SEED, "draw").alias("u"),
        draws.gate(key, SEED, "gate", 0.2).alias("gate"),
        draws.pick(key, SEED, "pick", 7).alias("pick"),
    )


@query
def stratified_split(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "dataset", "label")
    return split.stratified_split(rows, HELD_OUT, "doc_id", SEED)


@query
def stratified_split_sources(spark, sf_dir):
    """The same fraction in many small datasets, some with one class only."""
    rows = labelled(spark, sf_dir).select("doc_id", F.col("source").alias("dataset"), "label")
    return split.stratified_split(rows, 0.1, "doc_id", SEED)


@query
def random_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.random_split(docs, 0.05, "doc_id", SEED)


@query
def random_split_by_set(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.random_split(docs, 0.01, "doc_id", SEED, by="lang")


@query
def hash_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return split.approximate_hash_split(docs, 0.05, "doc_id", SEED)


def _by_language(spark, sf_dir) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return [docs.where(in_language(lang)) for lang in LANGUAGES]


@query
def concat_sets(spark, sf_dir):
    return mix.concat(_by_language(spark, sf_dir), ["doc_id"])


@query
def interleave_sets(spark, sf_dir):
    return mix.interleave(_by_language(spark, sf_dir), ["doc_id"])


@query
def interleave_wide(spark, sf_dir):
    """The same with the texts joined to the positions."""
    docs = table(spark, sf_dir, "documents")
    sets = [docs.where(in_language(lang)) for lang in LANGUAGES]
    return mix.interleave(sets, ["doc_id"], key="doc_id").select(
        "pos", "doc_id", F.md5("text").alias("digest")
    )


def _files_in_order(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    root = _files_by_language(spark, sf_dir)
    return [mix.source_rows(spark.read.parquet(f"{root}/{lang}/default/train")) for lang in LANGUAGES]


@query
def concat_files(spark, sf_dir):
    """Files one dataset after the other, whole rows, nothing sorted or joined."""
    done = mix.concat_files(_files_in_order(spark, sf_dir))
    return done.select("pos", "ds_pos", "doc_id", F.md5("video").alias("digest"))


@query
def interleave_files(spark, sf_dir):
    """Files of several datasets in turn, whole rows, nothing sorted or joined."""
    done = mix.interleave_files(_files_in_order(spark, sf_dir))
    return done.select("pos", "ds_pos", "doc_id", F.md5("video").alias("digest"))


@query
def interleave_overlap(spark, sf_dir):
    """Two datasets with the same keys."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("kind"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("kind"))
    return mix.interleave([orders, customers], ["key"], key="key").select("ds_pos", "key", "kind", "pos")


@query
def seeded_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return mix.shuffle(docs, "doc_id", SEED)


@query
def sample_budget(spark, sf_dir):
    """A third of the documents in shuffled order, and without the last of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count() // 3
    return mix.drop_last(mix.sample_budget(mix.shuffle(docs, "doc_id", SEED), n), n)


@query
def row_index(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return index.global_index(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query
def rank_within_sets(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return index.rank_within(events, "event_type", ["event_id"])


@query
def batch_ids(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    placed = index.global_index(turns, ["conv_id", "turn"], "pos")
    whole = mix.batches(placed, BATCH, devices=2).withColumnRenamed("device", "device_whole")
    return mix.batches(whole, BATCH, devices=2, split_batches=True)


# --- token batches ---------------------------------------------------------------------


def _tokens(spark, sf_dir) -> DataFrame:
    """Exchanges in batches with the ids of their prompt and completion."""
    pairs = exchanges(spark, sf_dir).select("conv_id", "turn", "text", "next_text")
    keys = index.global_index(pairs.select("conv_id", "turn"), ["conv_id", "turn"], "pos")
    placed = mix.batches(pairs.join(keys, ["conv_id", "turn"]), BATCH)
    return collate.tokenise(
        placed, {"text": "prompt_ids", "next_text": "completion_ids"}, template.word_ids
    )


def _flat(batch: DataFrame, *more: str) -> DataFrame:
    return batch.select(
        "conv_id",
        "turn",
        "batch_id",
        *[joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels", *more)],
        "n_loss_tokens",
    )


@query
def collate_tokens(spark, sf_dir):
    return _flat(collate.collate(_tokens(spark, sf_dir)))


@query
def collate_truncated(spark, sf_dir):
    """At most 60 tokens, batches padded to a multiple of 16, with token types."""
    types = _tokens(spark, sf_dir).withColumns(
        {
            "prompt_types": F.transform("prompt_ids", lambda x: F.lit(0)),
            "completion_types": F.transform("completion_ids", lambda x: F.lit(1)),
        }
    )
    done = collate.collate(
        types, max_length=60, pad_to_multiple_of=16, token_types=("prompt_types", "completion_types")
    )
    return _flat(done, "token_type_ids")


@query
def collate_prepared(spark, sf_dir):
    """Whole conversations with images and videos, rendered, tokenised and collated."""
    whole = dialogues(spark, sf_dir)
    keys = index.global_index(whole.select("conv_id"), ["conv_id"], "pos")
    media = F.struct(F.lit(b"").alias("bytes"), F.lit(None).cast("string").alias("path")).cast(ENCODED_IMAGE)
    rows = mix.batches(whole.join(keys, "conv_id"), BATCH).withColumns(
        {
            "images": F.array_repeat(media, F.pmod("conv_id", F.lit(3)).cast("int")),
            "video": F.when(F.pmod("conv_id", F.lit(4)) == 0, F.lit("")),
        }
    )
    done = collate.collate_prepared(rows, template=TEMPLATE)
    return done.select(
        "conv_id", "batch_id", *[joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")], "n_loss_tokens"
    )


@query
def collate_full_loss(spark, sf_dir):
    return _flat(collate.collate(_tokens(spark, sf_dir), completion_only=False))


@query
def flush_left(spark, sf_dir):
    """Prompts padded on the left to the batch, then moved back."""
    rows = _tokens(spark, sf_dir).withColumn("n", F.size("prompt_ids"))
    rows = rows.withColumn("longest", collate.batch_max(F.col("n")) + 2)
    padded = rows.select(
        "conv_id",
        "turn",
        "batch_id",
        collate.pad_left(F.col("prompt_ids"), F.col("longest"), 0).alias("ids"),
        collate.pad_left(collate.fill(1, F.col("n")), F.col("longest"), 0).alias("mask"),
    )
    done = collate.flush_left(padded, "mask", {"ids": 0})
    return done.select("conv_id", "turn", joined(F.col("ids")).alias("ids"), joined(F.col("mask")).alias("mask"))


def _dialogue_texts(spark, sf_dir) -> DataFrame:
    """Whole conversations in batches, rendered as prompt and completion."""
    whole = dialogues(spark, sf_dir)
    keys = index.global_index(whole.select("conv_id"), ["conv_id"], "pos")
    rows = mix.batches(whole.join(keys, "conv_id"), BATCH).withColumns(
        {"images": F.array().cast(f"array<{ENCODED_IMAGE}>"), "video": F.lit(None).cast("string")}
    )
    return collate.render_prepared(rows, TEMPLATE).select("conv_id", "batch_id", "prompt_text", "completion_text")


def _dialogue_tokens(spark, sf_dir) -> DataFrame:
    columns = {"prompt_text": "prompt_ids", "completion_text": "completion_ids"}
    return collate.tokenise(_dialogue_texts(spark, sf_dir), columns, template.word_ids)


def _flat_dialogues(batch: DataFrame, *more: str) -> DataFrame:
    lists = ("input_ids", "attention_mask", "labels", *more)
    return batch.select("conv_id", "batch_id", *[joined(F.col(c)).alias(c) for c in lists], "n_loss_tokens")


@query
def collate_truncated_conversations(spark, sf_dir):
    """Whole conversations, at most 150 tokens, batches padded to a multiple of 16, with token types."""
    types = _dialogue_tokens(spark, sf_dir).withColumns(
        {
            "prompt_types": F.transform("prompt_ids", lambda x: F.lit(0)),
            "completion_types": F.transform("completion_ids", lambda x: F.lit(1)),
        }
    )
    done = collate.collate(types, max_length=150, pad_to_multiple_of=16, token_types=("prompt_types", "completion_types"))
    return _flat_dialogues(done, "token_type_ids")


@query
def collate_full_loss_conversations(spark, sf_dir):
    return _flat_dialogues(collate.collate(_dialogue_tokens(spark, sf_dir), completion_only=False))


@query
def flush_left_conversations(spark, sf_dir):
    """Prompts of whole conversations padded on the left to the batch, then moved back."""
    rows = _dialogue_tokens(spark, sf_dir).withColumn("n", F.size("prompt_ids"))
    rows = rows.withColumn("longest", collate.batch_max(F.col("n")) + 2)
    padded = rows.select(
        "conv_id",
        "batch_id",
        collate.pad_left(F.col("prompt_ids"), F.col("longest"), 0).alias("ids"),
        collate.pad_left(collate.fill(1, F.col("n")), F.col("longest"), 0).alias("mask"),
    )
    done = collate.flush_left(padded, "mask", {"ids": 0})
    return done.select("conv_id", joined(F.col("ids")).alias("ids"), joined(F.col("mask")).alias("mask"))


@query
def suffix_trim_conversations(spark, sf_dir):
    """What follows the prompt of a whole conversation: in its text, and in ids that repeat their input."""
    rows = _dialogue_tokens(spark, sf_dir).withColumn("output_ids", F.concat("prompt_ids", "completion_ids"))
    rest = evaluate.generated_suffix(F.col("output_ids"), F.col("prompt_ids"))
    return rows.select("conv_id", "completion_text", joined(rest).alias("generated"))


@query
def batch_media_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    placed = mix.batches(index.global_index(docs, ["doc_id"], "pos"), 4)
    return collate.batch_media_flags(placed, F.when(F.col("lang") == "en", 2).otherwise(0))


# --- evaluation ------------------------------------------------------------------------


@query
def argmax_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", evaluate.argmax(F.col("embedding")).alias("best"))


@query
def decode_ids(spark, sf_dir):
    """Labels of a batch back to text: ignored and padded places left out."""
    batch = collate.collate(_tokens(spark, sf_dir))
    ids = batch.select("conv_id", "turn", evaluate.replace_ignored(F.col("labels"), 0).alias("ids"))
    vocab = evaluate.vocabulary(table(spark, sf_dir, "conversations"), "text")
    keyed = ids.withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    return evaluate.decode_ids(keyed, "key", "ids", vocab).select("conv_id", "turn", "text")


@query
def dictionary_words(spark, sf_dir):
    """Every distinct word of the documents with an id of its own, frequent ones first."""
    return dictionary.build_dictionary(table(spark, sf_dir, "documents"), ["text"])


@query
def dictionary_documents(spark, sf_dir):
    """Whole documents to dense ids and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    all_words = dictionary.build_dictionary(docs, ["text"])
    coded = dictionary.encode(docs, "doc_id", {"text": "ids"}, all_words, whole=False)
    back = dictionary.decode(coded, "doc_id", "ids", all_words, col="words")
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(joined(F.col("ids"))).alias("ids"), F.md5("words").alias("words")
    )


@query
def dictionary_rare(spark, sf_dir):
    """The same with few words in the tasks and the others joined; a word that stands once is unknown."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = dictionary.build_dictionary(docs, ["text"], min_count=2)
    coded = dictionary.encode(docs, "doc_id", {"text": "ids"}, known, hot_bytes=0, whole=False)
    return coded.select("doc_id", F.md5(joined(F.col("ids"))).alias("ids"), F.size(F.filter("ids", lambda x: x == 1)).cast("bigint").alias("n_unknown"))


@query
def decode_conversations(spark, sf_dir):
    """Labels of whole conversations back to text, through a dictionary of their words."""
    texts = _dialogue_texts(spark, sf_dir)
    known = dictionary.build_dictionary(texts, ["prompt_text", "completion_text"])
    columns = {"prompt_text": "prompt_ids", "completion_text": "completion_ids"}
    batch = collate.collate(dictionary.encode(texts, "conv_id", columns, known))
    ids = batch.select("conv_id", evaluate.replace_ignored(F.col("labels"), 0).alias("ids"))
    return dictionary.decode(ids, "conv_id", "ids", known).select("conv_id", "text")


@query
def decode_documents(spark, sf_dir):
    """Whole documents to ids and back."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id", template.word_ids(F.col("text")).alias("ids"))
    vocab = evaluate.vocabulary(docs, "text")
    back = evaluate.decode_ids(ids, "doc_id", "ids", vocab)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5("text").alias("digest"))


def _answers(rows: DataFrame) -> DataFrame:
    """``quality`` and ``toxic`` as answers in words with stray blanks."""
    word = {c: labels.label_name(F.col(c)) for c in ("quality", "toxic")}
    return rows.withColumns(
        {
            "prediction": F.concat(F.lit(" \t"), word["quality"], F.lit("\n")),
            "answer": F.concat(word["toxic"], F.lit("  ")),
        }
    )


@query
def accuracy(spark, sf_dir):
    rows = _answers(table(spark, sf_dir, "labels"))
    return evaluate.evaluate(rows, evaluate.answer_metrics(F.col("prediction"), F.col("answer")))


@query
def accuracy_by_set(spark, sf_dir):
    rows = _answers(labelled(spark, sf_dir))
    metrics = evaluate.answer_metrics(F.col("prediction"), F.col("answer"))
    return evaluate.evaluate(rows, metrics, by=["dataset"])


@query
def generation_trim(spark, sf_dir):
    """Output that repeats its input: what remains is the completion."""
    rows = _tokens(spark, sf_dir).withColumn("output_ids", F.concat("prompt_ids", "completion_ids"))
    rest = evaluate.generated_suffix(F.col("output_ids"), F.col("prompt_ids"))
    return rows.select("conv_id", "turn", joined(rest).alias("generated"))


@query
def batch_score(spark, sf_dir):
    """A stand-in model: long texts are fake."""

    def load_model() -> int:
        return 500

    def predict(threshold: int, part: pd.DataFrame) -> list[str]:
        return [" Fake\n" if n > threshold else "Real" for n in part["text"].str.len()]

    rows = labelled(spark, sf_dir)
    scored = evaluate.score(rows, ["text"], load_model, predict, keep=["doc_id", "label"])
    answer = labels.label_name(F.col("label"))
    return scored.select(
        "doc_id",
        evaluate.strip(F.col("prediction")).alias("prediction"),
        evaluate.correct(F.col("prediction"), answer).alias("correct"),
    )


@query
def mapped_rows(spark, sf_dir):
    """A Python function per row that replaces the text by its number of letters."""
    docs = table(spark, sf_dir, "documents")
    return row_functions.map_rows(
        docs,
        lambda r: {"n_letters": sum(c.isalpha() for c in r["text"]), "lang": r["lang"].upper()},
        "doc_id bigint, lang string, n_letters bigint",
        inputs=["doc_id", "lang", "text"],
        remove_columns=["text"],
    )


@query
def column_by_position(spark, sf_dir):
    """Labels beside the customers and orders that stand at the same place."""
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    right = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = right.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    buyers = left.join(first, left.c_custkey == first.o_custkey, "left_semi")
    return row_functions.add_column(buyers, first, ["c_custkey"], ["first_order"]).drop("o_custkey")


@query
def dataset_report(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "dataset", "label")
    tagged = split.approximate_hash_split(rows, 0.2, "doc_id", SEED)
    return report.size_report(tagged).withColumn("label", or_minus_one(F.col("label")))


# --- streams ---------------------------------------------------------------------------


@query
def stream_prepare(spark, sf_dir):
    """Documents as two file streams, prepared and interleaved, equal to the batch rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "documents").schema)
    specs = [
        DatasetSpec(name, path=sf_dir, id_column="doc_id", image_type=ENCODED_IMAGE, schema=schema)
        for name in ("text", "image")
    ]
    # A pattern, as the table may be one file or a folder.
    raw = [streams.read_stream(spark, spec, "documents.parque[t]") for spec in specs]
    label = F.pmod("doc_id", F.lit(2)).cast("int")
    video = raw[0].where("lang IS DISTINCT FROM 'en'").select(
        "doc_id", F.base64(F.col("text").cast("binary")).alias("video"), label.alias("label")
    )
    image = F.struct(F.col("text").cast("binary").alias("bytes"), F.col("source").alias("path"))
    picture = raw[1].where("lang = 'en'").select("doc_id", image.alias("image"), label.alias("label"))
    prepared = streams.prepare_stream(list(zip(specs, [video, picture])))
    out = staged_path(spark, "stream")
    job = streams.write_stream(prepared, f"{out}/rows", f"{out}/checkpoint", n_datasets=2)
    job.awaitTermination()
    done = spark.read.parquet(f"{out}/rows")
    return done.select(
        "pos",
        "example_id",
        "label",
        F.col("prompt")[0]["content"].alias("prompt"),
        F.col("completion")[0]["content"].alias("completion"),
        or_minus_one(F.octet_length(messages.decode_video(F.col("video")))).alias("video_bytes"),
        or_minus_one(F.octet_length(F.col("images")[0]["bytes"])).alias("image_bytes"),
    )


@query
def stream_accuracy(spark, sf_dir):
    """Running accuracy over a stream of labels, by the language of their document."""
    rows = stream_of(spark, sf_dir, "labels")
    known = rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    running = streams.stream_accuracy(
        _answers(known), F.col("prediction"), F.col("answer"), by=["lang"]
    )
    out = staged_path(spark, "running")
    streams.write_running(running, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return streams.latest_running(spark, f"{out}/rows")
