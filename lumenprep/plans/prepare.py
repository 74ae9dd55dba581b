"""A whole job: load, reconcile, derive, split, degrade, mix."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprep.functions import messages as M
from lumenprep.functions.draws import hash52
from lumenprep.operators.images import degrade, degrade_encoded, needs_degradation
from lumenprep.operators.index import global_index, require_unique
from lumenprep.operators.mix import SHUFFLE_SALT, round_robin_position
from lumenprep.operators.split import stratified_split
from lumenprep.operators.staging import stage
from lumenprep.plans.spec import JobSpec
from lumenprep.sources.load import load_dataset, load_placed, placed_by_files
from lumenprep.sources.schema import SOURCE_ORDER, reconcile


def with_messages(
    df: DataFrame, prompt_policy: str = "keep", completion_policy: str = "keep"
) -> DataFrame:
    """Prompt and completion derived from modality and label.

    An existing one is kept, or replaced on request. Column expressions only, so this
    also works on a stream.
    """
    kind = M.modality(M.media_count(F.col("images")))
    prompt = M.keep_or_derive(F.col("prompt"), M.prompt_for(kind), prompt_policy)
    answer = M.completion_from_label(F.col("label"))
    completion = M.keep_or_derive(F.col("completion"), answer, completion_policy)
    return df.withColumns({"prompt": prompt, "completion": completion})


def load_all(spark: SparkSession, job: JobSpec) -> DataFrame:
    """All datasets in the signature: train splits, and eval splits where named."""
    if len({d.image_type for d in job.datasets}) > 1:
        raise ValueError("all datasets of a job need the same image type")
    loaded = [load_dataset(spark, d, i) for i, d in enumerate(job.datasets)]
    return reduce(DataFrame.unionByName, loaded)


def placed_in_files(spark: SparkSession, job: JobSpec) -> DataFrame:
    """All rows of a job over whole Parquet files, in the signature, with their ``pos``.

    Sizes of files and row numbers in the scan give every position, so rows are neither joined nor moved.
    """
    if len({d.image_type for d in job.datasets}) > 1:
        raise ValueError("all datasets of a job need the same image type")
    parts: dict[str, list[tuple[int, DataFrame]]] = {"train": [], "eval": []}
    sizes = {split: [0] * len(job.datasets) for split in parts}
    for i, spec in enumerate(job.datasets):
        constants = {"dataset": spec.name, "ds_pos": i, "degrade_fake": spec.degrade_fake}
        for split, text in (("train", spec.train_split), ("eval", spec.eval_split)):
            if text is None:
                continue
            rows, sizes[split][i] = load_placed(spark, spec, text)
            parts[split].append((i, reconcile(rows, {**constants, "split": split}, spec.image_type, keep=["_place"])))
    placed = []
    for split, datasets in parts.items():
        for i, rows in datasets:
            if job.mix == "interleave":
                pos = round_robin_position(F.col("_place") + 1, F.lit(i), sizes[split])
            else:
                pos = F.col("_place") + F.lit(sum(sizes[split][:i])).cast("bigint")
            rows = rows.withColumn("pos", pos).drop("_place")
            if split == "train" and job.num_total_samples is not None:
                rows = rows.where(F.col("pos") < F.lit(job.num_total_samples))
            placed.append(rows)
    return with_messages(reduce(DataFrame.unionByName, placed), job.prompt_policy, job.completion_policy)


def hold_out(keys: DataFrame, job: JobSpec) -> DataFrame:
    """Hold out the fraction of each dataset that has one.

    Those have no named eval split, so all their rows are still train rows.
    """
    fractions = {d.name: d.eval_split for d in job.datasets if isinstance(d.eval_split, float)}
    if not fractions:
        return keys
    tagged = stratified_split(keys, fractions, "example_id", job.seed, col="_part")
    held = F.when(F.col("_part") == "eval", F.lit("eval")).otherwise(F.col("split"))
    # Named eval rows belong to datasets without a fraction.
    return tagged.withColumn("split", held).drop("_part")


def positions(rows: DataFrame, job: JobSpec) -> DataFrame:
    """``example_id``, ``loaded``, ``split`` and ``pos`` of every row, from 0 in train and in eval.

    Works on the key columns alone: one range sort by split and then by dataset and
    source order, or by seeded hash for a shuffle.
    """
    if job.shuffle:
        h = hash52(F.col("example_id"), job.seed, SHUFFLE_SALT)
        keys = rows.select("example_id", "loaded", "split", F.lit(0).alias("ds_pos"), h.alias("_h"))
        order = ["_h", "example_id"]
    else:
        keys = rows.select("example_id", "loaded", "split", "ds_pos", *SOURCE_ORDER)
        order = ["ds_pos", *SOURCE_ORDER]
    indexed = global_index(keys, ["split", *order], "_idx")
    # At most two counts per dataset of the job.
    counted = {
        (r["split"], r["ds_pos"]): r["n"]
        for r in indexed.groupBy("split", "ds_pos").agg(F.count("*").alias("n")).collect()
    }
    place = range(len(job.datasets))
    start, pos = 0, F.lit(None).cast("bigint")
    for split in ("eval", "train"):
        sizes = [counted.get((split, i), 0) for i in place]
        here = F.col("_idx") - F.lit(start)
        if job.mix == "interleave" and not job.shuffle:
            starts = F.array(*[F.lit(sum(sizes[:i])).cast("bigint") for i in place])
            rank = here - F.get(starts, F.col("ds_pos")) + 1
            here = round_robin_position(rank, F.col("ds_pos"), sizes)
        pos = F.when(F.col("split") == split, here).otherwise(pos)
        start += sum(sizes)
    return indexed.select("example_id", "loaded", "split", pos.alias("pos"))


def prepare(
    spark: SparkSession,
    job: JobSpec,
    profile: DataFrame | None = None,
    codec: tuple[Callable[[bytes], dict], Callable[[dict], bytes]] | None = None,
    **options,
) -> DataFrame:
    """The training and evaluation rows of a job, in the signature, with their ``pos``.

    With a profile of real images the fake images of flagged datasets are degraded
    towards it; images kept as file bytes need a ``codec`` (decoder, encoder). ``options`` (``recompress``,
    ``output_bytes``, ...) are those of ``degrade``.

    Over whole Parquet files without ids, unless rows are shuffled or a fraction of them is drawn, positions come from
    the files, and nothing is joined or moved. Otherwise the key columns are staged once; splits and positions come from them alone, and one
    join takes both to the wide rows. A row is known by its id and the split it was loaded
    as, so a row may be in both; ids that are NULL or repeated there are an error.
    """
    if not job.shuffle and all(placed_by_files(d) for d in job.datasets):
        return _degraded(placed_in_files(spark, job), job, profile, codec, options)
    rows = load_all(spark, job).withColumnRenamed("split", "loaded")
    narrow = rows.select("example_id", "dataset", "label", "loaded", "ds_pos", *SOURCE_ORDER)
    keys = stage(narrow.withColumn("split", F.col("loaded")), "keys")
    require_unique(keys, ["example_id", "loaded"], "ids of the datasets")
    places = positions(hold_out(keys, job), job)
    if job.num_total_samples is not None:
        in_budget = (F.col("split") == "eval") | (F.col("pos") < F.lit(job.num_total_samples))
        places = places.where(in_budget)
    wide = with_messages(rows, job.prompt_policy, job.completion_policy)
    return _degraded(wide.join(places, ["example_id", "loaded"]).drop("loaded"), job, profile, codec, options)


def _degraded(placed: DataFrame, job: JobSpec, profile: DataFrame | None, codec: tuple | None, options: dict) -> DataFrame:
    if profile is None:
        return placed
    needed = needs_degradation(job.degrade_eval)
    if codec is None:
        return degrade(placed, profile, job.degrade, job.seed, needed=needed, **options)
    return degrade_encoded(placed, profile, job.degrade, job.seed, *codec, needed=needed, **options)
