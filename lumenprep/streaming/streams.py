"""The stateless part of a job on streams, and a running accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenprep.operators.evaluate import answer_metrics, evaluate
from lumenprep.operators.images import degrade, needs_degradation
from lumenprep.operators.index import require_unique
from lumenprep.operators.mix import interleave_position
from lumenprep.operators.staging import stage, staging_scope
from lumenprep.plans.prepare import with_messages
from lumenprep.plans.spec import DatasetSpec, DegradeParams, check_eval_split
from lumenprep.sources.load import split_path, with_row_key
from lumenprep.sources.schema import SOURCE_ORDER, reconcile

COUNTS = "_counts"  # not read with the rows


def read_stream(
    spark: SparkSession, spec: DatasetSpec, split: str, max_files: int | None = None
) -> DataFrame:
    """A split as a stream of files; the schema must be given."""
    if spec.schema is None:
        raise ValueError(f"dataset {spec.name}: a stream needs a schema")
    reader = spark.readStream.format(spec.format).schema(spec.schema).options(**spec.options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(split_path(spec, split))


def prepare_stream(
    streams: Sequence[tuple[DatasetSpec, DataFrame]],
    split: str = "train",
    prompt_policy: str = "regenerate",
    completion_policy: str = "keep",
    profile: DataFrame | None = None,
    params: DegradeParams = DegradeParams(),
    seed: int = 0,
    degrade_eval: bool = False,
) -> DataFrame:
    """Datasets as one stream in the signature, with prompts and completions.

    A fraction cannot be held out of a stream; a named eval split is a second call with
    ``split="eval"``, where prompts are usually kept. With a profile of real images (small
    enough to be sent to the tasks) the fake images are degraded as in ``prepare``: choices
    depend on seed and id alone, so a stream needs no state for them.
    """
    if not streams:
        raise ValueError("there is no stream to put together")
    parts = []
    for i, (spec, raw) in enumerate(streams):
        check_eval_split(spec.eval_split, streaming=True)
        if spec.id_column is None:
            raise ValueError(f"dataset {spec.name}: a stream needs an id column")
        key = F.col(spec.id_column)
        keyed = with_row_key(raw, key, raw.schema[spec.id_column].dataType, spec, split)
        constants = {"dataset": spec.name, "ds_pos": i, "degrade_fake": spec.degrade_fake, "split": split}
        parts.append(reconcile(keyed, constants, spec.image_type))
    rows = with_messages(reduce(DataFrame.unionByName, parts), prompt_policy, completion_policy)
    if profile is None:
        return rows
    return degrade(rows, profile, params, seed, needed=needs_degradation(degrade_eval))


def write_stream(
    prepared: DataFrame, path: str, checkpoint: str, n_datasets: int | None = None,
    available_now: bool = True, continued: bool = False,
) -> StreamingQuery:
    """Parquet under ``path``, one folder per micro-batch.

    With ``n_datasets`` the datasets are interleaved within each micro-batch (``pos``). ``continued`` lets ``pos`` go on
    where the micro-batch before ended: the number of rows of each is kept beside the rows, so that a restart goes on too.
    No state is kept by dataset, so a large one is spread over tasks as in a batch job. A repeated
    micro-batch overwrites its own folder, and leaves nothing staged.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with staging_scope(batch.sparkSession):
            if n_datasets is not None:
                narrow = stage(batch.select("example_id", "ds_pos", *SOURCE_ORDER), "keys")
                require_unique(narrow, ["example_id"], "ids of the micro-batch")
                before = rows_before(batch.sparkSession, path, batch_id) if continued else 0
                place = interleave_position(narrow, SOURCE_ORDER, n_datasets)
                batch = batch.join(place.select("example_id", (F.col("pos") + F.lit(before)).alias("pos")), "example_id")
                if continued:
                    counts = narrow.agg(F.count("*").alias("n"))
                    counts.write.mode("overwrite").parquet(f"{path}/{COUNTS}/micro_batch={batch_id}")
            batch.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")

    writer = prepared.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rows_before(spark: SparkSession, path: str, batch_id: int) -> int:
    """Rows in the micro-batches before ``batch_id``, from the counts kept with them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{COUNTS}")
    if batch_id == 0 or not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return 0
    kept = spark.read.schema("n bigint, micro_batch bigint").parquet(f"{path}/{COUNTS}")
    return kept.where(F.col("micro_batch") < batch_id).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stream_accuracy(
    answers: DataFrame, prediction: Column, label: Column, by: Sequence[str]
) -> DataFrame:
    """Running accuracy by group: one counter per group is all the state there is."""
    return evaluate(answers, answer_metrics(prediction, label), by)


def write_running(
    aggregated: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """The whole aggregate after each micro-batch, in a folder of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")

    writer = (
        aggregated.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_running(spark: SparkSession, path: str) -> DataFrame:
    """The aggregate after the last micro-batch."""
    written = spark.read.parquet(path)
    last = written.agg(F.max("micro_batch").alias("_last")).first()["_last"]
    return written.where(F.col("micro_batch") == last).drop("micro_batch")
