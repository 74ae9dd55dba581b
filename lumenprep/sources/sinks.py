"""Writing a prepared set, and encoding images on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumenprep.sources.schema import ENCODED_IMAGE, IMAGE


def write_prepared(
    df: DataFrame,
    path: str,
    pos: str | None = "pos",
    shards: int | None = None,
    rows_per_file: int | None = None,
    row_group_bytes: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Parquet under ``path/split=…``, rows in the order of ``pos`` within and across files.

    Positions run from 0 in each split, so the shard of a row follows from its position and
    the number of rows, which only the key columns are read for: media and what is computed
    from them are evaluated once. ``rows_per_file`` and ``row_group_bytes`` keep files and row
    groups small for rows with large media.
    """
    if pos is not None:
        total = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # One row per split.
        sizes = df.groupBy("split").agg(F.coalesce(F.max(pos) + 1, F.lit(1)).alias("n")).orderBy("split").collect()
        whole = max(1, sum(r["n"] for r in sizes))
        shard, before = F.lit(0), 0
        for r in sizes:
            here = F.floor((F.lit(before) + F.col(pos)) * total / whole).cast("int")
            shard = F.when(F.col("split").eqNullSafe(F.lit(r["split"])), here).otherwise(shard)
            before += r["n"]
        df = df.repartitionById(total, F.coalesce(shard, F.lit(0))).sortWithinPartitions("split", pos)
    elif shards:
        df = df.repartition(shards)
    writer = df.write.mode(mode).partitionBy("split").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def write_checked(
    df: DataFrame, path: str, bad: Column, counted: dict[str, Column] | None = None, mode: str = "errorifexists"
) -> dict[str, int]:
    """Write the good rows under ``path/bad=0`` and the others under ``path/bad=1``, and count both on the way.

    One pass over ``df``: the counts (``n_rows``, ``n_bad``, and how many rows meet each condition of ``counted``) are
    observed while the rows are written. A NULL condition does not hold. ``df`` must have no column ``bad``.
    """
    if any(c.lower() == "bad" for c in df.columns):
        raise ValueError("the rows have a column named bad")
    metrics = Observation()
    marked = df.withColumn("bad", F.coalesce(bad, F.lit(False)).cast("int"))
    conditions = {"n_bad": F.col("bad") == 1, **(counted or {})}
    observed = marked.observe(
        metrics, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    )
    observed.write.mode(mode).partitionBy("bad").option("compression", "zstd").parquet(path)
    return {k: int(v) for k, v in metrics.get.items()}


# Converted images leave a task in pieces of about this many bytes.
OUTPUT_BYTES = 64 << 20

_WHOLE = pa.int32()
_IMAGES = pa.list_(
    pa.struct([("origin", pa.string()), ("height", _WHOLE), ("width", _WHOLE), ("nChannels", _WHOLE), ("mode", _WHOLE), ("data", pa.binary())])
)
_ENCODED = pa.list_(pa.struct([("bytes", pa.binary()), ("path", pa.string())]))


def _converted(lists: pa.Array, convert: Callable[[dict], dict], kind: pa.DataType, content: str, limit: int) -> Iterator[pa.Array]:
    """Lists with each image converted, cut once the results hold ``limit`` bytes. Sizes are not known before, so a row may be over."""
    rows, held = [], 0
    for given in lists:
        images = given.as_py()
        rows.append(None if images is None else [None if i is None else convert(i) for i in images])
        held += sum(len(i[content]) for i in rows[-1] or [] if i is not None and i[content] is not None)
        if held >= limit:
            yield pa.array(rows, kind)
            rows, held = [], 0
    if rows:
        yield pa.array(rows, kind)


def encode_images(images: Column, encoder: Callable[[dict], bytes], output_bytes: int = OUTPUT_BYTES) -> Column:
    """Encoded images; ``encoder`` turns one image struct (as a dict) into file bytes."""

    @F.arrow_udf(f"array<{ENCODED_IMAGE}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from _converted(lists, lambda i: {"bytes": encoder(i), "path": i["origin"]}, _ENCODED, "bytes", output_bytes)

    return run(images)


def decode_images(images: Column, decoder: Callable[[bytes], dict], output_bytes: int = OUTPUT_BYTES) -> Column:
    """Decoded images; ``decoder`` turns file bytes into an image struct (as a dict).

    A few bytes of file may be many of pixels: what is decoded leaves the task whenever it reaches ``output_bytes``.
    """

    @F.arrow_udf(f"array<{IMAGE}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from _converted(lists, lambda i: {**decoder(i["bytes"]), "origin": i["path"]}, _IMAGES, "data", output_bytes)

    return run(images)
