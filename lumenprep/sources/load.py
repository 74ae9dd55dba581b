"""Reading the splits of one or more datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.operators.index import file_offsets, with_file_offset
from lumenprep.plans.spec import DatasetSpec
from lumenprep.sources.schema import SOURCE_ORDER, reconcile
from lumenprep.sources.slices import ends_by_counting, ends_by_files, parse_slices, slice_rows

def split_path(spec: DatasetSpec, split: str) -> str:
    """``path/config/split``; without a config ``path/split``."""
    return "/".join(p for p in (spec.path.rstrip("/"), spec.config, split) if p)


def read_split(spark: SparkSession, spec: DatasetSpec, split: str) -> DataFrame:
    """Raw rows of a split with ``example_id`` and their source order.

    Without an id column the key of a Parquet row is its file and its row there, which
    Spark's scan provides, so nothing has to be numbered.
    """
    if spec.frames is not None:
        if split not in spec.frames:
            raise ValueError(f"dataset {spec.name} has no split {split!r}")
        raw = spec.frames[split]
    else:
        reader = spark.read.format(spec.format).options(**spec.options)
        if spec.schema:
            reader = reader.schema(spec.schema)
        raw = reader.load(split_path(spec, split))
    if spec.id_column:
        return with_row_key(raw, F.col(spec.id_column), raw.schema[spec.id_column].dataType, spec, split)
    if spec.format != "parquet" or spec.frames is not None:
        raise ValueError(f"dataset {spec.name} needs an id column")
    file, number = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    row = F.concat_ws("#", file, number.cast("string"))
    name = F.concat_ws("/", F.lit(spec.name), F.lit(split), row)
    return raw.withColumns({"example_id": name, "src_file": file, "src_row": number})


def with_row_key(
    raw: DataFrame, key: Column, kind: T.DataType, spec: DatasetSpec, split: str
) -> DataFrame:
    """``example_id`` and source order from an id; whole numbers keep their own order."""
    whole = isinstance(kind, T.IntegralType)
    file = F.lit("") if whole else key.cast("string")
    row = key.cast("bigint") if whole else F.lit(0).cast("bigint")
    # NULL for a row without an id, which is refused before anything is joined by it.
    name = F.concat(F.lit(f"{spec.name}/{split}/"), key.cast("string"))
    return raw.withColumns({"example_id": name, "src_file": file, "src_row": row})


def load_split(spark: SparkSession, spec: DatasetSpec, text: str) -> DataFrame:
    """Rows of ``text``: a split name, or slices of splits joined by ``+``."""
    terms = parse_slices(text)
    ends = ends_by_counting if spec.id_column else ends_by_files

    def sliced(name: str, piece: str) -> DataFrame:
        return slice_rows(read_split(spark, spec, name), piece, SOURCE_ORDER, ends=ends)

    if len({t.name for t in terms}) == 1:
        return _mark_terms(sliced(terms[0].name, text), len(terms))
    parts = [
        sliced(term.name, piece).withColumn("slice_term", F.lit(i))
        for i, (term, piece) in enumerate(zip(terms, text.split("+")))
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _mark_terms(merged, len(terms))


def placed_by_files(spec: DatasetSpec) -> bool:
    """Whether the rows of a dataset have their places from their files: Parquet on disk without ids, and no fraction to draw."""
    return spec.frames is None and spec.format == "parquet" and not spec.id_column and not isinstance(spec.eval_split, float)


def load_placed(spark: SparkSession, spec: DatasetSpec, text: str) -> tuple[DataFrame, int]:
    """``load_split`` of whole Parquet files with ``_place``, the position in the split, and the number of rows.

    A place is the rows before the file, and the row in it, which the scan gives, less the start of the slice. Only
    footers are read before, each split's once; rows are not moved.
    """
    terms = parse_slices(text)
    known: dict[str, tuple[DataFrame, DataFrame, int]] = {}
    parts, before = [], 0
    for i, (term, piece) in enumerate(zip(terms, text.split("+"), strict=True)):
        if term.name not in known:
            rows = read_split(spark, spec, term.name)
            offsets = file_offsets(rows)
            n = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
            known[term.name] = rows, offsets, n
        rows, offsets, n = known[term.name]
        lo, hi = term.bounds(n)
        inside = slice_rows(rows, piece, SOURCE_ORDER, ends=lambda df, order, o=offsets: ends_by_files(df, order, o))
        placed = with_file_offset(inside, offsets)
        place = F.col("_offset") + F.col("src_row") + F.lit(before - lo)
        parts.append(placed.withColumns({"slice_term": F.lit(i), "_place": place.cast("bigint")}).drop("_offset"))
        before += hi - lo
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _mark_terms(merged, len(terms)), before


def _mark_terms(rows: DataFrame, n_terms: int) -> DataFrame:
    """Slices keep the order of their list, and a row in two slices counts twice."""
    if n_terms > 1:
        term = F.col("slice_term").cast("string")
        rows = rows.withColumns(
            {
                "example_id": F.concat("example_id", F.lit("@"), term),
                "src_file": F.concat_ws(" ", F.lpad(term, 6, "0"), "src_file"),
            }
        )
    return rows


def load_dataset(spark: SparkSession, spec: DatasetSpec, ds_pos: int) -> DataFrame:
    """Train rows, and eval rows where a split is named for them, in the signature."""
    constants = {"dataset": spec.name, "ds_pos": ds_pos, "degrade_fake": spec.degrade_fake}
    train = load_split(spark, spec, spec.train_split)
    parts = [reconcile(train, {**constants, "split": "train"}, spec.image_type)]
    if isinstance(spec.eval_split, str):
        held = load_split(spark, spec, spec.eval_split)
        parts.append(reconcile(held, {**constants, "split": "eval"}, spec.image_type))
    return reduce(DataFrame.unionByName, parts)
