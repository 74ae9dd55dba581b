"""The common signature, and bringing a dataset to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.functions.labels import LABEL_NAMES, cast_label, label_metadata
from lumenprep.functions.messages import MESSAGES

# Decoded image: the struct of Spark's own image source (pixels in BGR order).
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
# Encoded image: file bytes and path.
ENCODED_IMAGE = "struct<bytes:binary,path:string>"


# Order of the rows within their dataset.
SOURCE_ORDER = ("src_file", "src_row")


def signature(image_type: str = IMAGE) -> T.StructType:
    """Columns every dataset is brought to, whatever it came with."""
    return T.StructType.fromDDL(
        "example_id string, dataset string, ds_pos int, src_file string, src_row bigint,"
        f"prompt {MESSAGES}, completion {MESSAGES}, images array<{image_type}>,"
        "video string, label int, degrade_fake boolean, split string"
    )


def wrap_image(df: DataFrame) -> DataFrame:
    """A single ``image`` as a list ``images``; the single column is dropped."""
    if "images" in df.columns or "image" not in df.columns:
        return df
    return df.withColumn("images", F.array("image")).drop("image")


def reconcile(
    df: DataFrame, constants: dict | None = None, image_type: str = IMAGE, keep: Sequence[str] = ()
) -> DataFrame:
    """``df`` with exactly the columns of the signature, and those of ``keep`` after them.

    A single image is wrapped, missing columns are NULL, other columns are dropped, and
    ``constants`` are set for all rows. A value that does not fit its type fails the query.
    """
    constants = constants or {}
    df = wrap_image(df)
    given = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField) -> Column:
        if field.name in constants:
            value = F.lit(constants[field.name])
        elif field.name not in given:
            value = F.lit(None)
        elif field.name == "label":
            integral = isinstance(given["label"], T.IntegralType)
            index = cast_label(F.col("label"), integral=integral)
            return index.alias("label", metadata=label_metadata(LABEL_NAMES))
        else:
            value = F.col(field.name)
            if given[field.name] == field.dataType:
                return value
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in signature(image_type).fields], *keep)


def is_conversational(schema: T.StructType, column: str = "prompt") -> bool:
    """True when the column is a list of role/content messages."""
    if column not in schema.fieldNames():
        return False
    kind = schema[column].dataType
    return (
        isinstance(kind, T.ArrayType)
        and isinstance(kind.elementType, T.StructType)
        and {"role", "content"} <= set(kind.elementType.fieldNames())
    )


def completion_only_default(schema: T.StructType, wanted: bool | None = None) -> bool:
    """Whether loss is on completions only: as wanted, else when there are prompts and completions."""
    if wanted is not None:
        return wanted
    return {"prompt", "completion"} <= set(schema.fieldNames())
