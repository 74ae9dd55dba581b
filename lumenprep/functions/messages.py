"""Chat messages: modality, prompt, completion and the multimodal form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenprep.functions.labels import LABEL_NAMES, label_name

MESSAGES = "array<struct<role:string,content:string>>"
PART = "struct<type:string,text:string,media_idx:int>"
PARTS = f"array<{PART}>"
NORMALISED = f"array<struct<role:string,content:{PARTS}>>"
ROLES = ("system", "user", "assistant")

# The question put to the model.
QUESTION_HEAD = "Is this "
QUESTION_TAIL = " real or fake? Answer with one word: Real or Fake."


def media_count(images: Column) -> Column:
    """Number of images in a row; a NULL list has none."""
    return F.greatest(F.coalesce(F.size(images), F.lit(0)), F.lit(0))


def or_empty(images: Column) -> Column:
    """NULL list of images as an empty list."""
    return F.coalesce(images, F.array())


def modality(n_images: Column) -> Column:
    """``image`` when the row has at least one image, else ``video``."""
    return F.when(n_images > 0, F.lit("image")).otherwise(F.lit("video"))


def message(role: str, content: Column) -> Column:
    """A list with one message."""
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def question(kind: Column) -> Column:
    return F.concat(F.lit(QUESTION_HEAD), kind, F.lit(QUESTION_TAIL))


def prompt_for(kind: Column) -> Column:
    """The prompt: one user message asking about an image or a video."""
    return message("user", question(kind))


def completion_from_label(
    label: Column, names: dict[int, str] | Sequence[str] = LABEL_NAMES
) -> Column:
    """The completion: one assistant message naming the class; NULL for a NULL label."""
    answer = label_name(label, names)
    return F.when(answer.isNotNull(), message("assistant", answer))


def keep_or_derive(existing: Column | None, derived: Column, policy: str) -> Column:
    """``keep`` an existing value where there is one, or ``regenerate`` it."""
    if policy not in ("keep", "regenerate"):
        raise ValueError(f"policy must be 'keep' or 'regenerate', not {policy!r}")
    if existing is None or policy == "regenerate":
        return derived
    return F.coalesce(existing, derived)


def _part(kind: str, text: Column, media_idx: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        text.cast("string").alias("text"),
        media_idx.cast("int").alias("media_idx"),
    )


def _media_parts(n_images: Column, has_video: Column) -> Column:
    none = F.lit(None)
    images = F.when(
        n_images > 0,
        F.transform(F.sequence(F.lit(0), n_images - 1), lambda i: _part("image", none, i)),
    ).otherwise(F.array().cast(PARTS))
    video = F.when(has_video, F.array(_part("video", none, F.lit(0)))).otherwise(
        F.array().cast(PARTS)
    )
    return F.concat(images, video)


def normalise_messages(
    messages: Column, n_images: Column, has_video: Column, prepared: bool = False
) -> Column:
    """Messages with typed parts instead of plain text.

    The first user message with plain text starts with the media parts (images, then
    the video); all other text becomes one text part. ``media_idx`` points into the
    media columns, so pixels are not copied. With ``prepared`` each message also has a
    ``parts`` field, and a message whose ``parts`` is set is left as it is. A role other
    than system, user and assistant fails the query.
    """
    media = _media_parts(F.coalesce(n_images, F.lit(0)), F.coalesce(has_video, F.lit(False)))

    def plain(m: Column) -> Column:
        return m["parts"].isNull() if prepared else F.lit(True)

    plain_user = F.transform(messages, lambda m: (m["role"] == "user") & plain(m))
    first_user = F.array_position(plain_user, F.lit(True)) - 1

    def rewrite(m: Column, i: Column) -> Column:
        text = F.array(_part("text", m["content"], F.lit(None)))
        parts = F.when(i == first_user, F.concat(media, text)).otherwise(text)
        if prepared:
            parts = F.coalesce(m["parts"], parts)
        error = F.raise_error(
            F.concat(F.lit("invalid role in message: "), F.coalesce(m["role"], F.lit("NULL")))
        )
        content = F.when(m["role"].isin(*ROLES), parts).otherwise(error.cast(PARTS))
        return F.struct(m["role"].alias("role"), content.alias("content"))

    return F.transform(messages, rewrite)


def has_bad_role(messages: Column) -> Column:
    """True when a message has an unknown role: the quarantine form of the check."""
    return F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))


def decode_video(video: Column) -> Column:
    """Bytes of a base64 video, NULL where the text is not base64."""
    return F.try_to_binary(video, F.lit("base64"))


def bad_video(video: Column) -> Column:
    """True where a video text is present but cannot be decoded."""
    return video.isNotNull() & decode_video(video).isNull()
