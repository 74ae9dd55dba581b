"""Rendering messages to one text, and the default token ids for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Parts of a ChatML-style template."""

    open_message: str = "<|im_start|>"
    after_role: str = "\n"
    close_message: str = "<|im_end|>\n"
    image: str = "<|vision_start|><|image_pad|><|vision_end|>"
    video: str = "<|vision_start|><|video_pad|><|vision_end|>"
    answer_role: str = "assistant"


CHATML = ChatTemplate()


def _wrap(role: Column, body: Column, template: ChatTemplate) -> Column:
    return F.concat(
        F.lit(template.open_message),
        role,
        F.lit(template.after_role),
        body,
        F.lit(template.close_message),
    )


def _render(messages: Column, body, template: ChatTemplate, add_answer_header: bool) -> Column:
    text = F.array_join(F.transform(messages, lambda m: _wrap(m["role"], body(m), template)), "")
    if add_answer_header:
        header = template.open_message + template.answer_role + template.after_role
        text = F.concat(text, F.lit(header))
    return text


def render_messages(
    messages: Column, template: ChatTemplate = CHATML, add_answer_header: bool = False
) -> Column:
    """Text of plain messages."""
    return _render(messages, lambda m: m["content"], template, add_answer_header)


def render_normalised(
    messages: Column, template: ChatTemplate = CHATML, add_answer_header: bool = False
) -> Column:
    """Text of messages with typed parts; media parts become placeholders."""

    def body(m: Column) -> Column:
        pieces = F.transform(
            m["content"],
            lambda p: F.when(p["type"] == "image", F.lit(template.image))
            .when(p["type"] == "video", F.lit(template.video))
            .otherwise(F.coalesce(p["text"], F.lit(""))),
        )
        return F.array_join(pieces, "")

    return _render(messages, body, template, add_answer_header)


def completion_suffix(full: Column, prompt: Column) -> Column:
    """What follows the prompt in the text of prompt and completion."""
    return F.substring(full, F.length(prompt) + 1, F.length(full))


TOKEN_PATTERN = r"[^ \t\r\n]+"
FIRST_TOKEN_ID = 3
PAD_ID = 0


def words(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def word_id(word: Column) -> Column:
    """Stable id of a word: 28 bits of its md5, above the ids kept for special tokens."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") + F.lit(FIRST_TOKEN_ID)


def word_ids(text: Column) -> Column:
    """Default tokenizer (text column to a column of token ids)."""
    return F.transform(words(text), word_id)
