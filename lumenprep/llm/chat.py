"""Chat conversations from event logs, rendered with a loss mask. DataFrame functions only.

Events of a conversation are partitioned by it and folded in the order of ``seq``:

- ``delta`` appends its text to a message (and creates it),
- ``edit`` replaces the text of a message,
- ``regenerate`` empties a message, so that later deltas stream it anew.

Messages are ordered by their first event. A message's role is that of its first event.

The template marks every turn as ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE``. Control
strings inside roles and texts are escaped: the escape sign and each control string become the
sign and one code letter. Every sign in a rendered string begins a code, so unescaping is exact.

NULL texts are empty, NULL roles are empty roles, events without a conversation form the
conversation NULL. Events that tie on ``seq`` are ordered by message, kind, role and text;
repeated rows are separate events. A text column that holds numbers is read as text. An empty
log gives no conversations. One conversation is one row, so it must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "␛"
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>",
            "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CODES = "abcdefghijklmnopqrstuvwxyz"
NEWLINE = "N"
SELF = "S"


def escape(text: Column, newline: bool = False) -> Column:
    """``text`` without control strings (and without line ends if ``newline``)."""
    out = F.replace(text, F.lit(SIGN), F.lit(SIGN + SELF))
    for control, code in zip(CONTROLS, CODES, strict=False):
        out = F.replace(out, F.lit(control), F.lit(SIGN + code))
    return F.replace(out, F.lit("\n"), F.lit(SIGN + NEWLINE)) if newline else out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(SIGN + NEWLINE), F.lit("\n"))
    for control, code in zip(CONTROLS, CODES, strict=False):
        out = F.replace(out, F.lit(SIGN + code), F.lit(control))
    return F.replace(out, F.lit(SIGN + SELF), F.lit(SIGN))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, position, role, text) of a log with conv_id, seq, message, kind, role, text.

    Deltas before the last edit or regeneration of a message have no effect and are dropped from the
    fold; the first event still gives place and role. An unknown kind raises an error.
    """
    kind = F.lower("kind")
    known = kind.isin("delta", "edit", "regenerate")
    checked = F.when(known, kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("NULL"))))
    )
    rows = events.select(
        "conv_id",
        "message",
        F.struct(
            F.col("seq"),
            checked.alias("kind"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("event"),
    )
    folded = rows.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("event")).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(-1))
    last = F.array_max(resets)
    tail = F.filter("log", lambda e, i: (i >= last) & (e["kind"] != "regenerate"))
    return folded.select(
        "conv_id",
        "message",
        F.element_at("log", 1)["seq"].alias("position"),
        F.element_at("log", 1)["role"].alias("role"),
        F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    ``loss_mask`` is an array of (turn, start, length): the code points of turn ``turn`` (0-based; a turn
    runs from one start marker to the line end after its end marker) that the loss sees. Offsets count
    within the turn, so reading a long conversation stays linear.
    """
    head = F.concat(F.lit(START), escape(F.col("role"), newline=True), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        F.col("position"),
        F.col("message"),
        F.concat(head, body, F.lit(END + "\n")).alias("turn"),
        (F.col("role") == loss_role).alias("loss"),
        F.length(head).alias("start"),
        F.length(body).alias("length"),
    )
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(
        "turns",
        lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["loss"].alias("loss")),
    )
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: s.dropFields("loss"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log and render it."""
    return render(fold_events(events), loss_role)


def turns_of(formatted: Column) -> Column:
    """Rendered turns of a formatted conversation, without their end markers."""
    pieces = F.split(formatted, F.lit(r"\Q" + END + r"\E\n"), -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (array of role and text) and ``loss_texts`` (array) as read from the rendered form alone."""
    parts = formatted.withColumn("_turns", turns_of(F.col("formatted")))
    cut = lambda t: F.substring(t, len(START) + 1, 1 << 30)
    turns = F.transform(
        "_turns",
        lambda t: F.struct(
            unescape(F.substring_index(cut(t), "\n", 1)).alias("role"),
            unescape(F.substr(t, F.instr(t, F.lit("\n")) + 1)).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_mask",
        lambda s: unescape(F.substr(F.element_at("_turns", s["turn"] + 1), s["start"] + 1, s["length"])),
    )
    return parts.withColumn("turns", turns).withColumn("loss_texts", loss).drop("_turns")

