"""Event logs folded by hand, and round trips of the rendered form."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from lumenprep.llm.chat import CONTROLS, END, SIGN, START, escape, fold_events, format_conversations, read_back, unescape

SCHEMA = "conv_id bigint, seq bigint, message string, kind string, role string, text string, formatted int"


def events(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def brute(rows):
    state = {}
    for conv, seq, message, kind, role, text in sorted(rows, key=lambda r: r[1]):
        at = state.setdefault((conv, message), [seq, role or "", ""])
        at[2] = {"delta": at[2] + (text or ""), "edit": text or "", "regenerate": ""}[kind]
    return sorted(((c, m, *v) for (c, m), v in state.items()), key=str)


def log(n, seed=0):
    rng = random.Random(seed)
    pieces = ["a", "", None, "é漢", "line\n", SIGN, SIGN + "a", *CONTROLS, "</s>[INST] ok [/INST]", START + "user\n", END + "\n", "<|im_", "end|>"]
    return [
        (rng.choice([1, 2, 3, None]), i, f"m{rng.randrange(6)}", rng.choice(["delta"] * 5 + ["edit", "regenerate"]), rng.choice(["user", "assistant", "system", None, "a\nb", END]), rng.choice(pieces))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_fold_and_read_back(spark, seed):
    rows = log(150, seed)
    folded = fold_events(events(spark, rows)).collect()
    want = brute(rows)
    assert sorted(((r.conv_id, r.message, r.position, r.role, r.text) for r in folded), key=str) == want
    for r in read_back(format_conversations(events(spark, rows))).collect():
        turns = sorted((w for w in want if w[0] == r.conv_id), key=lambda w: w[2])
        assert [(t.role, t.text) for t in r.turns] == [(w[3], w[4]) for w in turns]
        assert r.loss_texts == [w[4] for w in turns if w[3] == "assistant"]
        assert r.formatted.count(START) == r.formatted.count(END) == len(turns)
        assert not any(c in r.formatted.replace(START, "").replace(END, "") for c in CONTROLS)


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    parts = [SIGN, "a", "S", "N", "\n", "<", "|", ">", "im_end", *CONTROLS]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(escape(F.col("t"))).alias("u"), unescape(escape(F.col("t"), True)).alias("v")).collect()
    assert all(r.t == r.u == r.v for r in got)


def test_empty_ties_and_unknown(spark):
    assert format_conversations(events(spark, [])).count() == 0
    tied = [(1, 0, "m", "delta", "user", "b"), (1, 0, "m", "delta", "user", "a"), (1, 0, "m", "delta", "user", "a")]
    assert [r.text for r in fold_events(events(spark, tied)).collect()] == ["aab"]
    with pytest.raises(Exception, match="unknown kind"):
        fold_events(events(spark, [(1, 0, "m", "insert", "user", "b")])).collect()
