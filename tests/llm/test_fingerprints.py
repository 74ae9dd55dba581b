"""Sketches against sets of shingles."""

from __future__ import annotations

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from lumenprep.llm.fingerprints import (
    _range_of,
    containment,
    distinct_shingles,
    fingerprint_documents,
    merge,
    merge_groups,
    resemblance,
    sketch,
    with_next,
)


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def rows():
    rng = random.Random(1)
    out = [(i * 3 - 20, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 4, 5, 30, 100])))) for i in range(60)]
    return [*out, (None, "null id here to sort first"), (7, None), (7, "tie on id"), (7, "tie on id"), (10**12, "é" * 9 + " ü ß 漢字 end of all")]


def test_edited_text_and_neighbours(spark):
    data = rows()
    docs = spark.createDataFrame([(a, b, 1) for a, b in data], "doc_id bigint, text string, sketch int")
    order = {r.doc_id: None for r in docs.collect()}
    got = with_next(docs.select("doc_id", "text"), rows_per_range=5).collect()
    assert len(got) == len(data)
    # Following the rows gives every row once, in the order of their ids.
    ids = sorted([i for i, _ in data], key=lambda i: (i is not None, i or 0))
    pairs = {(r.doc_id, r.text, r.next_text) for r in got}
    texts = {i: [t or "" for j, t in data if j == i] for i in order}
    for r in got:
        later = [i for i in ids if (i is not None) and (r.doc_id is None or i > r.doc_id)]
        allowed = texts[r.doc_id] + texts[later[0] if later else ids[0]]
        assert r.next_text in allowed
    assert len(pairs) >= len(set((i, t or "") for i, t in data)) - 1
    for r in fingerprint_documents(docs).collect():
        if data.count((r.doc_id, None)) or r.doc_id == 7:
            continue
        text = texts[r.doc_id][0]
        later = [i for i in ids if (i is not None) and (r.doc_id is None or i > r.doc_id)]
        if later and later[0] == 7:
            continue
        following = texts[later[0] if later else ids[0]][0]
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(text, edited))
        assert r.near_next == pytest.approx(likeness(text, following))
        assert r.shingles == len(shingles(text))


def test_ranges_agree_with_one_range(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id bigint, text string")
    few, many = (sorted((r.doc_id, r.next_text) for r in with_next(docs, rows_per_range=n).collect()) for n in (1000, 3))
    assert few == many == sorted((i, f"t{(i + 1) % 100}") for i in range(100))


def test_estimates_of_large_sets(spark):
    a = " ".join(f"w{i}" for i in range(20_000))
    b = " ".join(f"w{i}" for i in range(5_000, 20_000))
    r = (
        spark.createDataFrame([(a, b)], "a string, b string")
        .select(sketch(F.col("a")).alias("a"), sketch(F.col("b")).alias("b"), sketch(F.concat_ws(" ", "a", F.lit("x"), "b")).alias("u"))
        .select("*", resemblance(F.col("a"), F.col("b")).alias("j"), containment(F.col("b"), F.col("a")).alias("c"), distinct_shingles(F.col("a")).alias("n"), resemblance(merge(F.col("a"), F.col("b")), F.col("u")).alias("m"))
        .first()
    )
    assert len(r.a) == 128 and abs(r.j - 0.75) < 0.13 and r.c > 0.85 and abs(r.n / 20_000 - 1) < 0.3 and r.m > 0.95


def test_groups_merge_to_the_sketch_of_all(spark):
    docs = spark.createDataFrame([(i % 3, f"{' '.join(str((i * j) % 97) for j in range(40))}") for i in range(90)] + [(None, "x y"), (9, None)], "g int, text string")
    got = {r.g: r.s for r in merge_groups(docs.select("g", sketch(F.col("text")).alias("s")), ["g"], "s").collect()}
    assert set(got) == {0, 1, 2, None, 9} and got[9] == [] and len(got[None]) == 1
    one = docs.where("g = 1").select(F.explode(sketch(F.col("text"), 10_000)).alias("h")).distinct().orderBy("h").limit(128).collect()
    assert got[1] == [r.h for r in one]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fingerprint_documents(none).count() == 0
    r = fingerprint_documents(spark.createDataFrame([(1, "")], "doc_id bigint, text string")).first()
    assert (r.fingerprint, r.near_edited, r.near_next, r.n_chars) == ("", 1.0, 1.0, 0)


def test_range_of(spark):
    cuts = [-5, 0, 3, 4, 10, 11, 12]
    got = spark.range(-10, 20).select("id", _range_of(F.col("id"), cuts).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in got)
