"""Ranked search against a plain loop over items and documents."""

from __future__ import annotations

import math
import random
import re

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenprep.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, limit=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c
            )
            if score > 0:
                scored.append((i, score))
        scored.sort(key=lambda r: (-r[1], r[0] is not None, r[0]))
        out += [(item, rank, i, score) for rank, (i, score) in enumerate(scored[:limit], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items, kind="bigint"):
    return (
        spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(5),
        spark.createDataFrame(items, "item_id bigint, text string").repartition(2),
    )


def found(*args, **options):
    return sorted(map(tuple, search.rank_documents(*args, **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice(["Été", "x1", "STRASSE", "straße", "a"]) if rng.random() < 0.2 else f"w{int(rng.expovariate(0.05))}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(300)]
    docs += [(1000 + i, "tie-word w1, w2") for i in range(120)]  # equal scores beyond the cut
    docs += [(2000, "repeated w3")] * 4 + [(3000, None), (3001, ""), (3002, "-- !"), (None, "w1 w2"), (-5, "tie-word w1, w2")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(30)]
    items += [(100, "w1 W1 w2;tie word"), (100, "w3"), (101, None), (102, ""), (103, "nowhere"), (None, "w5 w6")]
    return docs, items


def test_ranks(spark, corpus):
    got = search.rank_documents(*frames(spark, *corpus))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(*corpus)


@pytest.mark.parametrize("options", [{"limit": 3}, {"block_bytes": 200}, {"tile_cells": 1}, {"tile_terms": 1}, {"limit": 1, "tile_cells": 50, "tile_terms": 7}])
def test_tiles_and_blocks(spark, corpus, options):
    assert found(*frames(spark, *corpus), **options) == brute(*corpus, limit=options.get("limit", 50))


def test_string_ids(spark, corpus):
    docs, items = corpus
    named = [(None if i is None else f"d{i}é", t) for i, t in docs]
    assert found(*frames(spark, named, items, "string"), limit=7) == brute(named, items, 7)


def test_empty(spark):
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = search.rank_documents(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_clashing_columns(spark, corpus):
    docs, items = frames(spark, *corpus)
    for c in ("doc", "score", "rank", "item", "part", "size", "item_id"):
        docs = docs.selectExpr("*", f"'x' AS {c}")
    items = items.selectExpr("*", "1 AS term", "2 AS doc_id", "3 AS item")
    assert found(docs, items, limit=2) == brute(*corpus, limit=2)


def test_sums_stay_exact():
    """Impacts so large that two of them pass 2^53 are added as whole numbers."""
    tile = search.Tile(0, np.array([3, 5, 9]), np.array([[1.0, 1, 1], [0, 1, 1]]))
    impact = np.array([2**52 + 1, 2**52 + 3, 2**52 + 1])
    scores = search.tile_scores(tile, np.array([3, 5, 9]), np.zeros(3, np.int64), impact, 1, 2048)
    assert scores.tolist() == [[3 * 2**52 + 5], [2 * 2**52 + 4]]


def test_best_keeps_ties_by_id():
    best = search.Best(1, 3, pa.int64())
    rng = random.Random(1)
    rows = [(rng.randrange(3) + 1, i) for i in rng.sample(range(10**6), 400)]
    for row in range(0, 400, 20):
        part = rows[row : row + 20]
        best.add(0, np.array([[s for s, _ in part]]), pa.array([i for _, i in part]))
        best.settle()
    item, score, ids = best.settle()
    assert list(zip(score.tolist(), ids.to_pylist(), strict=True)) == sorted(rows, key=lambda r: (-r[0], r[1]))[:3]


def test_long_text(spark):
    docs = [(1, "needle " + "hay " * 400_000), (2, "needle hay"), (3, "none")]
    items = [(1, "needle")]
    assert found(*frames(spark, docs, items)) == brute(docs, items)
