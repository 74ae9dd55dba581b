"""The mix against a loop over rows."""

from __future__ import annotations

import hashlib
import re

import pytest

from pyspark.sql import functions as F

from lumenprep.llm.mixing import mix_sources, plan_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, size string, target string, epoch int"


def words(text):
    return len(WORD.findall(text or ""))


def rounded_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def brute(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    targets = rounded_targets(sizes)
    taken = []
    key = lambda r: (int(hashlib.md5(":".join(["42", *[str(r[0])] * (r[0] is not None), "mix"]).encode()).hexdigest()[:13], 16), -1 if r[0] is None else r[0])
    for source, target in targets.items():
        budget = int(target + 0.5)
        own = sorted((r for r in rows if r[2] == source), key=key)
        epochs, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        for r in own:
            n = words(r[1])
            part = max(0, min(n, rest))
            rest -= n
            taken.append((r[0], r[2], n, sizes[source], round(target, 6), epochs * n + part))
    return sorted(taken, key=str)


ROWS = [(i, "w " * (i % 7), "s%d" % (i % 4)) for i in range(200)] + [
    (500, None, "s1"), (501, "", None), (None, "a b\tc d", None), (502, "x " * 5000, "s9"), (503, "only", ""), (503, "only", ""),
    *[(900, "same words here", "hot")] * 150,
]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "clash", "clash", 1) for a, b, c in rows], SCHEMA)


def test_plan_equals_loop(spark):
    got = [(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in plan_mix(frame(spark, ROWS)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_budgets_are_met_to_the_word(spark):
    by = plan_mix(frame(spark, ROWS)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n")).collect()
    for r in by:
        assert r.taken == int(r.target + 0.5) and r.target <= 3 * r.n + 1e-9
    assert abs(sum(r.target for r in by) - sum(r.n for r in by)) < 1e-6


def test_rerun_agrees_whatever_the_partitions(spark):
    a = sorted(map(str, plan_mix(frame(spark, ROWS)).collect()))
    b = sorted(map(str, plan_mix(frame(spark, ROWS[::-1]).repartition(7)).collect()))
    assert a == b


def test_mixed_rows_hold_the_planned_words(spark):
    docs = frame(spark, ROWS)
    out = mix_sources(docs)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_words", "mix_target"]
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum("mix_words").alias("n")).collect()}
    want = {r.source: r.n for r in plan_mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}
    assert got == want


def test_empty(spark):
    assert plan_mix(frame(spark, [])).count() == 0
    assert mix_sources(frame(spark, [])).count() == 0
    none = plan_mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert sorted(r.taken for r in none) == [0, 0] and {r.target for r in none} == {0.0}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1}, {"a": 1, "b": 1000, "c": 2, "d": 3}, {None: 5, "z": 1}])
def test_water_level(spark, sizes):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in plan_mix(frame(spark, rows)).collect()}
    assert got == pytest.approx(rounded_targets(sizes))
