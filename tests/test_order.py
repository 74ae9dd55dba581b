"""Positions, splits and mixing on uneven data, against plain Python."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from lumenprep.functions.draws import gate, pick, u01
from lumenprep.operators import index, mix, split
from lumenprep.operators.staging import join_staged, stage

SEED = 7


def h52(key, salt, seed=SEED):
    return int(hashlib.md5(f"{seed}:{key}:{salt}".encode()).hexdigest()[:13], 16)


@pytest.fixture(scope="module")
def uneven(spark):
    """One dataset holds most rows, another three, another a single class."""
    rows = [(i, "big", i % 10 == 0) for i in range(2000)]
    rows += [(5000 + i, "tiny", i == 0) for i in range(3)]
    rows += [(6000 + i, "single", False) for i in range(40)]
    rows += [(7000 + i, "unknown", None if i % 2 else True) for i in range(9)]
    frame = spark.createDataFrame(rows, "id bigint, dataset string, fake boolean")
    return frame.select("id", "dataset", F.col("fake").cast("int").alias("label"))


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_global_index_is_contiguous(uneven, partitions):
    got = index.global_index(uneven.repartition(partitions), ["dataset", "id"]).collect()
    ordered = sorted(got, key=lambda r: (r["dataset"], r["id"]))
    assert [r["idx"] for r in ordered] == list(range(len(got)))


def test_index_of_nothing(uneven):
    assert index.global_index(uneven.where("id < 0"), ["id"]).count() == 0
    assert index.hash_index(uneven.where("id < 0"), "id", SEED, "s").count() == 0


def test_attach_index(uneven):
    wide = uneven.withColumn("payload", F.repeat(F.lit("x"), 100))
    got = {r["id"]: r["idx"] for r in index.attach_index(wide, "id", ["id"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_rank_within(uneven):
    got = index.rank_within(uneven, "dataset", ["id"]).collect()
    for name, first in (("big", 0), ("tiny", 5000), ("single", 6000), ("unknown", 7000)):
        assert all(r["rank"] == r["id"] - first + 1 for r in got if r["dataset"] == name)


@pytest.mark.parametrize("bits", [1, 12, 20])
def test_hash_index_equals_sort(uneven, bits):
    got = {r["id"]: r["pos"] for r in index.hash_index(uneven, "id", SEED, "shuffle", bits=bits).collect()}
    want = sorted(got, key=lambda k: (h52(k, "shuffle"), k))
    assert [got[k] for k in want] == list(range(len(want)))


def expected_split(rows, fractions):
    """Largest remainder, then the smallest hashes of each class."""
    held = set()
    for name, fraction in fractions.items():
        members = [r for r in rows if r["dataset"] == name]
        n, k = len(members), math.ceil(fraction * len(members))
        classes = Counter(r["label"] for r in members)
        base = {c: k * m // n for c, m in classes.items()}
        order = sorted(classes, key=lambda c: (-(k * classes[c] % n), c is None, c or 0))
        for c in order[: k - sum(base.values())]:
            base[c] += 1
        for c, quota in base.items():
            ids = [r["id"] for r in members if r["label"] == c]
            held |= set(sorted(ids, key=lambda i: (h52(i, "split"), i))[:quota])
    return held


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_stratified_split(uneven, partitions):
    fractions = {"big": 0.013, "tiny": 0.4, "single": 0.1, "unknown": 0.5}
    got = split.stratified_split(uneven.repartition(partitions), fractions, "id", SEED).collect()
    assert len(got) == 2052
    held = {r["id"] for r in got if r["split"] == "eval"}
    assert held == expected_split(got, fractions)
    sizes = Counter(r["dataset"] for r in got if r["split"] == "eval")
    assert sizes == {"big": 26, "tiny": 2, "single": 4, "unknown": 5}


def test_dataset_without_fraction_stays_in_train(uneven):
    got = split.stratified_split(uneven, {"tiny": 0.4}, "id", SEED)
    assert [r["dataset"] for r in got.where("split = 'eval'").select("dataset").distinct().collect()] == ["tiny"]


def test_few_buckets_give_the_same_split(uneven):
    def eval_ids(bits):
        marked = split.mark_smallest(
            uneven, "id", ["dataset"], lambda t: t.selectExpr("dataset", "n div 3 AS k"), SEED, "s", "m", bits
        )
        return {r["id"] for r in marked.where("m").collect()}

    assert eval_ids(1) == eval_ids(12) == eval_ids(20)


def test_random_split(uneven):
    got = split.random_split(uneven, 0.1, "id", SEED).collect()
    held = {r["id"] for r in got if r["split"] == "eval"}
    ids = [r["id"] for r in got]
    assert held == set(sorted(ids, key=lambda i: (h52(i, "split"), i))[: math.ceil(0.1 * len(ids))])


def test_split_joins_nothing_wide(uneven):
    """Thresholds are broadcast: the rows themselves are not shuffled."""
    wide = uneven.withColumn("payload", F.repeat(F.lit("x"), 100))
    tagged = split.stratified_split(wide, 0.1, "id", SEED)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("fraction", [0.0, 1.0, -0.1, 2])
def test_bad_fraction(uneven, fraction):
    with pytest.raises(ValueError):
        split.random_split(uneven, fraction, "id", SEED)


def sets_of(spark, sizes):
    return [
        spark.range(n).select((F.col("id") + 100_000 * i).alias("id"), F.lit(i).alias("d"))
        for i, n in enumerate(sizes)
    ]


def round_robin(sizes):
    rows = zip_longest(*[[100_000 * i + k for k in range(n)] for i, n in enumerate(sizes)])
    return [x for row in rows for x in row if x is not None]


@pytest.mark.parametrize("sizes", [[5], [3, 0, 7], [1, 900, 30], [2, 2, 2, 2]])
def test_interleave(spark, sizes):
    got = mix.interleave(sets_of(spark, sizes), ["id"]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(sum(sizes)))
    assert [r["id"] for r in got] == round_robin(sizes)


def test_interleave_by_key_joins_wide_rows(spark):
    sets = [s.withColumn("text", F.lit("t")) for s in sets_of(spark, [4, 2])]
    got = mix.interleave(sets, ["id"], key="id").orderBy("pos").collect()
    assert [r["id"] for r in got] == round_robin([4, 2])
    assert got[0]["text"] == "t"


def test_concat_keeps_order_and_adds_missing_columns(spark):
    a, b = sets_of(spark, [3, 2])
    for key in (None, "id"):
        got = mix.concat([b.withColumn("x", F.lit(1)), a], ["id"], key).orderBy("pos").collect()
        assert [r["id"] for r in got] == [100_000, 100_001, 0, 1, 2]
        assert [r["x"] for r in got] == [1, 1, None, None, None]


def test_nothing_to_mix():
    with pytest.raises(ValueError):
        mix.concat([], ["id"])


def test_batches(spark):
    rows = spark.range(20).withColumnRenamed("id", "pos")
    whole = mix.batches(rows, 4, devices=2).orderBy("pos").collect()
    assert [r["batch_id"] for r in whole] == [i // 4 for i in range(20)]
    assert [r["device"] for r in whole] == [(i // 4) % 2 for i in range(20)]
    shared = mix.batches(rows, 4, devices=2, split_batches=True).orderBy("pos").collect()
    assert [r["device"] for r in shared] == [(i % 4) // 2 for i in range(20)]
    with pytest.raises(ValueError):
        mix.batches(rows, 3, devices=2, split_batches=True)


def test_budget_and_last_row(spark):
    rows = spark.range(10).withColumnRenamed("id", "pos")
    assert mix.sample_budget(rows, 4).count() == 4
    assert mix.drop_last(rows, 10).agg(F.max("pos")).first()[0] == 8


def test_draws(spark):
    row = spark.range(100_000).agg(
        F.avg(gate(F.col("id"), SEED, "g", 0.2).cast("int")).alias("share"),
        F.min(u01(F.col("id"), SEED, "u")).alias("lo"),
        F.max(u01(F.col("id"), SEED, "u")).alias("hi"),
        F.min(pick(F.col("id"), SEED, "p", 5)).alias("first"),
        F.max(pick(F.col("id"), SEED, "p", 5)).alias("last"),
    ).first()
    assert abs(row["share"] - 0.2) < 0.01
    assert 0 <= row["lo"] and row["hi"] < 1
    assert (row["first"], row["last"]) == (0, 4)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_join_to_a_staged_table(spark, limit):
    """Salted or broadcast, the join gives the same, NULL keys and a hot key included."""
    left = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k")
    )
    right = stage(left.groupBy("k").agg(F.max("id").alias("top")).where("k IS NULL OR k <> '1'"), "right")
    want = {}
    for r in left.collect():
        want.setdefault(r["k"], []).append(r["id"])
    for how in ("inner", "left"):
        got = join_staged(left, right, ["k"], "id", how, broadcast_rows=limit).collect()
        assert len(got) == (4999 if how == "inner" else 5000)
        assert all(r["top"] == (None if r["k"] == "1" else max(want[r["k"]])) for r in got)


def test_hot_key_is_spread(spark):
    """The rows of one hot key reach as many partitions as there are salts allow."""
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = stage(left.groupBy("k").agg(F.max("id").alias("top")), "right")
    with_off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_off}
    try:
        for k, v in with_off.items():
            spark.conf.set(k, v)
        joined = join_staged(left, right, ["k"], "id", broadcast_rows=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_split_of_nothing(uneven):
    none = uneven.where("id < 0")
    assert split.random_split(none, 0.1, "id", SEED).count() == 0
    assert split.stratified_split(none, 0.1, "id", SEED).count() == 0


def test_ungrouped_split_needs_no_join(uneven):
    plan = split.random_split(uneven, 0.1, "id", SEED)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
