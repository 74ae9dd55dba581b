"""Places of rows from their files: no join, no shuffle, and the same places as by sorting."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from lumenprep.operators import index, mix
from lumenprep.plans.prepare import prepare
from lumenprep.plans.spec import DatasetSpec, JobSpec
from lumenprep.sources.load import load_placed, load_split
from lumenprep.sources.schema import ENCODED_IMAGE, SOURCE_ORDER


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two datasets with uneven files of several row groups, and one without rows."""
    root = str(tmp_path_factory.mktemp("sets"))
    for name, n, parts in (("a", 100, 4), ("b", 37, 3)):
        for split, size in (("train", n), ("test", n // 5)):
            rows = spark.range(size).select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit("v" * 50).alias("video"))
            writer = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").write
            writer.option("parquet.block.size", 256).parquet(f"{root}/{name}/c/{split}")
    spark.range(0).select("id", F.lit(1).alias("label"), F.lit("").alias("video")).write.parquet(f"{root}/none/c/train")
    return root


def specs(root, **splits):
    return [DatasetSpec(n, path=f"{root}/{n}", config="c", image_type=ENCODED_IMAGE, **s) for n, s in splits.items()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


JOBS = [
    {"a": {"train_split": "train", "eval_split": "test"}, "b": {"train_split": "train"}},
    {"a": {"train_split": "train[:30%]+train[-25:]+test", "eval_split": "test[3:7]"}, "none": {}, "b": {"train_split": "train[40%:]", "eval_split": "train[:40%]"}},
]


@pytest.mark.parametrize("job", JOBS)
@pytest.mark.parametrize("how", ["concat", "interleave"])
def test_job_over_files_joins_and_moves_nothing(spark, folder, job, how):
    datasets = specs(folder, **job)
    out = prepare(spark, JobSpec(datasets, 1, mix=how))
    plan = plan_of(out)
    assert "Join" not in plan and "Exchange" not in plan and "Sort" not in plan
    # The same job with the rows as frames, which are sorted.
    want = {}
    for split in ("train", "eval"):
        listed = []
        for i, d in enumerate(datasets):
            text = getattr(d, f"{split}_split")
            rows = [] if text is None else load_split(spark, d, text).orderBy(*SOURCE_ORDER).collect()
            listed.append([r.example_id for r in rows])
        order = [x for part in listed for x in part]
        if how == "interleave":
            order = [part[k] for k in range(max(map(len, listed))) for part in listed if k < len(part)]
        want.update({(split, p): x for p, x in enumerate(order)})
    assert {(r.split, r.pos): r.example_id for r in out.collect()} == want


def test_budget_and_messages(spark, folder):
    job = JobSpec(specs(folder, a={"eval_split": "test"}, b={}), 1, mix="interleave", num_total_samples=11)
    rows = prepare(spark, job).collect()
    assert sorted(r.pos for r in rows if r.split == "train") == list(range(11)) and sum(r.split == "eval" for r in rows) == 20
    assert all(r.completion[0].content == ("Fake" if r.label else "Real") and "video" in r.prompt[0].content for r in rows)


def test_fraction_or_shuffle_still_draws(spark, folder):
    held = prepare(spark, JobSpec(specs(folder, a={"eval_split": 0.1}), 1)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in held} == {"train": 90, "eval": 10}
    mixed = prepare(spark, JobSpec(specs(folder, a={}), 1, shuffle=True)).orderBy("pos").collect()
    assert [r.pos for r in mixed] == list(range(100)) and [r.src_row for r in mixed] != sorted(r.src_row for r in mixed)


@pytest.mark.parametrize("literal", [0, 256])
def test_file_index(spark, folder, literal):
    rows = mix.source_rows(spark.read.parquet(f"{folder}/a/c/train"))
    placed = index.file_index(rows, literal_files=literal)
    assert ("Join" in plan_of(placed)) == (literal == 0) and "Exchange hashpartitioning" not in plan_of(placed)
    assert sorted((r.idx, r.id) for r in placed.collect()) == [(i, i) for i in range(100)]


@pytest.mark.parametrize("how", ["concat", "interleave"])
def test_mixing_files_equals_mixing_by_sort(spark, folder, how):
    sets = [mix.source_rows(spark.read.parquet(f"{folder}/{n}/c/train")) for n in ("a", "b", "none")]
    by_files, by_sort = (getattr(mix, how + tail)(sets, *more) for tail, more in (("_files", ()), ("", (SOURCE_ORDER,))))
    assert "Join" not in plan_of(by_files) and "Exchange" not in plan_of(by_files)
    assert by_files.columns == by_sort.columns
    assert sorted((r.pos, r.ds_pos, r.id) for r in by_files.collect()) == sorted((r.pos, r.ds_pos, r.id) for r in by_sort.collect())


def test_places_of_nothing(spark, folder):
    rows, n = load_placed(spark, specs(folder, none={})[0], "train[:50%]")
    assert n == 0 and rows.collect() == []
