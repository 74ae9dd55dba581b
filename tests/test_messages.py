"""Messages, templates and token batches on hand-made rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lumenprep.functions import messages as M
from lumenprep.functions import sizing, template
from lumenprep.operators import collate


def chat(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], f"m {M.MESSAGES}")


def parts(row):
    return [(m["role"], [(p["type"], p["text"], p["media_idx"]) for p in m["content"]]) for m in row]


def normalised(spark, turns, n_images, video):
    df = chat(spark, turns).select(M.normalise_messages(F.col("m"), F.lit(n_images), F.lit(video)).alias("m"))
    return parts(df.first()["m"])


def test_one_image(spark):
    turns = [("user", "What's in this image?"), ("assistant", "It looks like a cat.")]
    assert normalised(spark, turns, 1, False) == [
        ("user", [("image", None, 0), ("text", "What's in this image?", None)]),
        ("assistant", [("text", "It looks like a cat.", None)]),
    ]


def test_system_video_and_two_users(spark):
    turns = [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")]
    assert normalised(spark, turns, 2, True) == [
        ("system", [("text", "s", None)]),
        ("user", [("image", None, 0), ("image", None, 1), ("video", None, 0), ("text", "a", None)]),
        ("assistant", [("text", "b", None)]),
        ("user", [("text", "c", None)]),
    ]
    assert normalised(spark, turns[:1], None, None) == [("system", [("text", "s", None)])]


def test_prepared_messages_are_left_alone(spark):
    kind = f"array<struct<role:string,content:string,parts:{M.PARTS}>>"
    done = [("text", "done", None)]
    df = spark.createDataFrame([([("user", None, done), ("user", "plain", None)],)], f"m {kind}")
    out = df.select(M.normalise_messages(F.col("m"), F.lit(1), F.lit(False), prepared=True).alias("m"))
    assert parts(out.first()["m"]) == [("user", done), ("user", [("image", None, 0), ("text", "plain", None)])]


@pytest.mark.parametrize("role", ["tool", None])
def test_bad_role(spark, role):
    df = chat(spark, [("user", "a"), (role, "b")], [("user", "a")])
    assert [r[0] for r in df.select(M.has_bad_role(F.col("m"))).collect()] == [True, False]
    with pytest.raises(Exception, match="invalid role"):
        df.select(M.normalise_messages(F.col("m"), F.lit(0), F.lit(False))).collect()


def test_media_count_and_modality(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS ARRAY<INT>)), (array()), (array(1, 2)) AS t(images)")
    n = M.media_count(F.col("images"))
    assert [tuple(r) for r in df.select(n, M.modality(n)).collect()] == [(0, "video"), (0, "video"), (2, "image")]
    assert [len(r[0]) for r in df.select(M.or_empty(F.col("images"))).collect()] == [0, 0, 2]


def test_completion_of_null_label(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (1), (NULL) AS t(label)")
    got = [r[0] for r in df.select(M.completion_from_label(F.col("label"))).collect()]
    assert [g and g[0]["content"] for g in got] == ["Real", "Fake", None]


def test_policy():
    with pytest.raises(ValueError):
        M.keep_or_derive(None, None, "drop")


def test_video(spark):
    df = spark.sql("SELECT * FROM VALUES ('aGVsbG8='), ('%%%'), (NULL) AS t(v)")
    got = df.select(M.decode_video(F.col("v")), M.bad_video(F.col("v"))).collect()
    assert [(r[0] and bytes(r[0]), r[1]) for r in got] == [(b"hello", False), (None, True), (None, False)]


def test_suffix_of_the_rendering(spark):
    df = chat(spark, [("user", "q"), ("assistant", "a\n")]).select(
        template.render_messages(F.slice("m", 1, 1), add_answer_header=True).alias("p"),
        template.render_messages(F.col("m")).alias("f"),
    )
    row = df.select("*", template.completion_suffix(F.col("f"), F.col("p")).alias("c")).first()
    assert row["p"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    assert row["c"] == "a\n<|im_end|>\n"


def test_frames_and_steps(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (1), (5), (100) AS t(n)")
    got = df.select(sizing.all_frames(F.col("n")), sizing.spread_frames(F.col("n"), 4)).collect()
    assert [len(r[0]) for r in got] == [0, 1, 5, 100]
    assert [list(r[1]) for r in got] == [[], [0], [0, 1, 2, 3], [0, 25, 50, 75]]
    steps = sizing.run_steps(F.lit(700_000), F.lit(2), F.lit(2), F.lit(1), F.lit(1))
    assert spark.range(1).select(steps).first()[0] == 175_000


def test_frames_of_empty_and_unknown_texts(spark, tmp_path):
    """A text of 0 or NULL characters ended the query; its rows are those of the SQL."""
    counts = "VALUES (1, 0), (2, NULL), (3, 1), (4, 29), (5, 31), (6, 300000000) AS t(doc_id, n)"
    docs = spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n_chars FROM {counts}")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["frame_indices"](spark, str(tmp_path)).orderBy("doc_id").collect()
    tables = oracle_sql()["frame_indices"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in found] == duckdb.sql(f"SELECT * FROM ({tables}) ORDER BY doc_id").fetchall()


def test_frames_listed_in_blocks(spark):
    df = spark.sql("SELECT * FROM VALUES (-1), (0), (1), (6), (7), (8), (20), (21), (NULL) AS t(n)")
    got = df.select("n", *sizing.frame_range(F.col("n"), 7)).collect()
    assert [tuple(r)[1:] for r in got] == [(r["n"], None if r["n"] is None else r["n"] - 1) for r in got]
    unknown = df.where("n IS NULL").select(sizing.all_frames(F.col("n")), sizing.spread_frames(F.col("n"), 4)).first()
    assert tuple(unknown) == (None, None)


@pytest.mark.parametrize(
    "h, w, want",
    [(512, 512, (512, 512)), (100, 100, (512, 512)), (4000, 3000, (1312, 960)), (1, 1, (512, 512))],
)
def test_resize_plan(spark, h, w, want):
    plan = sizing.resize_plan(F.lit(h), F.lit(w), 262_144, 1_310_720)
    got = tuple(spark.range(1).select(*plan).first())
    assert got == want and got[0] * got[1] <= 1_310_720


def collated(spark, rows, **options):
    df = spark.createDataFrame(rows, "batch_id int, prompt_ids array<int>, completion_ids array<int>")
    out = collate.collate(df.withColumn("n", F.monotonically_increasing_id()), **options).orderBy("n")
    return [(list(r["input_ids"]), list(r["attention_mask"]), list(r["labels"]), r["n_loss_tokens"]) for r in out.collect()]


ROWS = [(0, [1, 2], [3]), (0, [4], [5, 6, 7]), (1, [8], []), (1, None, [9])]


def test_collate(spark):
    assert collated(spark, ROWS) == [
        ([1, 2, 3, 0], [1, 1, 1, 0], [-100, -100, 3, -100], 1),
        ([4, 5, 6, 7], [1, 1, 1, 1], [-100, 5, 6, 7], 3),
        ([8], [1], [-100], 0),
        ([9], [1], [9], 1),
    ]


def test_collate_truncated_and_padded(spark):
    got = collated(spark, ROWS, max_length=2, pad_to_multiple_of=4, pad_id=99)
    assert got[0] == ([1, 2, 99, 99], [1, 1, 0, 0], [-100] * 4, 0)
    assert got[1] == ([4, 5, 99, 99], [1, 1, 0, 0], [-100, 5, -100, -100], 1)


def test_collate_whole_loss(spark):
    assert collated(spark, ROWS, completion_only=False)[0] == ([1, 2, 3, 0], [1, 1, 1, 0], [1, 2, 3, -100], 3)


def test_flush_left_of_holes(spark):
    df = spark.createDataFrame(
        [(0, [0, 1, 0, 2], [0, 1, 0, 1]), (0, [5, 0, 0, 0], [1, 0, 0, 0])],
        "batch_id int, ids array<int>, mask array<int>",
    )
    got = collate.flush_left(df, "mask", {"ids": -1}).collect()
    assert sorted((list(r["ids"]), list(r["mask"])) for r in got) == [([1, 2], [1, 1]), ([5, -1], [1, 0])]
