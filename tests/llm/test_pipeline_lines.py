"""Lines of a source in the pipeline: copies count as one text, and lines that recur over a few per cent of the texts go."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lumenprep.operators.staging import stage

COMMON, RARE = "This line stands in a tenth of the source.", "This line stands in three texts."


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    passage = [prose(rng, 40) for _ in range(6)]
    rows = []
    for source in ("exact", "near"):
        for i in range(120):
            lines = [prose(rng, 12) for _ in range(4)]
            if i % 10 == 0:
                lines.insert(2, COMMON)
            if i in (1, 2, 3):
                lines.insert(1, RARE)
            rows.append(("\n".join(lines), source))
        for i in range(60):
            lines = list(passage)
            if source == "near":
                lines[i % 6] += f" edit{i}"
            rows.append(("\n".join([source, *lines]), source))
    return [(i, text, "en", source, len(text)) for i, (text, source) in enumerate(rows)], passage


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_frequent_lines_go_and_rare_ones_stay(spark, corpus):
    rows, passage = corpus
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    want = {i: "\n".join(x for x in text.split("\n") if x != COMMON) for i, text, *_ in rows}
    assert out == want and any(RARE in x for x in out.values())


def test_a_copy_of_a_large_group_comes_out_with_its_text(spark, corpus, tmp_path):
    rows, passage = corpus
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.keep_one_copy(spark, stage(corpus_pipeline.drop_lines(spark, docs, str(tmp_path)), "lines"), str(tmp_path)).collect()
    assert sum(sum(x in r.text for x in passage) >= 5 for r in kept) == 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert any(sum(x in r.text for x in passage) >= 5 for r in out)
