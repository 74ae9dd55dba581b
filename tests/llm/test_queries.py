"""The registered queries on whole tables: against SQL where there is some, else their rows and columns."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, rows
from conftest import SF_DIR
from lumenprep.llm.queries import LLM_ORACLES, LLM_QUERIES

COLUMNS = {
    "op1_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_near_copies": {"doc_id": "bigint", "class_id": "bigint"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_format_conversations": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op10_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_all_queries_and_the_pipeline():
    assert sorted(int(q[2:].split("_")[0]) for q in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = LLM_QUERIES[name](spark, SF_DIR).toPandas(), db.execute(LLM_ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, db, name):
    got = LLM_QUERIES[name](spark, SF_DIR)
    kinds = dict(got.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    source = "(SELECT count(DISTINCT conv_id) + 1 FROM conversations)" if name.startswith("op9") else "(SELECT count(*) FROM documents)"
    assert got.count() == db.execute(f"SELECT {source}").fetchone()[0]
