"""Runs of words against a search over all periods, and Lyndon words against their definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from conftest import SF_DIR
from lumenprep.llm import runs
from lumenprep.llm.queries import LLM_QUERIES
from lumenprep.llm.words import mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(x, min_words=24, min_periods=3):
    """(start, length, period) by trying every period; a stretch counts at its smallest one."""
    n, out = len(x), []
    for p in range(1, n // min_periods + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            end = i + p
            smaller = any(all(x[k] == x[k + q] for k in range(start, end - q)) for q in range(1, p))
            if end - start >= max(min_words, min_periods * p) and not smaller:
                out.append((start, end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_rows(docs):
    """The query's row of each document."""
    out = []
    for doc_id, text in docs:
        x = WORD.findall(text or "")
        n, h = len(x), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        found = brute_runs(x)
        gone = {i for s, m, p in found for i in range(s + p, s + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        left = " ".join(w for i, w in enumerate(x) if i not in gone)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(found), *figures, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, left))))
    return out


def sequence(rng, most):
    out = []
    size = rng.randint(1, 5)
    while len(out) < rng.randint(0, most):
        if rng.random() < 0.5:
            out += [rng.randrange(size) for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
        else:
            out.append(rng.randrange(size))
    return out


def test_lyndon_words():
    rng = random.Random(3)
    for _ in range(1500):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 24))]
        # The longest Lyndon word at i ends where a smaller suffix begins.
        want = [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]
        assert runs.lyndon_lengths([sorted(set(x)).index(v) for v in x]) == want


@pytest.mark.parametrize("min_words,min_periods", [(24, 3), (6, 2), (9, 3), (2, 2), (16, 4)])
def test_runs_of_blocks(min_words, min_periods):
    rng = random.Random(min_words)
    for _ in range(250):
        texts = [sequence(rng, 90) for _ in range(3)]
        first = np.cumsum([0, *map(len, texts)])
        words = mix64(np.array(sum(texts, []), dtype=np.uint64) + np.uint64(5))
        want = [(s + f, m, p) for t, f in zip(texts, first[:-1].tolist(), strict=True) for s, m, p in brute_runs(t, min_words, min_periods)]
        assert [tuple(r) for r in runs.block_runs(words, first, min_words, min_periods).tolist()] == want


def test_extensions():
    rng = random.Random(8)
    for _ in range(100):
        x = sequence(rng, 60) + [9]
        extend = runs.Extensions(np.array(x))
        pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
        if not pairs:
            continue
        a, b = (np.array(v) for v in zip(*pairs, strict=True))
        forward = [next((k for k in range(len(x) - j) if x[i + k] != x[j + k]), len(x) - j) for i, j in pairs]
        backward = [next((k for k in range(i) if x[i - 1 - k] != x[j - 1 - k]), i) for i, j in pairs]
        assert extend.forward(a, b).tolist() == forward and extend.backward(a, b).tolist() == backward


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = LLM_QUERIES["op11_word_runs"](spark, SF_DIR)
    assert sorted(map(tuple, got.collect())) == sorted(brute_rows([tuple(r) for r in docs]))
    assert dict(got.dtypes)["exponent_milli"] == "bigint" and got.where("n_runs > 0").count() > 5


def test_query_on_odd_texts(spark, tmp_path):
    rng = random.Random(4)
    tenth = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(str(v) for v in sequence(rng, 200))) for i in range(60)]
    rows += [(i, " ".join(f"w{v}é" for v in range(rng.randint(1, 80)))) for i in tenth]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (None, "a " * 30), (504, "a\x0bb\x0c" * 40 + " a b " * 3)]
    rows += [(505, "x y z " * 9)] * 3 + [(506, "long " + "a b c d e f g " * 30_000 + "end")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, LLM_QUERIES["op11_word_runs"](spark, str(tmp_path)).collect()), key=str)
    plain = [r for r in rows if r[0] is not None and r[0] != 506]
    assert [r for r in got if r[0] not in (None, 506)] == sorted(brute_rows(plain), key=str)
    assert [r[1:6] for r in got if r[0] == 506] == [(1, 1, 210_000, 7, 30_000_000)]
    assert [r[1:6] for r in got if r[0] is None] == [(1, 0, 30, 1, 30_000)]


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "kept", 5)], "Runs int, text string, `a.b` string, n_words int")
    out = runs.find_runs(docs)
    assert out.columns == ["text", "a.b", "n_words", "runs", "collapsed"]
    row = out.first()
    assert row["a.b"] == "kept" and row.n_words == 40 and row.collapsed == "a b" and [tuple(r) for r in row.runs] == [(0, 40, 2)]
    assert runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(docs, min_periods=1)


def test_other_thresholds(spark):
    docs = spark.createDataFrame([("a b a b a b c",), ("c a a a a",)], "text string")
    got = runs.find_runs(docs, min_words=4, min_periods=2).select("collapsed", F.size("runs").alias("n")).collect()
    assert sorted(map(tuple, got)) == [("a b c", 1), ("c a", 1)]
