"""Every stage of the pipeline against brute force on what the stage before it kept."""

from __future__ import annotations

import hashlib

from collections import Counter

import pytest
from test_copies import best, classes
from test_mixing import brute as planned

import corpus_pipeline
from lumenprep.llm import quality
from lumenprep.operators.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    from conftest import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # Repeated rows, NULL and empty texts, NULL ids, sources and languages.
    odd = spark.createDataFrame(
        [(9005, None, None, None, None), (9006, "", "en", "src1", 0), (None, "A text of its own without an id, that nothing else is like at all.", "en", None, 67)] + [(7000, "The same row of words stands here many times over and over.", "en", "src2", 60)] * 30,
        docs.schema,
    )
    out = [stage(docs.unionByName(odd), "input")]
    for name, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], SF_DIR), name))
    return [x.collect() for x in out], [x.columns for x in out], SF_DIR


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(c == COLUMNS for c in stages[1][:-1]) and stages[1][-1][:5] == COLUMNS


def test_quality_stage(spark, stages):
    (before, after, *_), _, sf_dir = stages
    docs = spark.createDataFrame(before, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = Counter((r.doc_id, r.text) for r in quality.score_quality(docs, model).where("quality_score >= 0.3").collect())
    assert Counter((r.doc_id, r.text) for r in after) == want and 0 < len(after) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 2


def boilerplate(rows):
    """Lines to drop by source: over 30 % of its texts have them, or over 5 % and ten; a group of near copies is one text."""
    from test_copies import classes

    group = dict(classes([(i, t) for i, (_, _, t) in enumerate(rows)]))
    texts: dict = {}
    for i, (_, source, text) in enumerate(rows):
        of = texts.setdefault(source or "", {})
        one = hashlib.md5((text or "").encode()).digest(), text or ""
        of[group[i]] = min(of.get(group[i], one), one)
    out = {}
    for source, of in texts.items():
        lines = Counter(line for _, t in of.values() for line in {x.strip(" ") for x in t.split("\n")})
        n = len(of)
        if n >= 5:
            out[source] = {x for x, k in lines.items() if x and k >= 2 and (k > 0.3 * n or (k > 0.05 * n and k >= 10))}
    return out


def test_line_stage(stages):
    """The documented rule, counted in Python; near copies are found by their exact overlap here."""
    (_, before, after, *_), *_ = stages
    drop = boilerplate([(r.doc_id, r.source, r.text) for r in before])
    without = lambda r: r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in drop.get(r.source or "", ()))
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, without(r)) for r in before)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)


def test_near_copies_stage(stages):
    (_, _, before, after, *_), *_ = stages
    want = {c for _, c in classes([(r.doc_id, r.text) for r in before])}
    assert sorted((r.doc_id for r in after), key=str) == sorted(want, key=str)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_decontamination_stage(spark, stages):
    (_, _, _, before, after, _), _, sf_dir = stages
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    need = lambda item: min(13, -(-8 * len(item) // 10))
    # Equal words along a diagonal are equal words of the two texts: what has too few is not looked at.
    enough = lambda item, doc: (Counter(item) & Counter(doc)).total() >= need(item)
    leaks = lambda doc: any(enough(i, doc) and best(i, doc) >= need(i) for i in items if len(i) >= 8)
    short = [r for r in before if len(r.text or "") < 900]
    kept = {r.doc_id for r in after}
    assert {r.doc_id for r in short if not leaks((r.text or "").lower().split())} == kept & {r.doc_id for r in short}


def test_mixing_stage(stages):
    (*_, before, after), *_ = stages
    got: Counter = Counter()
    for r in after:
        got[r.doc_id, r.source] += r.mix_words
    assert got == Counter({(i, s): t for i, s, _, _, _, t in planned([(r.doc_id, r.text, r.source) for r in before]) if t})


def test_empty_input(spark, stages):
    from conftest import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF_DIR), "empty")
    assert docs.count() == 0
