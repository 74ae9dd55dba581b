"""Language, quality and language-model scoring: held-out accuracy, gradients and defined edge cases."""

from __future__ import annotations

import math
import re
import zlib

from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumenprep.llm import language, lm, quality


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def held_out(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 0


def test_language_accuracy(spark, docs):
    network = language.fit_language(docs, per_language=100)
    got = language.label_language(docs.select("doc_id", "text", "lang", F.lit(1).alias("lang_score")), network).collect()
    tested = [r for r in got if held_out(r.doc_id, 5)]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "The the and of thing " * 3000), (4, "漢字"), (None, "à")], "doc_id bigint, text string")
    out = {(r.doc_id, (r.text or "")[:3]): (r.lang_pred, r.lang_score) for r in language.label_language(odd, network).collect()}
    assert [out[k] for k in ((1, ""), (2, ""), (3, "12 "))] == [("und", 0.0)] * 3
    assert out[4, "The"][0] == "en" and out[4, "漢字"][0] in network.languages
    assert language.label_language(odd.limit(0), network).count() == 0


def test_language_without_labels(spark):
    odd = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    assert language.fit_language(odd) is None
    assert language.label_language(odd, None).first().lang_pred == "und"


def numeric(loss, table, at, step=1e-3):
    old = table[at]
    table[at] = old + step
    up = loss()
    table[at] = old - step
    down = loss()
    table[at] = old
    return (up - down) / (2 * step)


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    d = language.Direction(rng, 3)
    d.p = {k: v.astype(np.float64) for k, v in d.p.items()}
    x = rng.integers(0, 5, (6, 4))
    out = rng.standard_normal((6, 4, 3))
    kept: list = []
    d.run(x, kept)
    grads = d.gradients(x, kept, out)
    for k, at in (("x", (int(x[0, 0]), 1)), ("x", (int(x[2, 1]), 7)), ("u", (0, 4)), ("u", (2, 8)), ("u", (1, 0))):
        assert grads[k][at] == pytest.approx(numeric(lambda: float((d.run(x) * out).sum()), d.p[k], at, 1e-2), rel=0.05, abs=2e-2)


def test_bag_gradients():
    rng = np.random.default_rng(1)
    m = quality.AttentionModel(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, first, y = rng.standard_normal((12, quality.FEATURES)), np.array([0, 3, 4, 12]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, first)["y"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = m.gradients(m.forward(x, first), first, y)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        assert grads[k][at] == pytest.approx(numeric(loss, m.p[k], at), rel=0.01, abs=1e-5)


def test_quality_accuracy(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.quality_score for r in quality.score_quality(docs, model).collect()}
    tested = [(r.quality, got[r.doc_id] >= 0.3) for r in labels.collect() if held_out(r.doc_id, 5)]
    assert sum(a == b for a, b in tested) / len(tested) > 0.95
    odd = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "x " * 100_000, 1), (5, "a\n" * 500, 2)], "doc_id bigint, text string, quality_score int")
    out = quality.score_quality(odd, model)
    assert out.columns == ["doc_id", "text", "quality_score"] and out.count() == 4
    assert all(0 <= r.quality_score <= 1 for r in out.collect())
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([(None, 1), (2, None), (-9, 1)], "doc_id bigint, quality int")
    assert quality.fit_quality(docs, none) is None
    assert {r.quality_score for r in quality.score_quality(docs.limit(3), None).collect()} == {0.5}


def test_passages_do_not_depend_on_the_block():
    import pyarrow as pa

    from lumenprep.llm.words import blocks

    texts = ["", "one", " a b  c\n" * 70, "x" * 5000, None, "The the " * 300, "é | ß!! " * 64]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    whole, first = quality.passage_features(next(blocks([batch], "text")))
    for i, block in enumerate(blocks([batch], "text", limit=1)):
        alone, f = quality.passage_features(block)
        assert np.allclose(alone, whole[first[i] : first[i + 1]], atol=1e-6) and len(alone) == f[1] == max(1, -(-len((texts[i] or "").split()) // 64))


def test_lm_base_score_and_gain(spark, docs):
    got = lm.score_documents(docs, frequent_words=500).collect()
    rows = docs.collect()
    token = re.compile(rb"[^\x20\x09-\x0d]+")
    of = {r.doc_id: [*token.findall((r.text or "").encode().lower()), None] for r in rows}
    train = Counter(w for i, t in of.items() if not held_out(i, 10) for w in t)
    n, v = sum(train.values()), len(train)
    for r in got:
        t = of[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(r.doc_id, 10), len(t), n)
        assert r.n_known == sum(train[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_same_result_for_any_bound_on_frequent_words(spark, docs):
    a, b = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs.limit(80), sample_documents=40, frequent_words=n).collect()} for n in (0, 10**6))
    assert a == b


def test_lm_edge_cases(spark):
    schema = "doc_id bigint, text string, score int"
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b a", 1), (3, "a b a", 1), (None, "word " * 30_000, 1), (4, "x" * 3000, 1)], schema)
    got = lm.score_documents(odd, sample_documents=10).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(odd.limit(0)).count() == 0
    unseen = lm.score_documents(odd.where("doc_id is null")).first()
    assert unseen.held_out and unseen.train_tokens == 0 and unseen.score == unseen.base_score == 0


def test_attention_is_causal_and_normalised():
    opens = np.append(np.tile([True, False, False], lm.TOPICS), False)
    m = lm.AttentionModel.start(50, 49, opens)
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50, (4, lm.CONTEXT + lm.WIDTH))
    real = np.ones_like(ids, dtype=bool)
    g = m.gates(ids, real, lm.WIDTH)
    assert np.allclose(g.sum(-1), 1, atol=1e-5)
    later = ids.copy()
    later[:, lm.CONTEXT + 10 :] = 7
    assert np.allclose(m.gates(later, real, lm.WIDTH)[:, :10], g[:, :10], atol=1e-6)
    m.set_experts(np.zeros((50, len(opens))), rng.random(50), np.arange(50) % 2 == 0)
    assert np.allclose(m.experts[:, :-1].sum(0), 1, atol=1e-5) and not m.experts[:, -1].any()
    keys = np.unique(rng.integers(0, 50, 300) << lm.PAIR_BITS | rng.integers(0, 25, 300) * 2 + 1).astype(np.uint64)
    m.pairs = lm.Pairs(keys, rng.integers(1, 9, len(keys)), np.arange(50) % 2 == 0)
    every = np.array([[m.chances(np.array([a]), np.array([b]))[0, -1] for b in range(50)] for a in range(50)])
    assert np.allclose(every.sum(1), 1, atol=1e-5)


def test_attention_gradients():
    opens = np.tile([True, False, False], lm.TOPICS)
    m = lm.AttentionModel.start(20, 19, opens)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 20, (3, 12))
    real = np.ones_like(ids, dtype=bool)
    real[0, :3] = False
    target = rng.integers(0, len(opens), (3, 8))
    pick = np.eye(len(opens))[target]
    loss = lambda: float(-np.log((m.gates(ids, real, 8) * pick).sum(-1)).sum())
    s: dict = {}
    g = m.gates(ids, real, 8, s)
    grads = m.gradients(s, ids, g - pick)
    used, de = grads.pop("e")
    for k in grads:
        at = tuple(-1 for _ in m.p[k].shape)
        assert grads[k][at] == pytest.approx(numeric(loss, m.p[k], at, 1e-4), rel=0.02, abs=1e-3)
    assert de[0, 2] == pytest.approx(numeric(loss, m.p["e"], (int(used[0]), 2), 1e-4), rel=0.02, abs=1e-3)


def test_lm_same_result_for_any_bound_on_frequent_pairs(spark, docs):
    a, b, c = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs.limit(80), sample_documents=20, frequent_pairs=n).collect()} for n in (0, 200, 10**9))
    assert a == b == c


def test_lm_experts_learn_from_all_documents(spark, docs, monkeypatch):
    learned = []
    keep = lm.AttentionModel.set_experts

    def watch(self, counts, prior, opens, **options):
        keep(self, counts, prior, opens, **options)
        learned.append((counts.copy(), prior.copy()))

    monkeypatch.setattr(lm.AttentionModel, "set_experts", watch)
    rows = docs.limit(60).collect()
    lm.score_documents(spark.createDataFrame(rows, docs.schema), sample_documents=5).collect()
    subwords = lm.Subwords.of(lm.TOKENIZER)
    want: Counter = Counter()
    for r in rows:
        if not held_out(r.doc_id, 10):
            want[subwords.end] += 1
            for w in re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().lower()):
                want.update(subwords.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")))
    counts, prior = learned[-1]
    assert {i: n for i, n in enumerate(prior) if n} == want
    assert counts.sum(1) == pytest.approx([want[i] for i in range(subwords.size)], rel=1e-4, abs=0.01)


def block_of(texts):
    import pyarrow as pa

    from lumenprep.llm.words import blocks

    return next(blocks([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], "text"))


def test_lm_words_equal_a_plain_loop():
    """Every subword by itself, with loops over places and experts, in place of blocks of windows."""
    subwords = lm.Subwords.of(lm.TOKENIZER)
    rng = np.random.default_rng(11)
    model = lm.AttentionModel.start(subwords.size, subwords.end, np.append(np.tile([True, False, False], lm.TOPICS), False))
    model.set_experts(rng.integers(0, 9, (subwords.size, 25)), rng.random(subwords.size), subwords.opens)
    model.pairs = lm.Pairs(np.array([(500 << lm.PAIR_BITS) | 600], np.uint64), np.array([3]), subwords.opens)
    t = lm.tokens_of(block_of(["", "one", "Unbelievably long-winded   sentences, again and again. " * 7, None, "é ß\n12345678"]), subwords)
    first, rest = model.word_scores(t)
    p = {k: x.astype(np.float64) for k, x in model.p.items()}
    bounds = np.concatenate([[0], np.cumsum(t.sizes)])

    def weights(ids, i):
        start = i - i % lm.WIDTH
        read = range(max(0, start - lm.CONTEXT), i + 1)
        before = [subwords.end if j == 0 else ids[j - 1] for j in read]
        x = [p["e"][s] + p["pos"][j - start + lm.CONTEXT] for s, j in zip(before, read, strict=True)]
        raw = np.array([(x[-1] @ p["q"]) @ (y @ p["k"]) / math.sqrt(lm.DIM) for y in x])
        a = np.exp(raw - raw.max())
        y = x[-1] + (a / a.sum()) @ np.array([z @ p["v"] for z in x]) @ p["o"]
        h = y + np.maximum(0, y @ p["w1"] + p["b1"]) @ p["w2"]
        g = np.exp(h @ p["g"] + p["c"])
        return (1 - lm.FLOOR) * g / g.sum() + lm.FLOOR / len(g), before[-1]

    for a, b in zip(t.first[:-1], t.first[1:], strict=True):
        ids = t.ids[bounds[a] : bounds[b]]
        at = 0
        for w in range(a, b):
            logs = []
            for i in range(at, at + t.sizes[w]):
                g, before = weights(ids, i)
                logs.append(math.log(sum(g * model.chances(np.array([before]), np.array([ids[i]]))[0])))
            opening = math.log(weights(ids, at)[0][model.opens].sum())
            at += t.sizes[w]
            over = 0.0 if w == b - 1 else math.log(weights(ids, at)[0][model.opens].sum())
            assert first[w] == pytest.approx(logs[0] - opening, abs=1e-3)
            assert rest[w] == pytest.approx(sum(logs[1:]) + over, abs=1e-3)


def test_lm_topics_equal_a_plain_loop():
    subwords = lm.Subwords.of(lm.TOKENIZER)
    table = np.random.default_rng(4).normal(size=(subwords.size, lm.TOPICS)).astype(np.float32)
    t = lm.tokens_of(block_of(["", "incomprehensibilities of words " * 40, "a b", None]), subwords)
    bounds = np.concatenate([[0], np.cumsum(t.sizes)])
    want = []
    for a, b in zip(bounds[t.first[:-1]], bounds[t.first[1:]], strict=True):
        for i in range(a, b, lm.WIDTH):
            end = min(b, i + lm.WIDTH)
            topic = int(np.argmax(sum(table[s].astype(np.float64) for s in t.ids[i:end])))
            for j in range(i, end):
                place = j - bounds[np.searchsorted(bounds, j, "right") - 1]
                want.append(topic * 3 + min(place, 2))
    assert lm.topic_members(t, table).tolist() == want


def test_lm_scores_better_than_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score_documents(docs).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum() + 0.03 * out.n_tokens.sum()


def test_lm_learns_nothing_from_a_sample(spark, docs):
    """Topics and gates came from at most ``sample_documents`` pieces, so scores changed with it."""
    some = docs.limit(60)
    a, b = ({r.doc_id: r.score for r in lm.score_documents(some, sample_documents=n).collect()} for n in (1, 2000))
    assert a == b
    subwords = lm.Subwords.of(lm.TOKENIZER)
    counted, coded = lm.corpus_counts(some.select("text"), lm.TOKENIZER)
    table = np.random.default_rng(4).normal(size=(subwords.size, lm.TOPICS)).astype(np.float32)
    t = [lm.tokens_of(block_of([r.text]), subwords) for r in some.collect()]
    want = sum(np.bincount(x.ids.astype(np.int64) * lm.MEMBERS + lm.topic_members(x, table), minlength=subwords.size * lm.MEMBERS) for x in t)
    assert lm.topic_counts(coded, table, lm.TOKENIZER)[:, : lm.MEMBERS].ravel().tolist() == want.tolist()
    cells = {r.key: r["count"] for r in counted.where("kind = 'cell'").collect()}
    whole = sum(lm.together(x, lm.kind_of(subwords.size)) for x in t).ravel() * lm.CELL
    assert all(abs(whole[i] - cells.get(i, 0)) < 0.01 * lm.CELL for i in range(len(whole)))


def test_attention_of_counts_by_running_sums():
    rng = np.random.default_rng(6)
    m = lm.AttentionModel.start(50, 49, np.append(np.tile([True, False, False], lm.TOPICS), False))
    m.set_weights(rng.integers(0, 9, (50, len(m.opens))).astype(float), rng.integers(0, 9, (50, 3)).astype(float))
    ids = rng.integers(0, 50, (7, lm.CONTEXT + lm.WIDTH))
    real = np.ones_like(ids, dtype=bool)
    real[0, : lm.CONTEXT] = real[1, 20:] = False
    plain = m.gates(ids, real, lm.WIDTH, {})
    use = real[:, lm.CONTEXT :]
    assert np.allclose(m.gates(ids, real, lm.WIDTH)[use], plain[use], atol=1e-5) and np.allclose(plain[use].sum(-1), 1, atol=1e-5)


def test_lm_tasks_get_small_batches(spark, docs, tmp_path, monkeypatch):
    seen, bound = str(tmp_path / "seen"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    plain = type(docs).mapInArrow

    def watched(self, run, schema):
        def noted(batches):
            def each():
                for batch in batches:
                    with open(seen, "a") as out:
                        print(batch.nbytes, file=out)
                    yield batch

            return run(each())

        return plain(self, noted, schema)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    long = docs.where("length(text) > 500").withColumn("text", F.substring(F.repeat("text", 200), 1, 100_000)).limit(60).coalesce(1)
    assert lm.score_documents(long).count() == 60
    sizes = [int(x) for x in open(seen)]
    assert sum(sizes) > 6_000_000 and max(sizes) < lm.BATCH_BYTES + 2 * 100_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == bound


def test_lm_stages_subwords_by_document(spark, docs):
    some = docs.limit(50).select(F.coalesce("text", F.lit("")).alias("text"))
    subwords = lm.Subwords.of(lm.TOKENIZER)
    _, coded = lm.corpus_counts(some, lm.TOKENIZER)
    t = [lm.tokens_of(block_of([r.text]), subwords) for r in some.collect()]
    assert sorted(bytes(r.ids) for r in coded.collect()) == sorted(x.ids.astype(lm.id_type(subwords.size)).tobytes() for x in t)


def test_lm_words_cut_together_equal_words_cut_alone():
    subwords = lm.Subwords.of(lm.TOKENIZER)
    odd = ["end.", ",start", "a" * 60, "1234567", "x.y", "日本語", "naïve", "é", "…", "don't", "A.B.", ".,;:!?-_()[]", "\x00", " b", "²", "🙂", "9é", "B2B", "--a--", "ﬁn٣"]
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(odd, 30)) for _ in range(40)] + ["".join(map(chr, rng.integers(1, 127, 300))) for _ in range(40)]
    subwords.forget()
    t = lm.tokens_of(block_of(texts), subwords)
    alone = subwords.encoding.encode_ordinary
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    want = [[*(i for w in re.findall(r"[^\x20\x09-\x0D]+", x) for i in alone(" " + w.translate(lower))), subwords.end] for x in texts]
    bounds = lm.window_starts(t)[0]
    assert [t.ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    many = block_of([f"w{i}. v{i}" for i in range(20_000)])  # one call cuts a block's new words
    calls = []
    subwords.forget()
    try:
        subwords.encoding = type("Counted", (), {"encode_ordinary": staticmethod(lambda x: calls.append(1) or alone(x))})()
        lm.tokens_of(many, subwords)
    finally:
        subwords.encoding = alone.__self__
    assert len(calls) == 1


def coded_of(spark, *parts):
    subwords = lm.Subwords.of(lm.TOKENIZER)
    rows = [(bytearray(lm.tokens_of(block_of([x]), subwords).ids.astype(lm.id_type(subwords.size)).tobytes()),) for texts in parts for x in texts]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(parts)), "ids binary")


def test_lm_layer_is_fitted_to_all_documents(spark, docs, monkeypatch):
    """Its weights followed from counts by formula, all places asked the same, and no gradient was taken."""
    calls, plain = [], getattr(lm, "fitted", None)
    monkeypatch.setattr(lm, "fitted", lambda *given: calls.append((*given, plain(*given))) or calls[-1][-1])
    some = docs.limit(60)
    lm.score_documents(some).collect()
    start, coded, _, _, model = calls[0]
    subwords = lm.Subwords.of(lm.TOKENIZER)
    training = [lm.tokens_of(block_of([r.text]), subwords) for r in some.collect() if not held_out(r.doc_id, 10)]
    assert coded.count() == len(training)
    before, after = (sum(x.sum() for t in training for x in m.word_scores(t)) for m in (start, model))
    assert after > before + 0.05 * sum(len(t.which) for t in training)
    asked = model.p["q"].T @ model.p["e"].T
    weights = asked[:, [300, 400, 500]].T @ (model.p["e"] @ model.p["k"]).T
    assert np.ptp(weights - weights.mean(1, keepdims=True), axis=0).max() > 1e-3  # what is read depends on what reads
    assert (model.p["e"] == start.p["e"]).all() and set(model.p) == set(start.p)


def test_lm_layer_is_the_mean_of_tasks_by_windows(spark, docs):
    subwords = lm.Subwords.of(lm.TOKENIZER)
    texts = [r.text for r in docs.limit(12).collect()]
    rng = np.random.default_rng(5)
    model = lm.AttentionModel.start(subwords.size, subwords.end, np.append(np.tile([True, False, False], lm.TOPICS), False))
    counts = rng.integers(0, 9, (subwords.size, 25)).astype(float)
    model.pairs = lm.Pairs(np.array([(500 << lm.PAIR_BITS) | 600], np.uint64), np.array([3]), subwords.opens)
    model.set_experts(counts, rng.random(subwords.size), subwords.opens)
    model.set_weights(counts, rng.integers(0, 9, (subwords.size, 3)).astype(float))
    table = rng.normal(size=(subwords.size, lm.TOPICS)).astype(np.float32)
    given = [texts[:5]], [texts[5:10]], [texts[:5], texts[5:10]], [texts[5:11]]
    one, two, both, more = (lm.fitted(model, coded_of(spark, *x), table, lm.TOKENIZER).p for x in given)
    n = [sum(-(-len(lm.tokens_of(block_of([x]), subwords).ids) // lm.WIDTH) for x in some) for some in (texts[:5], texts[5:10])]
    for k in model.p:
        assert np.allclose(both[k], (n[0] * one[k] + n[1] * two[k]) / sum(n), atol=1e-5)
    assert not np.allclose(one["g"], model.p["g"], atol=1e-3) and not np.array_equal(two["g"], more["g"])


def test_lm_chances_leave_out_what_stands_there():
    subwords = lm.Subwords.of(lm.TOKENIZER)
    t = lm.tokens_of(block_of(["Unbelievably long-winded sentences, again and again. " * 3]), subwords)
    ids, opens = t.ids.astype(np.int64), np.append(np.tile([True, False, False], lm.TOPICS), False)
    place = lm.places_in_words(ids, subwords)
    member = 6 + place

    def model_of(left: int) -> lm.AttentionModel:
        """Counted on all subwords but the one at ``left``."""
        rest = np.arange(len(ids)) != left
        counts, prior = np.zeros((subwords.size, 25)), np.bincount(ids, minlength=subwords.size)
        np.add.at(counts, (ids[rest], member[rest]), 1)
        at = np.flatnonzero(rest & ~subwords.opens[ids])
        keys, n = np.unique((ids[at - 1] << lm.PAIR_BITS) | ids[at], return_counts=True)
        into = np.bincount(ids[~subwords.opens[ids]], minlength=subwords.size)
        m = lm.AttentionModel.start(subwords.size, subwords.end, opens)
        m.set_experts(counts, prior, subwords.opens)
        m.pairs = lm.Pairs(keys.astype(np.uint64), n, subwords.opens, into=into, after=np.bincount(ids[at - 1], minlength=subwords.size))
        return m

    whole = model_of(-1)
    got = lm.chances_without(whole, ids, np.arange(len(ids))[None], member, lm.inside_without(whole.pairs, ids))[0]
    for i in range(len(ids)):
        want = model_of(i).chances(ids[[i - 1]], ids[[i]])[0]
        own = [member[i], 24] if place[i] else [member[i]]
        assert got[i, own] == pytest.approx(want[own], rel=0.02)


def test_lm_fitted_layer_predicts_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score_documents(docs).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum() + 0.07 * out.n_tokens.sum()
