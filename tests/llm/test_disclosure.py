"""Personal data against the plain patterns, and disclosing terms against counts in Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from conftest import SF_DIR
from lumenprep.llm import disclosure
from lumenprep.llm.queries import LLM_QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """(start, kind, end) by the plain patterns."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def listed(spans):
    return ",".join(f"{disclosure.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def rows_of(docs):
    out = []
    for i, text in docs:
        spans = base(text)
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        out.append((i, *counts, hashlib.sha256(listed(spans).encode()).hexdigest()))
    return sorted(out, key=str)


def noise(rng):
    parts = ["a@b.co", "x..%+@d-.e.f@g.h", "@", "me@host", "1.2.3.4", "256.1.1.1", "01.002.3.255.9.8.7.6.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (499) 555-6503", "+44", "+1------------", "+12345678901234567", "4242424242424242+1 222 333 4444", "é", " ", "9", ".", "-", " ", "\n", "12", "+"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " ", "."]) for _ in range(rng.randint(0, 25)))


def test_patterns_on_noise():
    rng = random.Random(2)
    for _ in range(4000):
        text = noise(rng)
        data = text.encode()
        got = [(len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in disclosure.entities(data)]
        assert got == base(text), text


def test_query_on_whole_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op13_personal_data"](spark, SF_DIR)
    assert got.dtypes == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in disclosure.KINDS], ("base_sha256", "string"), ("spans", "string")]
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == rows_of(docs)


def test_query_on_odd_texts(spark, tmp_path):
    rng = random.Random(7)
    docs = [(i, noise(rng)) for i in range(150)] + [(200, None), (201, ""), (None, "me@a.bc"), (202, "é" * 5 + " 1.1.1.1")] + [(203, "x@y.zz")] * 3
    docs += [(204, "a" * 2000), (205, "1" * 2000), (206, "1 " * 900 + "a@b.c"), (207, "+1" + "(" * 2000)]
    # Too long for the plain patterns, which try every start, or for Python's numbers.
    long = {
        300: ("a" * 1_000_000, ""), 301: ("1" * 1_000_000, ""), 302: ("1 " * 300_000 + "a@b.c", "email:600000:600005"),
        303: ("+1" + "(" * 1_000_000, ""), 304: ("0" * 5000 + ".1.1.1", "ip:0:5006"), 305: ("@a." * 200_000, ""),
    }
    docs += [(i, t) for i, (t, _) in long.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = LLM_QUERIES["op13_personal_data"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:6] for r in got if r.doc_id not in long), key=str) == rows_of([(i, t) for i, t in docs if i not in long])
    assert {r.doc_id: r.spans for r in got if r.doc_id in long} == {i: spans for i, (_, spans) in long.items()}


def brute_terms(texts, window=5, min_contexts=3, threshold=0.95):
    """Disclosing terms and their action, by counting."""
    texts = sorted({t for t in texts if t is not None})
    n = len(texts)
    beside, entity_texts, term_texts, class_texts = {}, {}, {}, {}
    make_up = lambda t: (sum(not c.isdigit() for c in t), sum(c.isdigit() for c in t))
    for x, text in enumerate(texts):
        spans = base(text)
        every = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer(text)]
        free = [(s, e, t) for s, e, t in every if not any(s < b and a < e for a, _, b in spans)]
        for _, _, t in every:
            term_texts.setdefault(t, set()).add(x)
            class_texts.setdefault(make_up(t), set()).add(x)
        for a, kind, b in spans:
            value = text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b])
            entity_texts.setdefault((kind, value), set()).add(x)
            before, after = [t for s, _, t in free if s < a], [t for s, _, t in free if s >= a]
            before, after = before[-window:], after[:window]
            for t in {*before, *after}:
                where = beside.setdefault(((kind, value), t), (set(), set()))
                where[0].add(x)
                where[1].add((tuple(before), tuple(after)))
    ratio = lambda both, e, t: math.log(both * n / (t * e)) / math.log(n / e) if n > e else 0.0
    out = {}
    for (entity, t), (where, around) in beside.items():
        e = len(entity_texts[entity])
        if len(around) < min_contexts or ratio(len(where), e, len(term_texts[t])) < threshold - 1e-12:
            continue
        like = set().union(*(w for (other, u), (w, _) in beside.items() if other == entity and make_up(u) == make_up(t)))
        action = 1 if ratio(len(like), e, len(class_texts[make_up(t)])) < threshold else 2
        out[t] = max(out.get(t, 0), action)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)] + ["of", "and", "the", "über"]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    texts = [" ".join(some(40)) for _ in range(200)]
    for k in range(8):  # a name and a number that stand only beside one address
        texts.append(" ".join([*some(12), "Zebulon,", "ann@corp.example", "QX123456789Y", *some(12)]))
    for k in range(6):  # always the same surroundings
        texts.append(" ".join(["copied", "Passage", "bob@corp.example", "stays", "equal", "here", "too", "now", *some(k + 1)]))
    texts += [" ".join([*some(9), "call", "+1 (499) 555-6503", "now", *some(9)]) for _ in range(5)] + ["zebulon alone", "ann@corp.example"]
    return [*texts, *texts[200:204], None, ""]


def test_disclosing_terms(spark, corpus):
    want = brute_terms(corpus)
    assert {"zebulon", "qx123456789y"} <= set(want) and want["zebulon"] == 1 and want["qx123456789y"] == 2 and "passage" not in want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id int, text string").repartition(6)
    for most in (disclosure.BROADCAST_TERMS, 0):
        out = disclosure.sanitise(docs, broadcast_terms=most).collect()
        seen = set()
        for r in out:
            plain = [(s.start, s.end, r.text[s.start : s.end].lower()) for s in r.pii_spans if s.kind == "term"]
            spans = base(r.text)
            seen |= {t for _, _, t in plain}
            assert [(s.start, s.end) for s in r.pii_spans if s.kind != "term"] == [(s, e) for s, _, e in spans]
            free = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer(r.text or "") if not any(m.start() < b and a < m.end() for a, _, b in spans)]
            assert plain == [x for x in free if x[2] in want]
        assert seen == set(want)
        text = {r.doc_id: r.sanitised for r in out}
        assert text[corpus.index("zebulon alone")] == "aaaaaaa alone" and "[EMAIL]  " in text[200] and "aaaaaaa, [EMAIL]" in text[200]
        assert [r.sanitised for r in out if not r.text] == ["", ""]


@pytest.mark.parametrize("options", [{"window": 2}, {"min_contexts": 1}, {"threshold": 0.5}])
def test_options(spark, corpus, options):
    want = brute_terms(corpus, **options)
    docs = spark.createDataFrame([(t,) for t in corpus], "text string")
    got = disclosure.disclosing_terms(docs, **options).collect()
    assert len(got) == len(want) and sorted(r.action for r in got) == sorted(want.values())


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", 7, "z")], "Sanitised int, text string, start int, `x.y` string")
    out = disclosure.sanitise(docs)
    row = out.first()
    assert out.columns == ["text", "start", "x.y", "pii_spans", "sanitised"] and row.start == 7 and row["x.y"] == "z" and row.sanitised == "[EMAIL]"
    assert disclosure.sanitise(docs.limit(0)).collect() == []


def test_rewrite_merges_overlaps():
    assert disclosure.rewrite("0123456789", [("ip", 1, 4, "[A]"), ("card", 2, 6, "[B]"), ("term", 7, 8, "")]) == "0[A]689"
