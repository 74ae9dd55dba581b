"""Near copies, repeated passages and benchmark items against brute force."""

from __future__ import annotations

import random

from collections import Counter

import numpy as np
import pytest

from lumenprep.llm import decontaminate, near_dup, suffix_dedup
from lumenprep.llm.components import connected_components


# -- near copies -------------------------------------------------------------------------------------------------------


def multiset(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows, threshold=0.8):
    """Components by comparing all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    bags = [multiset(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if i is not None:
            least[of[t or ""]] = min(least.get(of[t or ""], i), i)
    return sorted(((i, least.get(of[t or ""])) for i, t in rows), key=str)


def corpus(seed, families=12, copies=8, edits=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    out, i = [], 100
    for f in range(families):
        base = [word() for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(len(text))] = word()
            out.append((i, " ".join(text)))
            i += 1
        out.append((i, " ".join(base * 3)))
        i += 1
    out += [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "one two"), (None, "null id"), (6, "null id"), (7, " one\n")]
    out += [(8, "the same line again " * 50)] * 20 + [(9, "the same line again " * 49)]
    return out


def test_weighted_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 60), rng.integers(0, 9, 60)
    keep = wb > 0
    a = near_dup.signatures(h, np.zeros(60, int), wa, 1, 4000)
    b = near_dup.signatures(h[keep], np.zeros(keep.sum(), int), wb[keep], 1, 4000)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - true) < 0.03


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, key int")
    got = sorted(((r.doc_id, r.class_id) for r in near_dup.near_copies(docs).collect()), key=str)
    assert got == classes(rows)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, c in classes(rows)}, key=str)


def test_chain_in_a_large_bucket(spark):
    # Each text is near the next one only, so groups join through many links.
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        base[(i * 3) % 200] = f"new{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dup.near_copies(docs).collect()) == sorted(classes(rows))


def test_outsiders_do_not_meet_a_whole_group(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]

    def changed(words, n, mark):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"{mark}x{at}"
        return words

    texts = [base] + [changed(base, 3, f"g{i}") for i in range(250)]
    for i in range(40):  # outsiders in pairs, so none of their shingles is alone
        one = changed(base, 6, f"o{i}")
        texts += [one, changed(one, 1, f"p{i}")]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    compared = []
    overlap = near_dup.overlap
    monkeypatch.setattr(near_dup, "overlap", lambda pairs, *options: compared.append(pairs.count()) or overlap(pairs, *options))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_copies(docs, bands=24, band_rows=1).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got)) == sorted(classes(rows))
    assert sum(compared) < 10 * len(rows)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dup.near_copies(docs).count() == 0 and near_dup.keep_one(docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, rng.randrange(101, 400)) for _ in range(80)] + [(900, 901), (901, 900), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: 0 for i in range(51)} | {n: 100 for e in edges[50:130] for n in e} | {900: 900, 901: 900}
    assert got == want


# -- repeated passages -------------------------------------------------------------------------------------------------


def removed(texts, length):
    starts = Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            starts[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        out.append((len(d), len(d) - len(kept), spans, kept))
    return out


def passages(seed, length, alphabet="abc é"):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randint(length // 2, 3 * length)) for _ in range(8)]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(text(rng.randrange(length)))
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) // 3))
            parts.append(s[a : a + rng.randint(length // 2, len(s))])
        out.append("".join(parts))
    return [*out, None, "", out[3], out[3], "a" * (length - 1), "a" * (length - 1), "a" * (3 * length), "ab" * length, text(20 * length)]


def repeats(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans binary")
    rows = sorted(suffix_dedup.remove_repeats(docs, **options).collect())
    return [(r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in rows]


@pytest.mark.parametrize("length, gram, seed", [(400, 64, 1), (40, 8, 2), (40, 8, 3), (24, 20, 4)])
def test_removed_bytes(spark, length, gram, seed):
    texts = passages(seed, length)
    assert repeats(spark, texts, length=length, gram=gram) == removed(texts, length)


def test_removed_bytes_of_large_groups(spark):
    texts = passages(5, 40)
    assert repeats(spark, texts, length=40, gram=8, group_limit=1) == removed(texts, 40)


def test_one_letter_texts(spark):
    texts = ["a" * 500, "a" * 401, "a" * 400, "a" * 399, "b" * 400, "b" * 401 + "c"]
    assert repeats(spark, texts) == removed(texts, 400)


def test_repeats_of_nothing(spark):
    assert repeats(spark, []) == [] and repeats(spark, ["short", "short", None]) == removed(["short", "short", None], 400)


def test_blocks_of_groups_keep_groups_whole(spark, monkeypatch):
    texts = passages(6, 40, "ab")
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 5)
    assert repeats(spark, texts, length=40, gram=8) == removed(texts, 40)


# -- benchmark items ---------------------------------------------------------------------------------------------------


def best(item, doc):
    """Largest number of equal words in a stretch with enough of them, along any diagonal."""
    found = 0
    for d in range(-len(item) + 1, len(doc)):
        same = [item[i] == doc[i + d] for i in range(len(item)) if 0 <= i + d < len(doc)]
        found = max(found, *(sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if sum(same[a:b]) >= 0.75 * (b - a)), 0)
    return found


def test_items_in_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    items = [[word() for _ in range(n)] for n in (5, 8, 10, 14, 20, 38, 38, 60)]
    docs = []
    for i, item in enumerate(items * 4):
        text = [word() for _ in range(rng.randint(0, 60))]
        part = list(item)
        for _ in range(rng.randrange(1 + len(part) // 8)):
            part[rng.randrange(len(part))] = word()
        cut = rng.choice([len(part), len(part), len(part) // 2])
        docs.append((i, " ".join([*text, *part[:cut], word()]).title()))
    docs += [(900 + i, " ".join(word() for _ in range(80))) for i in range(20)] + [(None, " ".join(items[5])), (7, None), (8, ""), (9, " ".join(items[4]) * 1), (9, " ".join(items[4]))]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(50, " ".join(items[5])), (51, None), (52, "")]
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_contamination(spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, seeds int"), spark.createDataFrame(bench, "item_id bigint, text string")).collect())
    want, bad = Counter(), set()
    for i, text in docs:
        for j, item in enumerate(items):
            # Items under 8 words must stand there word for word.
            if best(item, (text or "").lower().split()) >= (len(item) if len(item) < 8 else min(13, -(-8 * len(item) // 10))):
                want[i, j] += 1
                bad.add((i, text))
    assert got == want
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, text in docs if (i, text) not in bad), key=str)  # a clean row stays whatever others of its id hold


def test_no_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a " * 20)], "doc_id bigint, text string"), spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, items.limit(0)).count() == 0
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0
    assert decontaminate.find_contamination(docs, items).count() == 1


def substituted(rng, item, places):
    out = list(item)
    for p in places:
        out[p] = f"other{rng.randrange(10**6)}"
    return out


def test_stretch_with_most_equal_words():
    rng = random.Random(11)
    for _ in range(600):
        same = [rng.random() < rng.choice([0.5, 0.75, 0.9]) for _ in range(rng.randrange(40))]
        shares = [(sum(same[a:b]), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if sum(same[a:b]) >= 0.75 * (b - a)]
        begin, end = decontaminate.best_stretch(np.array(same, bool), 0.75)
        assert (sum(same[begin:end]), begin - end) == max(shares, default=(0, 0))
    nine = np.array([True] * 9 + [False] * 3 + [True] * 9)
    assert decontaminate.best_stretch(nine, 0.75) == (0, 21)


def test_items_with_substitutions(spark):
    rng = random.Random(12)
    items, docs = [], []
    for n, k in [(16, 2), (16, 3), (20, 3), (20, 4), (24, 4), (15, 2), (21, 3)] * 12:
        i = len(items)
        item = [f"w{i}x{j}" for j in range(n)]
        # Adjacent in every other case; a run of eight words is left, so a seed stands in the document.
        while True:
            begin = rng.randrange(n - k)
            places = range(begin, begin + k) if i % 2 else sorted(rng.sample(range(n), k))
            if max(b - a - 1 for a, b in zip([-1, *places], [*places, n], strict=True)) >= 8:
                break
        items.append(item)
        docs.append((i, " ".join(["before", *substituted(rng, item, places), "after"])))
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")).collect()
    want = {i: best(items[i], text.split()) for i, text in docs}
    assert {r.doc_id: r.matched for r in found} == {i: m for i, m in want.items() if m >= min(13, -(-8 * len(items[i]) // 10))}
    assert all(r.doc_id == r.item_id and r.matched >= 0.75 * r.aligned for r in found) and len(found) > 60


@pytest.mark.parametrize("n", range(3, 25))
def test_recall_by_length_and_substitutions(n):
    """Of the placements that the rule accepts, the masks hit at least nine in ten."""
    rng = random.Random(n)
    for k in range(5):
        if k > n:
            continue
        accepted = found = 0
        for _ in range(400):
            gone = set(rng.sample(range(n), k))
            begin, end = decontaminate.best_stretch(np.array([i not in gone for i in range(n)]), 0.75)
            if end - begin - len(gone & set(range(begin, end))) < decontaminate.needed(n):
                continue
            accepted += 1
            found += any(
                all(c == "0" or o + j not in gone for j, c in enumerate(mask)) for mask in decontaminate.masks_of(n) for o in range(n - len(mask) + 1)
            )
        assert found >= 0.9 * accepted and (k or accepted)


def test_short_items_stand_word_for_word(spark):
    docs = [(1, "so a b c it is"), (2, "one two three four five six seven"), (3, "one two three FOUR five six"), (4, "a b"), (5, None)]
    items = [(10, "a b c"), (11, "one two three four five six seven"), (12, "a b"), (13, "is")]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got.collect()) == [(1, 10, 3), (2, 11, 7)]


CLASHES = ("size", "taken", "target", "_id", "_tid", "_kept_id", "_bad_id", "tid", "kept_id", "bad_id", "hash", "src", "_0", "a.b")


def test_columns_of_any_name_come_through(spark):
    from lumenprep.llm import mixing

    rows = [(i, "a text of several words that stands here " * (1 + i % 3), "s", *range(len(CLASHES))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))
    items = spark.createDataFrame([(1, "no such words stand in any of them at all")], "item_id int, text string")
    for out in (mixing.mix_sources(docs), near_dup.keep_one(docs), decontaminate.drop_contaminated(docs, items)):
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        assert got and all(tuple(r)[3 : 3 + len(CLASHES)] == tuple(range(len(CLASHES))) for r in got)


def test_a_large_group_and_half_similar_outsiders(spark):
    """A third of the texts are near copies of one; others share half of it, some of those are near copies of each other."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(120)] = word()
        rows.append((i, " ".join(text)))
    for i in range(100, 140):
        cut = rng.randrange(60, 100)
        rows.append((i, " ".join(base[:cut] + [word() for _ in range(120 - cut)])))
    for i in range(200, 220):
        rows.append((i, rows[60 + i % 20][1] + f" {word()}"))
    rows += [(300, rows[0][1])] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = near_dup.near_copies(docs, bands=60, band_rows=1).select("doc_id", "class_id").collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == classes(rows)
