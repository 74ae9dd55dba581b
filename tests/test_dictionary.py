"""Dense ids: a number for each word, whatever their hashes."""

from __future__ import annotations

import hashlib
import re

from collections import Counter
from itertools import count

import pytest

from pyspark.sql import functions as F

from lumenprep.functions.template import word_id
from lumenprep.operators import dictionary

WORD = re.compile(r"[^ \t\r\n]+")


def colliding():
    """Two words whose 28-bit ids are equal."""
    seen = {}
    for i in count():
        word = f"w{i}"
        key = hashlib.md5(word.encode()).hexdigest()[:7]
        if key in seen:
            return seen[key], word
        seen[key] = word


@pytest.fixture(scope="module")
def texts():
    a, b = colliding()
    return [f"{a} {b}  {a}\tthe the the", None, "", " \n", f"the {b} é x", *[f"the of word{i} word{i // 2}" for i in range(300)]], (a, b)


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts[0])), "k bigint, text string").repartition(7)


def numbered(texts, least=1):
    n = Counter(w for t in texts for w in WORD.findall(t or ""))
    order = sorted((w for w in n if n[w] >= least), key=lambda w: (-n[w], w.encode()))
    return {w: (i + 3, n[w]) for i, w in enumerate(order)}


@pytest.mark.parametrize("least", [1, 2])
def test_ids_are_dense_and_frequent_words_first(spark, texts, rows, least):
    built = dictionary.build_dictionary(rows, ["text"], min_count=least).collect()
    assert {r.token: (r.id, r.n) for r in built} == numbered(texts[0], least)
    assert sorted(r.id for r in built) == list(range(3, 3 + len(built)))


def test_words_that_hashes_confuse(spark, texts, rows):
    a, b = texts[1]
    same = spark.createDataFrame([(a,), (b,)], "w string").select(word_id(F.col("w")).alias("id")).collect()
    assert same[0] == same[1]
    ids = {r.token: r.id for r in dictionary.build_dictionary(rows, ["text"]).collect()}
    assert ids[a] != ids[b]


@pytest.mark.parametrize("hot, step", [(dictionary.HOT_BYTES, 4096), (0, 4096), (900, 16)])
@pytest.mark.parametrize("limit", [0, 200_000])
def test_round_trip(spark, texts, rows, monkeypatch, hot, step, limit):
    """All words in the tasks, none, or the frequent ones; the rest by a broadcast or a salted join."""
    monkeypatch.setattr(dictionary, "_STEP", step)
    built = dictionary.build_dictionary(rows, ["text"])
    if step == 16:
        near, rest = dictionary.hot_words(built, hot)
        assert near.count() and rest.count()
    coded = dictionary.encode(rows, "k", {"text": "ids"}, built, hot_bytes=hot, broadcast_rows=limit)
    ids = {w: i for w, (i, _) in numbered(texts[0]).items()}
    got = {r.k: r.ids for r in coded.collect()}
    assert got == {k: None if t is None else [ids[w] for w in WORD.findall(t)] for k, t in enumerate(texts[0])}
    back = {r.k: r.words for r in dictionary.decode(coded.select("k", "ids"), "k", "ids", built, col="words").collect()}
    assert back == {k: None if t is None else " ".join(WORD.findall(t)) for k, t in enumerate(texts[0])}


@pytest.mark.parametrize("hot", [dictionary.HOT_BYTES, 0])
def test_unknown_words(spark, texts, rows, hot):
    known = dictionary.build_dictionary(rows, ["text"], min_count=3)
    ids = {w: i for w, (i, _) in numbered(texts[0], 3).items()}
    other = spark.createDataFrame([(1, "the strange the"), (2, "strange " * 500), (3, None)], "k int, text string")
    got = {r.k: r.ids for r in dictionary.encode(other, "k", {"text": "ids"}, known, hot_bytes=hot).collect()}
    assert got == {1: [ids["the"], 1, ids["the"]], 2: [1] * 500, 3: None}


def test_empty(spark, rows):
    none = dictionary.build_dictionary(rows.limit(0), ["text"])
    assert none.collect() == []
    got = dictionary.encode(rows.where("k = 4"), "k", {"text": "ids"}, none).first()
    assert got.ids == [1, 1, 1]


def test_tokenizer_is_for_dictionaries_that_fit(spark, texts, rows):
    built = dictionary.build_dictionary(rows, ["text"])
    ids = {w: i for w, (i, _) in numbered(texts[0]).items()}
    got = {r.k: r.ids for r in rows.select("k", dictionary.tokenizer(built)(F.col("text")).alias("ids")).collect()}
    assert got[0] == [ids[w] for w in WORD.findall(texts[0][0])] and got[1] is None
    with pytest.raises(ValueError, match="use encode"):
        dictionary.tokenizer(built, hot_bytes=10)


def test_repeated_keys_are_refused_where_they_matter(spark, rows):
    built = dictionary.build_dictionary(rows, ["text"])
    with pytest.raises(ValueError, match="rows to encode"):
        dictionary.encode(rows.union(rows), "k", {"text": "ids"}, built, hot_bytes=0)


@pytest.mark.parametrize("hot, limit", [(0, 0), (0, 200_000), (900, 0)])
def test_blocks_of_few_items_and_two_columns(spark, texts, rows, monkeypatch, hot, limit):
    """Codes start anew in each block, and columns of a row share them."""
    monkeypatch.setattr(dictionary, "_STEP", 16)
    built = dictionary.build_dictionary(rows, ["text"], min_count=2)
    ids = {w: i for w, (i, _) in numbered(texts[0], 2).items()}
    two = rows.withColumn("back", F.reverse("text")).withColumn("other", F.lit("x"))
    coded = dictionary.encode(two, "k", {"text": "ids", "back": "back_ids"}, built, hot_bytes=hot, broadcast_rows=limit, block_items=5)
    of = lambda t: None if t is None else [ids.get(w, 1) for w in WORD.findall(t)]
    got = {r.k: (r.ids, r.back_ids, r.other) for r in coded.collect()}
    assert got == {k: (of(t), of(t and t[::-1]), "x") for k, t in enumerate(texts[0])}
    whole = dictionary.build_dictionary(rows, ["text"])
    long = dictionary.encode(rows, "k", {"text": "ids"}, whole, hot_bytes=hot, block_items=7, whole=False)
    assert long.columns == ["k", "ids"]
    back = dictionary.decode(long, "k", "ids", whole, broadcast_bytes=0, block_items=5).collect()
    assert {r.k: r.text for r in back} == {k: None if t is None else " ".join(WORD.findall(t)) for k, t in enumerate(texts[0])}


def test_words_meet_the_rest_once_a_block(spark, rows):
    """Nothing has a row for each place of a word (the join had one), and the salted side was broadcast, which driver memory did not hold."""
    from lumenprep.operators.blocks import code_blocks
    from lumenprep.operators.staging import join_staged, stage

    many = spark.range(20, numPartitions=1).select(F.col("id").alias("k"), F.split(F.repeat(F.lit("a b "), 500), " ").alias("w"))
    coded = code_blocks(many, "k", ["w"], "string", dictionary._coder(spark.sparkContext.broadcast({})), 1 << 20)
    assert sorted(r._item for r in coded.where("_code IS NOT NULL").collect()) == ["", "a", "b"]
    small = stage(spark.range(10).withColumn("v", F.col("id")), "small")
    joined = join_staged(spark.range(100).withColumn("s", F.col("id")), small, ["id"], "s", broadcast_rows=0)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_conversations_with_a_dictionary_that_tasks_cannot_hold(spark, sf_dir, monkeypatch):
    """The query raised as soon as the words had more bytes than the tasks take."""
    from functools import partial

    from registry.queries import REGISTRY

    def digest():
        return sorted((r.conv_id, r.text) for r in REGISTRY["decode_conversations"](spark, sf_dir).collect())

    small = digest()
    for name in ("encode", "tokenizer"):
        monkeypatch.setattr(dictionary, name, partial(getattr(dictionary, name), hot_bytes=100, **({"broadcast_rows": 0} if name == "encode" else {})))
    monkeypatch.setattr(dictionary, "decode", partial(dictionary.decode, broadcast_bytes=0))
    monkeypatch.setattr(dictionary, "_STEP", 16)
    assert digest() == small
