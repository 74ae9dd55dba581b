"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of 64 words. Each passage is encoded by a small network from counts of its
bytes and words; gated attention weighs the encoded passages, and their weighted sum gives the score. Only
documents have labels; the attention is learned from them.

The network is fitted in numpy on the driver, on at most ``max_documents`` labelled documents (chosen by hash)
and ``max_passages`` passages of each. Scoring reads every passage of every document, and holds a block of texts
at a time; a passage is described by 20 numbers.

Empty and NULL texts are one empty passage and get a score like any other. Where no labels are given the score
is 0.5. Documents with several labels count once, with the majority (ties: 1). Labels of unknown documents and
NULL labels are ignored. Repeated documents are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.words import Block, PrefixHash, blocks, mix64

PASSAGE_WORDS = 64
HIDDEN = 16
ATTENTION = 8

# Classes of bytes: lower, upper, digit, space, line end, bar, stop and comma, other ASCII, beyond ASCII.
_CLASS = np.full(256, 8, dtype=np.int64)
_CLASS[:128] = 7
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[124] = 5
_CLASS[[44, 46]] = 6
CLASSES = 9
FEATURES = CLASSES + 11


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def passage_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and the first passage of each text."""
    starts, ends, first = block.words()
    counts = np.diff(first)
    per_text = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first_passage = np.concatenate([[0], np.cumsum(per_text)])
    total = int(first_passage[-1])
    text_of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - first[text_of]
    passage = first_passage[text_of] + place // PASSAGE_WORDS
    # A passage begins at its first word, the first passage of a text with the text.
    begin = np.repeat(block.offsets[:-1], per_text)
    opening = place % PASSAGE_WORDS == 0
    later = opening & (place > 0)
    begin[passage[later]] = starts[later]
    size = np.diff(np.append(begin, len(block.data)))
    passage_of_byte = np.repeat(np.arange(total), size)
    by_class = np.bincount(passage_of_byte * CLASSES + _CLASS[block.data], minlength=total * CLASSES)
    by_class = by_class.reshape(total, CLASSES).astype(np.float64)
    hashes = PrefixHash(block.data).ranges(starts, ends)
    length = (ends - starts).astype(np.float64)
    n = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(n, 1)
    mean = np.bincount(passage, length, minlength=total) / some
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length**2, minlength=total) / some - mean**2))

    def firsts(group: np.ndarray) -> np.ndarray:
        """Words of each passage that are the first of their kind in their ``group``."""
        keys = mix64(hashes ^ mix64(group.astype(np.uint64)))
        return np.bincount(passage[np.unique(keys, return_index=True)[1]], minlength=total) / some

    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    capital = _CLASS[block.data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    odd_end = np.isin(_CLASS[block.data[ends - 1]], (5, 7)) if len(ends) else np.zeros(0, bool)
    share = lambda flags: np.bincount(passage[flags], minlength=total) / some
    out = np.column_stack(
        [
            by_class / np.maximum(size, 1)[:, None],
            np.log1p(n),
            mean,
            spread,
            firsts(passage),
            firsts(text_of),
            share(again),
            share(capital),
            share(odd_end),
            share(length <= 2),
            share(length >= 12),
            n == 0,
        ]
    )
    return out.astype(np.float32), first_passage


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class AttentionModel:
    """Encoder, gated attention and classifier over bags of passages."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "w1": normal(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "v": normal(HIDDEN, ATTENTION), "u": normal(HIDDEN, ATTENTION), "a": normal(ATTENTION, 1),
            "w2": normal(HIDDEN, 1), "b2": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = np.exp((t * g) @ p["a"])[:, 0]  # bounded: the gate and the tanh are
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = (e / np.add.reduceat(e, first[:-1])[bag])[:, None]
        z = np.add.reduceat(weight * h, first[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "bag": bag, "weight": weight, "z": z, "y": _sigmoid(z @ p["w2"] + p["b2"])[:, 0]}

    def gradients(self, s: dict[str, np.ndarray], first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, out = self.p, {}
        dy = ((s["y"] - labels) / len(labels))[:, None].astype(np.float32)
        out["w2"], out["b2"] = s["z"].T @ dy, dy.sum(0)
        dz = (dy @ p["w2"].T)[s["bag"]]
        dweight = (dz * s["h"]).sum(1, keepdims=True)
        mean = np.add.reduceat(s["weight"] * dweight, first[:-1])[s["bag"]]
        ds = s["weight"] * (dweight - mean)
        tg = s["t"] * s["g"]
        out["a"] = tg.T @ ds
        dtg = ds @ p["a"].T
        dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
        out["v"], out["u"] = s["h"].T @ dt, s["h"].T @ dg
        dh = (s["weight"] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - s["h"] ** 2)
        out["w1"], out["b1"] = s["x"].T @ dh, dh.sum(0)
        return out

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            grads = self.gradients(self.forward(x, first), first, labels)
            for k, g in grads.items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.99 * q[k] + 0.01 * g * g
                step = rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(q[k] / (1 - 0.99**i)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(np.float32)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"].astype(np.float64)


def training_bags(docs: DataFrame, labels: DataFrame, max_documents: int, max_passages: int, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, first passages and labels of at most ``max_documents`` labelled documents."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_quality"))
    chosen = (
        known.where(F.col("_quality").isNotNull() & F.col("_id").isNotNull() & (remainder(F.col("_id"), modulus) != 0))
        .groupBy("_id")
        .agg((F.avg("_quality") >= 0.5).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_documents)
    )
    # At most max_documents rows of two numbers.
    picked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "_label", F.xxhash64("text").alias("_hash"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x, first = passage_features(block)
            lists = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                spread = np.unique(np.linspace(a, b - 1, min(b - a, max_passages)).astype(np.int64))
                lists.append(x[spread].ravel())
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("_id"), block.rows.column("_hash"), block.rows.column("_label"), pa.array(lists, pa.list_(pa.float32()))],
                names=["_id", "_hash", "_label", "x"],
            )

    schema = T.StructType([picked.schema["_id"], picked.schema["_hash"], picked.schema["_label"], T.StructField("x", T.ArrayType(T.FloatType()))])
    # Repeated ids could exceed the bound, so it holds for the bags again.
    bags = picked.mapInArrow(run, schema).orderBy(F.xxhash64("_id"), "_id", "_hash").limit(max_documents).toArrow()
    if not bags.num_rows:
        return np.zeros((0, FEATURES), np.float32), np.zeros(1, np.int64), np.zeros(0)
    lists = bags.column("x").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) // FEATURES
    x = lists.flatten().to_numpy().reshape(-1, FEATURES)
    return x, np.concatenate([[0], np.cumsum(sizes)]), bags.column("_label").to_numpy()


def fit_quality(docs: DataFrame, labels: DataFrame, max_documents: int = 3000, max_passages: int = 32, modulus: int = 5) -> AttentionModel | None:
    """Model from the labels of documents whose crc32(doc_id) mod ``modulus`` is not 0; None without any."""
    x, first, y = training_bags(docs, labels, max_documents, max_passages, modulus)
    if not len(y):
        return None
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3)
    model.fit(x, first, y)
    return model


def score_quality(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a score (0 to 1) in column ``out``, which replaces one of that name."""
    rows = docs.drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            y = np.full(block.rows.num_rows, 0.5) if model is None else model.score(*passage_features(block))
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(y)], names=[*block.rows.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))
