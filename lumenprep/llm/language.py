"""Language of documents, by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions and gives language probabilities for every
byte; the mean over all bytes of the text is the document's. It is trained in numpy on the driver by
backpropagation through time, on at most ``per_language`` documents of each language (chosen by hash) and three
short windows of each. Whole texts are labelled: each byte once, in windows that overlap so that the network
has read some bytes on either side of those it labels.

A text that is NULL or has no letter gets ``und`` and score 0, as does every text if nothing was learned.
Language, source and id are no inputs of a prediction. Repeated documents are labelled one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.quality import remainder
from lumenprep.llm.words import Block, blocks

HIDDEN = 8
CORE, CONTEXT = 112, 8
TRAIN_BYTES = 64
WINDOWS_AT_ONCE = 1024


class Direction:
    """One direction: a gated recurrent unit whose input weights are a table by byte."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.p = {
            "x": (0.3 * rng.standard_normal((256, 3 * hidden))).astype(np.float32),
            "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        }
        self.hidden = hidden

    def run(self, bytes_by_time: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte (time, window, hidden); ``keep`` gets what backpropagation needs."""
        n, k = self.hidden, 2 * self.hidden
        u_gates, u_new = np.ascontiguousarray(self.p["u"][:, :k]), np.ascontiguousarray(self.p["u"][:, k:])
        state = np.zeros((bytes_by_time.shape[1], n), dtype=np.float32)
        out = np.empty((*bytes_by_time.shape, n), dtype=np.float32)
        for t, column in enumerate(bytes_by_time):
            x = self.p["x"].take(column, axis=0)
            gates = state @ u_gates
            gates += x[:, :k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :n], gates[:, n:]
            through = state @ u_new
            new = reset * through
            new += x[:, k:]
            np.tanh(new, out=new)
            before = state
            state = out[t]
            np.subtract(before, new, out=state)
            state *= update
            state += new
            if keep is not None:
                keep.append((before, update, reset, through, new))
        return out

    def gradients(self, bytes_by_time: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        n, k = self.hidden, 2 * self.hidden
        du = np.zeros_like(self.p["u"])
        u_gates, u_new = self.p["u"][:, :k], self.p["u"][:, k:]
        steps, width = bytes_by_time.shape
        d_in = np.empty((steps, width, 3 * n), dtype=np.float32)
        d_state = np.zeros((width, n), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            before, update, reset, through, new = kept[t]
            d = d_state + d_out[t]
            d_new = d * (1 - update) * (1 - new**2)
            d_gates = np.concatenate([d * (before - new) * update * (1 - update), d_new * through * reset * (1 - reset)], axis=1)
            d_through = d_new * reset
            du[:, :k] += before.T @ d_gates
            du[:, k:] += before.T @ d_through
            d_state = d * update + d_gates @ u_gates.T + d_through @ u_new.T
            d_in[t, :, :k], d_in[t, :, k:] = d_gates, d_new
        one_hot = np.zeros((steps * width, 256), dtype=np.float32)
        one_hot[np.arange(steps * width), bytes_by_time.ravel()] = 1
        return {"x": one_hot.T @ d_in.reshape(-1, 3 * n), "u": du}


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


class ByteNetwork:
    """Both directions and the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.head = {
            "w": (rng.standard_normal((2 * hidden, len(languages))) / np.sqrt(2 * hidden)).astype(np.float32),
            "b": np.zeros(len(languages), np.float32),
        }

    def states(self, windows: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """States of both directions at every byte (time, window, 2 x hidden) of ``windows`` (time, window)."""
        ahead = self.forward.run(windows, keep and keep[0])
        back = self.backward.run(windows[::-1], keep and keep[1])[::-1]
        return np.concatenate([ahead, back], axis=2)

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 240, batch: int = 128, rate: float = 0.02, seed: int = 3) -> None:
        """Adam on the cross-entropy of every byte; ``windows`` is (window, byte)."""
        rng = np.random.default_rng(seed)
        parts = {"f": self.forward.p, "b": self.backward.p, "h": self.head}
        m = {(a, k): np.zeros_like(v) for a, p in parts.items() for k, v in p.items()}
        q = {key: np.zeros_like(v) for key, v in m.items()}
        for i in range(1, steps + 1):
            rows = rng.integers(0, len(windows), min(batch, len(windows)))
            x = np.ascontiguousarray(windows[rows].T)
            kept: tuple[list, list] = ([], [])
            s = self.states(x, kept)
            prob = softmax(s @ self.head["w"] + self.head["b"])
            prob[:, np.arange(len(rows)), labels[rows]] -= 1
            prob /= x.size
            flat = s.reshape(-1, s.shape[2])
            grads = {"h": {"w": flat.T @ prob.reshape(-1, prob.shape[2]), "b": prob.sum((0, 1))}}
            ds = prob @ self.head["w"].T
            n = self.forward.hidden
            grads["f"] = self.forward.gradients(x, kept[0], ds[:, :, :n])
            grads["b"] = self.backward.gradients(x[::-1], kept[1], ds[::-1, :, n:])
            for (a, k), moment in m.items():
                g = np.clip(grads[a][k], -1, 1)
                moment += 0.1 * (g - moment)
                q[a, k] += 0.01 * (g * g - q[a, k])
                step = rate * (moment / (1 - 0.9**i)) / (np.sqrt(q[a, k] / (1 - 0.99**i)) + 1e-8)
                parts[a][k] -= step.astype(np.float32)

    def document_probabilities(self, block: Block) -> np.ndarray:
        """Mean over the bytes of each text of the probabilities at that byte; zeros for an empty text."""
        sizes = np.diff(block.offsets)
        per_text = -(-sizes // CORE)
        text_of = np.repeat(np.arange(len(sizes)), per_text)
        first = np.concatenate([[0], np.cumsum(per_text)])
        core = block.offsets[text_of] + (np.arange(first[-1]) - first[text_of]) * CORE
        total = np.zeros((len(sizes), len(self.languages)))
        span = np.arange(-CONTEXT, CORE + CONTEXT)[:, None]
        for i in range(0, len(core), WINDOWS_AT_ONCE):
            at, text = core[i : i + WINDOWS_AT_ONCE], text_of[i : i + WINDOWS_AT_ONCE]
            place = at[None, :] + span
            inside = (place >= block.offsets[text]) & (place < block.offsets[text + 1])
            x = np.where(inside, block.data[np.clip(place, 0, len(block.data) - 1)], 0)
            s = self.states(x)[CONTEXT : CONTEXT + CORE]
            prob = softmax(s @ self.head["w"] + self.head["b"])
            prob *= inside[CONTEXT : CONTEXT + CORE, :, None]
            np.add.at(total, text, prob.sum(axis=0))
        return total / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, per_language: int, modulus: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows of bytes and their labels, from documents with a language and a letter."""
    known = docs.where(
        F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != 0) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_hash")
    # The rank's limit is applied before the shuffle as well, so no language gathers in a task.
    chosen = (
        known.select("lang", "doc_id", F.xxhash64("text").alias("_hash"), *[F.substr("text", 1 + F.floor(F.length("text") * f).cast("int"), F.lit(TRAIN_BYTES)).alias(f"w{i}") for i, f in enumerate((0.0, 0.35, 0.7))])
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_language)
        .orderBy("lang", "_rank")
        .toArrow()
    )
    languages = sorted(set(chosen.column("lang").to_pylist()))
    code = {x: i for i, x in enumerate(languages)}
    windows, labels = [], []
    for lang, *texts in zip(*[chosen.column(c).to_pylist() for c in ("lang", "w0", "w1", "w2")], strict=True):
        for text in texts:
            data = text.encode()[:TRAIN_BYTES]
            if data:
                windows.append(np.frombuffer(data.ljust(TRAIN_BYTES, b"\0"), np.uint8))
                labels.append(code[lang])
    return languages, np.array(windows, np.uint8).reshape(-1, TRAIN_BYTES), np.array(labels, np.int64)


def fit_language(docs: DataFrame, per_language: int = 400, modulus: int = 5) -> ByteNetwork | None:
    """Network from the documents whose crc32(doc_id) mod ``modulus`` is not 0; None without any."""
    languages, windows, labels = training_windows(docs, per_language, modulus)
    if not len(windows):
        return None
    network = ByteNetwork(languages)
    network.train(windows, labels)
    return network


def label_language(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score; columns of those names are replaced."""
    new = ("lang_pred", "lang_score")
    rows = docs.drop(*new)
    letters = "_has_letter"
    marked = rows.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            kept = [c for c in block.rows.schema.names if c != letters]
            usable = block.rows.column(letters).to_numpy(zero_copy_only=False)
            names, score = np.full(len(usable), "und", dtype=object), np.zeros(len(usable))
            if network is not None and usable.any():
                prob = network.document_probabilities(block)
                best = prob.argmax(axis=1)
                names[usable] = np.array(network.languages, dtype=object)[best[usable]]
                score[usable] = np.clip(prob.max(axis=1)[usable], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*[block.rows.column(c) for c in kept], pa.array(names, pa.string()), pa.array(score)], names=[*kept, *new]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])
    return marked.mapInArrow(run, schema)
