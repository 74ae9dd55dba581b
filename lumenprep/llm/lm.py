"""Log probability of documents under a causal self-attention model on subword ids, joined with corpus word counts.

A word (A-Z lower-cased, a space before it) is cut into subwords by a public byte-level tokenizer; a document ends with
an end token. A self-attention layer reads up to a window of ids and gives a weight to each of some experts, which are
distributions over subwords. Windows overlap by ``CONTEXT`` subwords that are only read, so
every subword is scored once, with masked attention over what stands before it. Experts begin a word or continue one, so
the model also gives the probability that a word is over, and with it a distribution over whole words. One of the experts
is the corpus' own: how often a subword follows another inside the words of all training documents.

The model's word is its first subword, chosen by attention, and what follows: with weight ``completion`` as often as the
word stands among the corpus' words that begin so, else by the experts. The word's probability is the mean, weighted by
``share``, of that and of the word's frequency in all training documents.
Word counts cover the whole corpus and stay in Spark: the most frequent words (at most ``frequent_words``) go to every
task, the counts of all others meet the words of the documents in a join. Both ways give the same sum. Pairs of subwords
are counted over the whole corpus as well; the most frequent ``frequent_pairs`` go to every task, and if there are more,
a join gives every document the counts of its others.

The other experts are topics times places in a word (first subword, second, later). All that is learned is counted on all
training documents, nothing on a sample: which kinds of subwords stand together in stretches of text (a matrix of fixed
size, whose groups the topics start from), then in ``ROUNDS`` passes how often each subword stands in windows of each topic, a
window under its likeliest topic of the round before. These counts are the experts. A subword's vector is counted as well: how its
topics differ from the corpus', how much that tells, and how often a word goes on after it. The attention layer over these
vectors starts from weights that follow from the counts and is then fitted by gradient, every place of every training
document once: each task takes steps on its documents from the same start, and the layers of all tasks are averaged.
NULL texts are empty and consist of the end token. A NULL id is held out. Without training documents the score is the base score.
Repeated documents are scored one by one.
"""

from __future__ import annotations

import base64

from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.quality import remainder
from lumenprep.llm.words import Block, PrefixHash, blocks, mix64
from lumenprep.operators.staging import small_batches, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r" ?\p{L}{1,24}| ?\p{N}{1,3}| ?[^\p{L}\p{N}]{1,8}"
WIDTH, CONTEXT = 32, 16
DIM, INNER, TOPICS = 16, 32, 8
LOT = 128  # windows at a time
END_HASH = np.uint64(0x45E4D1A0C0FFEE11)
COUNT_ROWS = 400_000
BATCH_BYTES, BATCH_ROWS = 3 << 18, 1 << 16  # of an Arrow batch to a task (one block), and from it
KINDS, STRETCH, ROUNDS = 256, 128, 3  # kinds of subwords by hash, subwords of a stretch in which they stand together
CELL = 1e6  # shares of kinds are added up as whole millionths, in any order
EVIDENCE, SALIENCE, HELD, WITHIN = 3.0, 0.1, 0.7, 0.8  # where fitting starts: attention; how far sure topics are held below pairs; share of pairs in words
KEYS = 8  # size of queries and keys
STEP, RATE, SLOWING, MEMORY = 128, 0.01, 64, (0.8, 0.95)  # windows of a step; Adam's rate, steps until it falls, what it remembers
SHARE, COMPLETION = 0.05, 0.9
FLOOR = 1e-3  # every expert has a thousandth, shared evenly, when documents are scored
BOUND = 30.0  # of attention scores and of the logits of experts
PAIR_BITS = 20  # a pair of subwords is one number, the first in the high bits
ALNUM = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)
MEMBERS = 3 * TOPICS  # experts that count subwords; subword and expert are one number as well


# -- subwords ---------------------------------------------------------------------------------------------------------


class Subwords:
    """Subword ids of words, encoded once per distinct word and process."""

    limit = 300_000
    loaded: dict[str, Subwords] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.opens[self.end] = True
        self.forget()

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``starts`` one after the other, and how many each has.

        Words are cut as one text, in which no piece reaches beyond a letter or digit that ends a word. A word that ends in
        another sign gets a letter, a piece of its own, which is taken off again; one whose end is not ASCII is cut alone.
        """
        last = data[ends - 1]
        closed = np.isin(last, ALNUM)
        sizes = ends - starts
        at = np.concatenate([[0], np.cumsum(sizes + 1 + ~closed)])
        text = np.full(at[-1], ord("a"), np.uint8)
        text[at[:-1]] = ord(" ")
        text[ragged(at[:-1] + 1, sizes)] = data[ragged(starts, sizes)]
        whole = last < 128
        inside = np.repeat(whole, np.diff(at))
        found = self.encoding.encode_ordinary
        ids = np.array(found(text[inside].tobytes().lower().decode("utf-8", "replace")), np.int32)
        begins = np.flatnonzero(self.opens[ids])
        counts = np.diff(np.append(begins, len(ids))) - ~closed[whole]
        ids, out = ids[ragged(begins, counts)], np.zeros(len(sizes), np.int64)
        out[whole] = counts
        alone = np.flatnonzero(~whole)
        if not len(alone):
            return ids, out
        cut = [found(" " + data[starts[i] : ends[i]].tobytes().lower().decode("utf-8", "replace")) for i in alone]
        out[alone] = [len(x) for x in cut]
        flat = np.empty(int(out.sum()), np.int32)
        first = np.cumsum(out) - out
        flat[ragged(first[whole], out[whole])] = ids
        flat[ragged(first[alone], out[alone])] = [i for x in cut for i in x]
        return flat, out

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, sizes = self.encoded(data, starts, ends)
        first = len(self.ids) + np.cumsum(sizes) - sizes
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")  # both are sorted
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]
        self.ids = np.concatenate([self.ids, ids])

    def of_words(self, data: np.ndarray, distinct: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids, in ``self.ids``, of words whose hashes are sorted and distinct."""
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + new.sum() > self.limit:
                self.forget()
                new[:] = True
            self.learn(distinct[new], data, starts[new], ends[new])
            place = np.searchsorted(self.known, distinct)
        return self.first[place], self.sizes[place]

    def of_block(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a block in order, and how many each word has."""
        return self.of_distinct(data, np.unique(hashes, return_index=True, return_inverse=True), starts, ends)

    def of_distinct(self, data: np.ndarray, found: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, at, which = found
        first, sizes = self.of_words(data, distinct, starts[at], ends[at])
        return self.ids[ragged(first[which], sizes[which])], sizes[which]


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i] + 1, ... of ``sizes[i]`` each, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - sizes), sizes)


@dataclass
class Tokens:
    """Words of a block with their ends of document, and their subwords."""

    distinct: np.ndarray  # hashes of the distinct words, and END_HASH for an end
    at: np.ndarray  # one place of each
    which: np.ndarray  # distinct word of each word
    document: np.ndarray  # of each word
    first: np.ndarray  # first word of each document, and the number of words
    ids: np.ndarray  # subwords
    sizes: np.ndarray  # subwords of each word

    @property
    def hashes(self) -> np.ndarray:
        return self.distinct[self.which]

    def inner(self, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Places of the subwords that continue ``words``."""
        return ragged((np.cumsum(self.sizes) - self.sizes)[words] + 1, self.sizes[words] - 1)


def tokens_of(block: Block, subwords: Subwords) -> Tokens:
    starts, ends, first = block.words()
    hashes = PrefixHash(block.data, lower=True).ranges(starts, ends)
    distinct, at, which = found = np.unique(hashes, return_index=True, return_inverse=True)
    ids, sizes = subwords.of_distinct(block.data, found, starts, ends)
    n = len(first) - 1
    ends_at = first[1:]
    document = np.repeat(np.arange(n), np.diff(first))
    before = np.concatenate([[0], np.cumsum(sizes)])[ends_at]
    return Tokens(
        np.append(distinct, END_HASH),
        np.append(at + document[at], ends_at[0]),
        np.insert(which, ends_at, len(distinct)),
        np.insert(document, ends_at, np.arange(n)),
        first + np.arange(n + 1),
        np.insert(ids, before, subwords.end),
        np.insert(sizes, ends_at, 1),
    )


def window_places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window its document and first scored subword, from the first subword of each document (and their number)."""
    per_document = -(-np.diff(bounds) // WIDTH)
    document = np.repeat(np.arange(len(per_document)), per_document)
    opening = np.concatenate([[0], np.cumsum(per_document)])
    return document, bounds[document] + (np.arange(opening[-1]) - opening[document]) * WIDTH


def window_starts(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First subword of each document (and their number), and of each window its document and first scored subword."""
    bounds = np.concatenate([[0], np.cumsum(tokens.sizes)])[tokens.first]
    return bounds, *window_places(bounds)


# -- model ------------------------------------------------------------------------------------------------------------


def raised(x: np.ndarray) -> np.ndarray:
    """exp of ``x`` in place, held within ``BOUND`` so that sums need no search for the largest."""
    np.clip(x, -BOUND, BOUND, out=x)
    return np.exp(x, out=x)


class Pairs:
    """How often a subword follows another inside a word: a distribution for each first subword."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, opens: np.ndarray, weight: float = 20.0, after: np.ndarray | None = None, into: np.ndarray | None = None):
        """``after`` and ``into`` are the counts of each first and second subword, if ``keys`` (sorted) are not all pairs."""
        low = (1 << PAIR_BITS) - 1
        first, second = (keys >> np.uint64(PAIR_BITS)).astype(np.int64), (keys & np.uint64(low)).astype(np.int64)
        self.tables, self.weight = [(keys, counts.astype(np.float64))], weight
        self.after = np.bincount(first, counts, minlength=len(opens)) if after is None else after
        base = np.where(opens, 0.0, (np.bincount(second, counts, minlength=len(opens)) if into is None else into) + 0.01)
        self.base = base / base.sum()

    def more(self, keys: np.ndarray, counts: np.ndarray) -> Pairs:
        """These and other pairs, whose keys may be repeated."""
        keys, at = np.unique(keys, return_index=True)
        out = copy(self)
        out.tables = [*self.tables, (keys, counts[at].astype(np.float64))]
        return out

    def chance(self, first: np.ndarray, second: np.ndarray, seen: int = 0) -> np.ndarray:
        """Probability of ``second`` after ``first``, as if the corpus had ``seen`` of that pair less."""
        key = (first.astype(np.uint64) << np.uint64(PAIR_BITS)) | second.astype(np.uint64)
        count = np.zeros(key.shape)
        for keys, counts in self.tables:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                count = np.where(keys[place] == key, counts[place], count)
        count -= np.minimum(count, seen)
        return (count + self.weight * self.base[second]) / (np.maximum(self.after[first] - seen, 0) + self.weight)


@dataclass
class AttentionModel:
    """One causal self-attention layer that weighs experts; ``experts`` is (subword, expert), the last are ``pairs``."""

    end: int
    opens: np.ndarray  # of each expert: whether its subwords begin a word
    p: dict[str, np.ndarray] = field(default_factory=dict)
    experts: np.ndarray | None = None
    evenly: np.ndarray | None = None  # sum over the experts
    pairs: Pairs | None = None
    single: np.ndarray | None = None  # of each expert, what one count adds to a chance

    def chances(self, before: np.ndarray, subword: np.ndarray) -> np.ndarray:
        """Probability of ``subword`` after ``before`` by every expert."""
        out = self.experts[subword]
        inner = self.pairs.base[subword] > 0
        out[inner, -1] = self.pairs.chance(before[inner], subword[inner])
        return out

    @staticmethod
    def start(vocabulary: int, end: int, opens: np.ndarray, seed: int = 5) -> AttentionModel:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        s = DIM**-0.5
        p = {
            "e": normal(0.3, vocabulary, DIM), "pos": normal(0.1, CONTEXT + WIDTH, DIM),
            "q": normal(s, DIM, DIM), "k": normal(s, DIM, DIM), "v": normal(s, DIM, DIM), "o": normal(s, DIM, DIM),
            "w1": normal(s, DIM, INNER), "b1": np.zeros(INNER, np.float32), "w2": normal(INNER**-0.5, INNER, DIM),
            "g": normal(s, DIM, len(opens)), "c": np.zeros(len(opens), np.float32),
        }
        return AttentionModel(end, opens, p)

    def gates(self, ids: np.ndarray, real: np.ndarray, scored: int, keep: dict | None = None) -> np.ndarray:
        """Weights of the experts for the next subword, at the last ``scored`` places of each window.

        ``ids`` (window, place) are subwords read, ``real`` whether a place holds one.
        """
        p = self.p
        n, length = ids.shape
        # scores are made of products of one window each, as their last digits may depend on their size
        times = (lambda z, w: z @ w) if keep is None else (lambda z, w: (z.reshape(-1, z.shape[-1]) @ w).reshape(*z.shape[:-1], -1))
        x = p["e"].take(ids, axis=0)
        x += p["pos"][-length:]
        late = np.ascontiguousarray(x[:, length - scored :])
        size, none = p["k"].shape[1], np.zeros((DIM, 1), x.dtype)
        q = times(late, np.concatenate([p["q"] * x.dtype.type(DIM**-0.5), none], axis=1))
        kv = times(x, np.concatenate([p["k"], none, p["v"], none], axis=1))
        q[..., size], kv[..., size], kv[..., -1] = 1, np.where(real, 0, -1e4), 1  # other places weigh nothing; the last adds weights up
        k, v = kv[..., : size + 1], kv[..., size + 1 :]
        scores = q @ k.transpose(0, 2, 1)
        free = free_logits = None
        if np.prod([np.einsum("ijk,ijk->ij", z[..., :size], z[..., :size]).max(initial=0) for z in (q, k)]) < BOUND**2:
            a = np.exp(scores, out=scores)
        else:
            free = np.abs(scores) < BOUND
            a = raised(scores)
            a *= real[:, None, :]
        a *= (np.arange(length)[None, :] <= np.arange(length - scored, length)[:, None]).astype(a.dtype)
        read = a @ v
        total = read[..., -1:] + x.dtype.type(1e-37)
        read = read[..., :-1] / total
        y = late + times(read, p["o"])
        inner = times(y, p["w1"])
        inner += p["b1"]
        np.maximum(inner, 0, out=inner)
        h = times(inner, p["w2"])
        h += y
        logits = times(h, p["g"])
        logits += p["c"]
        if keep is not None and np.abs(logits).max(initial=0) >= BOUND:
            free_logits = np.abs(logits) < BOUND
        g = raised(logits)
        g /= (g @ np.ones(g.shape[-1], g.dtype))[..., None]
        if keep is not None:
            keep.update(x=x, late=late, q=q, k=k, v=v, a=a, total=total, read=read, y=y, inner=inner, h=h, free=free, free_logits=free_logits)
        return g

    def gradients(self, s: dict, ids: np.ndarray, dlogits: np.ndarray, vectors: bool = True) -> dict[str, np.ndarray]:
        """Of all weights from what ``gates`` kept; of the subwords' ``vectors`` (subwords, gradients) if asked for."""
        p, size = self.p, self.p["k"].shape[1]
        length = ids.shape[1]
        flat = lambda z: z.reshape(-1, z.shape[-1])
        h, y, inner, read, late = (flat(s[name]) for name in ("h", "y", "inner", "read", "late"))
        dlogits = flat(dlogits if s["free_logits"] is None else dlogits * s["free_logits"])
        ones = np.ones(len(h), h.dtype)
        d = {"g": h.T @ dlogits, "c": ones @ dlogits}
        dh = dlogits @ p["g"].T
        d["w2"] = inner.T @ dh
        dinner = dh @ p["w2"].T
        dinner *= inner > 0
        d["w1"], d["b1"] = y.T @ dinner, ones @ dinner
        dy = dh + dinner @ p["w1"].T
        d["o"] = read.T @ dy
        dread = dy @ p["o"].T
        dread = np.concatenate([dread, -np.einsum("ij,ij->i", dread, read)[:, None]], axis=1).reshape(*s["read"].shape[:-1], -1) / s["total"]
        dv = (s["a"].transpose(0, 2, 1) @ dread)[..., :-1]
        dscores = dread @ s["v"].transpose(0, 2, 1)
        dscores *= s["a"]
        if s["free"] is not None:
            dscores *= s["free"]
        dq, dk = (dscores @ s["k"])[..., :size] * late.dtype.type(DIM**-0.5), (dscores.transpose(0, 2, 1) @ s["q"])[..., :size]
        d["q"], d["k"], d["v"] = late.T @ flat(dq), flat(s["x"]).T @ flat(dk), flat(s["x"]).T @ flat(dv)
        dy, scored = dy.reshape(s["y"].shape), dq.shape[1]
        d["pos"] = np.zeros_like(p["pos"])
        d["pos"][-length:] = dk.sum(0) @ p["k"].T + dv.sum(0) @ p["v"].T
        d["pos"][-scored:] += dy.sum(0) + dq.sum(0) @ p["q"].T
        if vectors:
            dx = dk @ p["k"].T + dv @ p["v"].T
            dx[:, length - scored :] += dy + dq @ p["q"].T
            used, where = np.unique(ids, return_inverse=True)
            order = np.argsort(where.ravel(), kind="stable")
            begin = np.concatenate([[0], np.cumsum(np.bincount(where.ravel()))[:-1]])
            d["e"] = (used, np.add.reduceat(flat(dx)[order], begin, axis=0))
        return d

    def fit(self, lots: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], moments: dict) -> None:
        """A step of Adam towards experts that give what stands at the scored places high chances, over ``lots`` of windows:
        ids, whether places are real, and the chances (window, place, expert). Vectors stay as counted. Fewer windows than
        ``STEP`` make a smaller step."""
        names, total, windows, places = [k for k in self.p if k != "e"], 0.0, 0, 0
        for ids, real, chances in lots:
            kept: dict = {}
            g = self.gates(ids, real, chances.shape[1], kept)
            joint = g * chances
            joint *= (1 / (joint @ np.ones(joint.shape[-1], joint.dtype) + np.float32(1e-30)))[..., None]
            np.subtract(g, joint, out=joint)
            use = real[:, -chances.shape[1] :]
            joint *= use[..., None]
            windows, places = windows + len(ids), places + use.sum()
            grads = self.gradients(kept, ids, joint, vectors=False)
            total = total + np.concatenate([grads[k].ravel() for k in names])
        moments["steps"] = at = moments.get("steps", 0) + 1
        total /= max(1, places)
        for i, (new, rest) in enumerate(zip((total, total * total), MEMORY, strict=True)):
            moments[i] = new * (1 - rest) + moments.get(i, 0.0) * rest
        move = moments[0] / (1 - MEMORY[0] ** at) / (np.sqrt(moments[1] / (1 - MEMORY[1] ** at)) + 1e-5)
        move *= RATE * min(1, windows / STEP) / (1 + at / SLOWING) ** 0.5
        for k, part in self.split_layer(move).items():
            self.p[k] = self.p[k] - part

    def split_layer(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """One row of numbers as the layer's weights, which stand in it one after the other; vectors are not among them."""
        names = [k for k in self.p if k != "e"]
        parts = np.split(values, np.cumsum([self.p[k].size for k in names])[:-1])
        return {k: part.reshape(self.p[k].shape).astype(np.float32) for k, part in zip(names, parts, strict=True)}

    def set_weights(self, counts: np.ndarray, after: np.ndarray, smoothing: float = 20.0, seed: int = 7) -> None:
        """Where fitting starts: the layer from ``counts`` (subword, expert) and how often a next subword begins a word, is its
        second, or a later one ``after`` (subword, 3).

        A vector has, for each topic, the log of the topic's share of the subword over its share of the corpus; how much
        that tells (Kullback-Leibler); logs of what comes after. Attention weighs by what a subword tells. A topic's
        evidence is that of the last subword and ``EVIDENCE`` times the mean of what is read, and counts only up to ``-HELD``,
        so that topics do not outweigh pairs. All places ask the same at first; keys for what else places
        ask (by chance) are zero until they are fitted.
        """
        of = counts[:, :MEMBERS].reshape(len(counts), TOPICS, 3).sum(2)
        share = (of.sum(0) + 1e-4 * max(1.0, of.sum())) / (of.sum(0) + 1e-4 * max(1.0, of.sum())).sum()
        topic = (of + smoothing * share) / (of.sum(1, keepdims=True) + smoothing)
        told = np.log(topic / share)
        next_place = after + 5 * after.sum(0) / max(1, after.sum())
        next_place = next_place / np.maximum(next_place.sum(1, keepdims=True), 1e-9)
        self.p = p = {k: np.zeros_like(x) for k, x in self.p.items()}
        p["w1"], p["b1"], p["w2"] = p["w1"][:, :TOPICS], p["b1"][:TOPICS], p["w2"][:TOPICS]
        p["q"], p["k"], p["v"], p["o"] = p["q"][:, :KEYS], p["k"][:, :KEYS], p["v"][:, :TOPICS], p["o"][:TOPICS]
        tells, places, inside, always = TOPICS, slice(TOPICS + 1, TOPICS + 4), TOPICS + 4, TOPICS + 5
        p["e"][:, :TOPICS] = np.clip(told, -8, 8)
        p["e"][:, tells] = (topic * told).sum(1)
        p["e"][:, places] = np.log(next_place + 1e-4) + np.log([1, 1 - WITHIN, 1 - WITHIN])
        p["e"][:, inside] = np.log(1 - next_place[:, 0] + 1e-4) + np.log(WITHIN)
        p["pos"][:, always] = 1
        p["q"][:, 1:] = DIM**-0.5 * np.random.default_rng(seed).standard_normal((DIM, KEYS - 1))
        p["q"][always, 0], p["k"][tells, 0] = SALIENCE * DIM**0.5, 1
        each = np.arange(TOPICS)
        p["v"][each, each], p["o"][each, each] = 1, EVIDENCE
        p["w1"][each, each], p["b1"], p["w2"][each, each] = 1, (np.log(share) + HELD).astype(np.float32), -1
        for place in range(3):
            p["g"][each, 3 * each + place], p["c"][3 * each + place] = 1, np.log(share)
            p["g"][places.start + place, 3 * each + place] = 1
        p["g"][inside, -1] = 1

    def set_experts(self, counts: np.ndarray, prior: np.ndarray, subword_opens: np.ndarray, weight: float = 100.0) -> None:
        """Experts from counts, smoothed by the subwords' corpus frequencies ``prior`` of their kind."""
        out, single = np.zeros(counts.shape), np.zeros(counts.shape[1])
        for opens in (True, False):
            base = np.where(subword_opens == opens, prior + 0.01, 0.0)
            base /= base.sum()
            of = self.opens == opens
            held = np.where((subword_opens == opens)[:, None], counts[:, of], 0) + weight * base[:, None]
            out[:, of], single[of] = held / held.sum(0), 1 / held.sum(0)
        out[:, -1] = 0
        self.experts, self.single = out.astype(np.float32), single.astype(np.float32)
        self.evenly = self.experts.sum(1)

    def windows(self, tokens: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Subwords read, whether places are real, the scored places that are, and which subwords of the block stand there."""
        bounds, document, base = window_starts(tokens)
        for i in range(0, len(base), LOT):
            ids, real, place = self.read(tokens.ids, bounds, document[i : i + LOT], base[i : i + LOT])
            use = real[:, CONTEXT:]
            yield ids, real, use, place[use]

    def read(self, ids: np.ndarray, bounds: np.ndarray, document: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows: subwords read, whether places are real, and which of ``ids`` stand at the scored places.

        What is read before subword i is i - 1, or an end at the beginning.
        """
        place = base[:, None] + np.arange(-CONTEXT, WIDTH)
        first = bounds[document][:, None]
        real = (place >= first) & (place < bounds[document + 1][:, None])
        return np.where(real & (place > first), ids[np.clip(place - 1, 0, len(ids) - 1)], self.end), real, place[:, CONTEXT:]

    def pair_chances(self, tokens: Tokens) -> np.ndarray:
        """Of each subword inside a word after the one before; looked up once for a distinct word. 0 where a word begins."""
        at = tokens.inner(tokens.at)
        before, after = tokens.ids[at - 1], tokens.ids[at]
        of_word = np.empty(len(at))
        order = np.argsort((before.astype(np.uint64) << np.uint64(PAIR_BITS)) | after.astype(np.uint64))  # neighbours in the table
        of_word[order] = self.pairs.chance(before[order], after[order])
        of_word[self.pairs.base[after] <= 0] = 0
        sizes = tokens.sizes[tokens.at] - 1
        out = np.zeros(len(tokens.ids))
        out[tokens.inner()] = of_word[ragged((np.cumsum(sizes) - sizes)[tokens.which], sizes[tokens.which])]
        return out

    def word_scores(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs, for every word of a block given what stands before it, of the model's probabilities of its first
        subword and of all that follows in the word, its end included."""
        first, opens = np.concatenate([[0], np.cumsum(tokens.sizes)]), self.opens.astype(np.float32)
        logp, starts, pair = np.empty(len(tokens.ids)), np.empty(len(tokens.ids)), self.pair_chances(tokens)
        for ids, real, use, target in self.windows(tokens):
            g = self.gates(ids, real, WIDTH)
            aim, inside = np.full(use.shape, self.end), np.zeros(use.shape)
            aim[use], inside[use] = tokens.ids[target], pair[target]
            held = np.einsum("ijk,ijk->ij", g, self.experts.take(aim, axis=0)) + g[..., -1] * inside
            even = self.evenly[aim] + inside
            logp[target] = ((1 - FLOOR) * held + FLOOR / len(opens) * even)[use]
            starts[target] = ((1 - FLOOR) * np.einsum("ijk,k->ij", g, opens) + FLOOR * opens.mean())[use]
        for x in (logp, starts):
            x += 1e-30
            np.log(x, out=x)
        word_first = first[:-1]
        ends = np.zeros(len(word_first), dtype=bool)
        ends[tokens.first[1:] - 1] = True
        over = np.where(ends, 0.0, np.append(starts[word_first][1:], 0.0))
        return logp[word_first] - starts[word_first], np.add.reduceat(logp, word_first) - logp[word_first] + over


def kind_of(size: int) -> np.ndarray:
    """One of ``KINDS`` for each subword, by hash."""
    return (mix64(np.arange(size, dtype=np.uint64) + np.uint64(1)) % np.uint64(KINDS)).astype(np.int64)


def together(tokens: Tokens, kind: np.ndarray) -> np.ndarray:
    """How much kinds of subwords share stretches of the documents of a block."""
    bounds = np.concatenate([[0], np.cumsum(tokens.sizes)])[tokens.first]
    out = np.zeros((KINDS, KINDS))
    edges = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] + [bounds[-1:]])
    for i in range(0, len(edges) - 1, 4096):
        part = edges[i : i + 4097]
        row = np.repeat(np.arange(len(part) - 1), np.diff(part))
        cell = row * KINDS + kind[tokens.ids[part[0] : part[-1]]]
        bag = np.sqrt(np.bincount(cell, minlength=(len(part) - 1) * KINDS).astype(np.float32)).reshape(-1, KINDS)
        bag /= np.linalg.norm(bag, axis=1, keepdims=True)
        out += bag.T @ bag
    return out


def groups_of(points: np.ndarray, mass: np.ndarray, tries: int = 30, rounds: int = 30) -> np.ndarray:
    """Group of each point: the best of some k-means, which start from points that are far apart by chance."""
    rng, best, out = np.random.default_rng(2), np.inf, np.zeros(len(points), np.int64)
    for _ in range(tries):
        centres = np.empty((0, points.shape[1]))
        far = np.ones(len(points))
        while len(centres) < TOPICS:
            chance = far * mass if (far * mass).any() else mass
            centres = np.concatenate([centres, points[[rng.choice(len(points), p=chance / chance.sum())]]])
            far = ((points[:, None] - centres) ** 2).sum(2).min(1)
        for _ in range(rounds):
            group = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
            for j in range(TOPICS):
                if mass[group == j].sum():
                    centres[j] = np.average(points[group == j], axis=0, weights=mass[group == j])
        distance = ((points[:, None] - centres) ** 2).sum(2)
        if (distance.min(1) * mass).sum() < best * (1 - 1e-9):
            best, out = (distance.min(1) * mass).sum(), distance.argmin(1)
    return out


def first_topics(cells: np.ndarray, size: int) -> np.ndarray:
    """Log chance of each subword in each topic, by its kind: ``TOPICS`` groups of kinds that stand together (``cells``)."""
    mass = cells.sum(1)
    there = mass > 0
    root = np.sqrt(np.where(there, mass, 1))
    values, vectors = np.linalg.eigh(cells / np.outer(root, root))
    vectors = (vectors * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :TOPICS]
    apart = np.where(there[:, None], vectors[:, 1:] / np.maximum(np.abs(vectors[:, :1]), 1e-9), 0)
    group = groups_of(apart, mass)
    profile = np.stack([cells[group == j].sum(0) if (group == j).any() else mass for j in range(TOPICS)], axis=1) + 1e-9
    return np.log(profile / profile.sum(0))[kind_of(size)].astype(np.float32)


def topic_table(counts: np.ndarray, prior: np.ndarray, weight: float = 100.0) -> np.ndarray:
    """Log chance of each subword in each topic from ``counts`` (subword, expert)."""
    base = (prior + 0.01) / (prior + 0.01).sum()
    held = counts[:, :MEMBERS].reshape(len(counts), TOPICS, 3).sum(2) + weight * base[:, None]
    return np.log(held / held.sum(0)).astype(np.float32)


def topic_members(tokens: Tokens, table: np.ndarray) -> np.ndarray:
    """Expert of each subword of a block, each window under its likeliest topic."""
    first = np.cumsum(tokens.sizes) - tokens.sizes
    place = np.minimum(np.arange(len(tokens.ids)) - np.repeat(first, tokens.sizes), 2)
    return members_of(tokens.ids, window_starts(tokens)[2], place, table)


def members_of(ids: np.ndarray, base: np.ndarray, place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The same from subwords, where windows begin, and places in words (0, 1, 2 for the first, second, a later subword)."""
    edges = np.append(base, len(ids))
    topic = np.empty(len(base), np.int64)
    for i in range(0, len(base), 4096):
        starts = edges[i : i + 4097]
        chances = table.take(ids[starts[0] : starts[-1]], axis=0)
        topic[i : i + 4096] = np.add.reduceat(chances, starts[:-1] - starts[0], axis=0).argmax(1)
    return np.repeat(topic, np.diff(edges)) * 3 + place


# -- corpus -----------------------------------------------------------------------------------------------------------


def corpus_counts(training: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Staged (kind, key, count) of ``training`` (text), and its subwords, staged as a binary ``ids`` for each document.

    Kind ``word`` has the hashes of all words and of the end, ``subword`` all subwords and the end, ``pair`` the pairs of
    subwords inside words, ``next`` subwords by the place in a word of what follows, ``cell`` kinds of subwords in the same
    stretches.
    """

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        distinct, where = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(where, counts, minlength=len(distinct)).astype(np.int64)

    def out(kind: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), BATCH_ROWS):
            part, n = keys[i : i + BATCH_ROWS], counts[i : i + BATCH_ROWS]
            kinds = pa.array([kind]).take(pa.array(np.zeros(len(part), np.int64)))
            columns = [kinds, pa.array(part.view(np.int64)), pa.array(n), pa.nulls(len(part), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "count", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords.of(tokenizer)
        kind_of_subword, cells = kind_of(subwords.size), np.zeros((KINDS, KINDS))
        held: dict[str, list] = {"word": [], "pair": []}
        full = {"subword": np.zeros(subwords.size, np.int64), "next": np.zeros(subwords.size * 3, np.int64)}
        for block in blocks(batches, "text"):
            t = tokens_of(block, subwords)
            n = np.bincount(t.which, minlength=len(t.distinct))
            inner = t.inner(t.at)
            before, after = t.ids[inner - 1].astype(np.uint64), t.ids[inner].astype(np.uint64)
            held["word"].append((t.distinct, n))
            held["pair"].append(merged([((before << np.uint64(PAIR_BITS)) | after, np.repeat(n, t.sizes[t.at] - 1))]))
            full["subword"] += np.bincount(t.ids, minlength=subwords.size)
            read = np.concatenate([[subwords.end], t.ids[:-1]])
            full["next"] += np.bincount(read * 3 + places_in_words(t.ids, subwords), minlength=subwords.size * 3)
            cells += together(t, kind_of_subword)
            coded = binaries(t.ids.astype(id_type(subwords.size)), window_starts(t)[0])
            nothing = [pa.nulls(len(coded), x) for x in (pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, coded], names=["kind", "key", "count", "ids"])
            for kind, parts in held.items():
                if sum(len(x[0]) for x in parts) > 2 * COUNT_ROWS:
                    one = merged(parts)
                    held[kind] = [one]
                    if len(one[0]) > COUNT_ROWS:
                        yield from out(kind, *one)
                        held[kind] = []
        for kind, parts in held.items():
            if parts:
                yield from out(kind, *merged(parts))
        full["cell"] = np.rint(cells * CELL).astype(np.int64).ravel()
        for kind, counts in full.items():
            keys = np.flatnonzero(counts)
            yield from out(kind, keys, counts[keys])

    with small_batches(training.sparkSession, BATCH_BYTES):
        found = stage(training.select("text").mapInArrow(run, "kind string, key bigint, count bigint, ids binary"), "corpus")
    counted = found.where(F.col("kind").isNotNull()).groupBy("kind", "key").agg(F.sum("count").alias("count"))
    return stage(counted, "counts"), found.where(F.col("kind").isNull()).select("ids")


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary for each stretch of ``values`` between ``bounds``."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def of_binaries(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all binaries of a column, one after the other."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int64)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[first:last].view(kind)


def places_in_words(ids: np.ndarray, subwords: Subwords) -> np.ndarray:
    """0, 1, 2 for the first, second and a later subword of a word."""
    place = np.arange(len(ids))
    return np.minimum(place - np.maximum.accumulate(np.where(subwords.opens[ids], place, 0)), 2)


def topic_counts(coded: DataFrame, table: np.ndarray, tokenizer: str) -> np.ndarray:
    """Counts (subword, expert) of all documents (``ids``), each window under its likeliest topic."""
    shared = coded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, table = Subwords.of(tokenizer), shared.value
        counts = np.zeros(subwords.size * MEMBERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = of_binaries(batch.column(0), id_type(subwords.size)).astype(np.int64)
                bounds = np.concatenate([[0], np.flatnonzero(ids == subwords.end) + 1])
                member = members_of(ids, window_places(bounds)[1], places_in_words(ids, subwords), table)
                counts += np.bincount(ids * MEMBERS + member, minlength=len(counts))
        keys = np.flatnonzero(counts)
        for i in range(0, len(keys), BATCH_ROWS):
            part = keys[i : i + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["key", "count"])

    summed = coded.mapInArrow(run, "key bigint, count bigint").groupBy("key").agg(F.sum("count").alias("count"))
    with small_batches(coded.sparkSession, BATCH_BYTES):
        found = summed.toArrow()
    out = np.zeros((len(table), MEMBERS + 1))
    key = found.column("key").to_numpy()
    out[key // MEMBERS, key % MEMBERS] = found.column("count").to_numpy()
    return out


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of the most frequent rows of ``counts``: all from some count on, at most ``most``."""
    step = F.floor(F.log2("count") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in steps:  # some hundred rows
        total += row["n"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(step >= least).toArrow()
    keys, c = table.column("key").to_numpy().view(np.uint64), table.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], c[order]


def per_subword(counts: DataFrame, subword: Column, size: int) -> np.ndarray:
    """Sum of ``counts`` of each of ``size`` subwords."""
    table = counts.groupBy(subword.cast("int").alias("subword")).agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(size)
    out[table.column("subword").to_numpy()] = table.column("count").to_numpy()
    return out


def with_rare_pairs(rows: DataFrame, counts: DataFrame, known: np.ndarray, tokenizer: str) -> DataFrame:
    """Staged ``rows`` (with a ``text``, or its subwords as ``ids``; then in the same order) with pair_keys and pair_counts of
    a row's pairs that are not ``known``."""
    column = "ids" if "ids" in rows.columns else "text"
    placed = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def subwords_of(batches: Iterable[pa.RecordBatch], subwords: Subwords) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if column == "text":
            for block in blocks(batches, "text"):
                t = tokens_of(block, subwords)
                yield block.rows.column("row"), t.ids.astype(np.int64), np.repeat(t.document, t.sizes)
        else:
            for batch in batches:
                if batch.num_rows:
                    ids = of_binaries(batch.column("ids"), id_type(subwords.size)).astype(np.int64)
                    over = ids == subwords.end
                    yield batch.column("row"), ids, np.cumsum(over) - over

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, subwords = shared.value, Subwords.of(tokenizer)
        for rows, ids, document in subwords_of(batches, subwords):
            at = np.flatnonzero(~subwords.opens[ids])
            key = (ids[at - 1].astype(np.uint64) << np.uint64(PAIR_BITS)) | ids[at].astype(np.uint64)
            if len(known):
                rare = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key
                at, key = at[rare], key[rare]
            both = np.unique((document[at].astype(np.uint64) << np.uint64(2 * PAIR_BITS)) | key)
            low = np.uint64((1 << 2 * PAIR_BITS) - 1)
            row = rows.take(pa.array((both >> np.uint64(2 * PAIR_BITS)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([row, pa.array((both & low).astype(np.int64))], names=["row", "key"])

    held = placed.select("row", column).mapInArrow(run, "row bigint, key bigint").join(counts, "key")
    of_row = held.groupBy("row").agg(F.collect_list(F.struct("key", "count")).alias("_pairs"))
    joined = placed.join(of_row, "row", "left")
    if column == "ids":
        joined = joined.orderBy("row")
    paired = joined.select(*rows.columns, F.col("_pairs.key").alias("pair_keys"), F.col("_pairs.count").alias("pair_counts"))
    with small_batches(rows.sparkSession, BATCH_BYTES):
        return stage(paired, "with_pairs")


def for_rows(pairs: Pairs, rows: pa.RecordBatch) -> Pairs:
    """``pairs`` and the rare ones of ``rows``, if they have such columns."""
    if "pair_keys" not in rows.schema.names:
        return pairs
    keys, counts = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pair_keys", "pair_counts"))
    return pairs.more(keys.astype(np.int64).view(np.uint64), counts)


def inside_without(pairs: Pairs, ids: np.ndarray) -> np.ndarray:
    """Probability of each subword inside a word after the one before, as if the corpus had one such pair less. 0 where a word
    begins."""
    at, out = np.flatnonzero(pairs.base[ids] > 0), np.zeros(len(ids), np.float32)
    out[at] = pairs.chance(ids[at - 1], ids[at], seen=1)
    return out


def chances_without(model: AttentionModel, ids: np.ndarray, place: np.ndarray, member: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Probability by every expert of what stands at ``place`` (of ``ids``), as if the corpus had been counted without it.

    ``member`` is the expert that counted a subword, ``inside`` its probability by pairs.
    """
    out, own = model.experts.take(ids[place], axis=0), member[place].ravel()
    own_chance, which = out.reshape(-1), np.arange(len(own)) * out.shape[-1] + own
    own_chance[which] = np.maximum(own_chance[which] - model.single[own], np.float32(1e-12))
    out[..., -1] = inside[place]
    return out


def fitted(model: AttentionModel, coded: DataFrame, table: np.ndarray, tokenizer: str) -> AttentionModel:
    """``model`` with a layer fitted to all documents (``ids``): the mean of those that tasks fit, weighed by their windows.

    ``table`` gave the topics the experts were counted under. A task takes its windows in batches of documents, by chance
    (of a fixed seed) within each.
    """
    shared = coded.sparkSession.sparkContext.broadcast((model, table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, (model, table) = Subwords.of(tokenizer), shared.value
        model, moments, n = replace(model, p=dict(model.p)), {}, 0
        for batch in batches:
            if batch.num_rows:
                ids = of_binaries(batch.column("ids"), id_type(subwords.size)).astype(np.int64)
                bounds = np.concatenate([[0], np.flatnonzero(ids == subwords.end) + 1])
                document, base = window_places(bounds)
                member, inside = members_of(ids, base, places_in_words(ids, subwords), table), inside_without(for_rows(model.pairs, batch), ids)
                order = np.random.default_rng(len(base)).permutation(len(base))

                def lots(windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                    for i in range(0, len(windows), LOT):  # noqa: B023
                        some = windows[i : i + LOT]
                        seen, real, place = model.read(ids, bounds, document[some], base[some])  # noqa: B023
                        yield seen, real, chances_without(model, ids, np.where(real[:, CONTEXT:], place, 0), member, inside)  # noqa: B023

                for windows in np.array_split(order, -(-len(order) // STEP)):
                    model.fit(lots(windows), moments)
                n += len(base)
        if n:
            layer = np.concatenate([x.ravel() for k, x in model.p.items() if k != "e"]).astype(np.float64)
            values = np.rint(np.append(layer, 1.0) * n * CELL).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["key", "value"])

    with small_batches(coded.sparkSession, BATCH_BYTES):
        found = coded.mapInArrow(run, "key bigint, value bigint").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    values = np.empty(found.num_rows)
    values[found.column("key").to_numpy()] = found.column("value").to_numpy()
    return replace(model, p={**model.p, **model.split_layer(values[:-1] / values[-1])})


def fit(counted: DataFrame, coded: DataFrame, pairs: tuple[np.ndarray, np.ndarray], all_pairs: bool, tokenizer: str) -> AttentionModel:
    """Experts from the counts of all documents, and attention fitted to them; ``pairs`` are the most frequent pairs."""
    subwords = Subwords.of(tokenizer)
    opens = np.append(np.tile([True, False, False], TOPICS), False)
    model = AttentionModel.start(subwords.size, subwords.end, opens)
    counts = counted.where(F.col("kind") == "pair").select("key", "count")
    after = per_subword(counts, F.shiftrightunsigned("key", PAIR_BITS), subwords.size)
    into = per_subword(counts, F.col("key").bitwiseAND((1 << PAIR_BITS) - 1), subwords.size)
    model.pairs = Pairs(*pairs, subwords.opens, after=after, into=into)
    prior = prior_of(counted, subwords.size)
    cells = per_subword(counted.where(F.col("kind") == "cell"), F.col("key"), KINDS * KINDS).reshape(KINDS, KINDS)
    table = first_topics(cells, subwords.size)
    for _ in range(ROUNDS):
        used, experts = table, topic_counts(coded, table, tokenizer)
        table = topic_table(experts, prior)
    model.set_experts(experts, prior, subwords.opens)
    model.set_weights(experts, per_subword(counted.where(F.col("kind") == "next"), F.col("key"), 3 * subwords.size).reshape(-1, 3))
    return fitted(model, coded if all_pairs else with_rare_pairs(coded, counts, pairs[0], tokenizer), used, tokenizer)


def prior_of(counted: DataFrame, size: int) -> np.ndarray:
    """Counts of all subwords in the training documents."""
    return per_subword(counted.where(F.col("kind") == "subword"), F.col("key"), size)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 10,
    tokenizer: str = TOKENIZER,
    share: float = SHARE,
    completion: float = COMPLETION,
    frequent_words: int = 200_000,
    frequent_pairs: int = 400_000,
    sample_documents: int | None = None,
    sample_chars: int | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    ``sample_documents`` and ``sample_chars`` have no effect: nothing is learned from a sample any more.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    held_out = remainder(F.col("doc_id"), modulus) == 0
    training = rows.where(~held_out)
    counted, coded = corpus_counts(training, tokenizer)
    counts = counted.where(F.col("kind") == "word").select("key", "count")
    totals = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(totals["n"]), int(totals["v"])
    known, known_counts = frequent(counts, frequent_words)
    pair_counts = counted.where(F.col("kind") == "pair").select("key", "count")
    pairs = frequent(pair_counts, frequent_pairs)
    all_pairs = len(pairs[0]) == pair_counts.count()
    model = None if v <= 1 else fit(counted, coded, pairs, all_pairs, tokenizer)  # one for the end
    if model is not None and not all_pairs:
        rows = with_rare_pairs(rows, pair_counts, pairs[0], tokenizer)
    begun = None if model is None else prior_of(counted, Subwords.of(tokenizer).size)
    shared = docs.sparkSession.sparkContext.broadcast((known, known_counts, model, begun))
    below = n + 0.1 * (v + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_counts, model, begun = shared.value
        subwords = Subwords.of(tokenizer) if model is not None else None
        for block in blocks(batches, "text"):
            if model is None:
                starts, ends, first = block.words()
                hashes = np.insert(PrefixHash(block.data, lower=True).ranges(starts, ends), first[1:], END_HASH)
                first = first + np.arange(len(first))
                distinct, which = hashes, slice(None)
                per_count = own = np.zeros(len(hashes))
            else:
                t = tokens_of(block, subwords)
                hashes, first, distinct, which = t.hashes, t.first, t.distinct, t.which
                opening, rest = map(np.exp, replace(model, pairs=for_rows(model.pairs, block.rows)).word_scores(t))
                same = begun[t.ids[np.cumsum(t.sizes) - t.sizes]]  # corpus words that begin alike
                to_counts = np.where(same > 0, completion, 0.0)
                per_count = share / n + (1 - share) * opening * to_counts / np.maximum(1, same)
                own = (1 - share) * opening * (1 - to_counts) * rest
            place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
            common = known[place] == distinct if len(known) else np.zeros(len(distinct), bool)
            count = np.where(common, known_counts[place], 0).astype(np.float64) if len(known) else np.zeros(len(distinct))
            log_base = np.log10((count + 0.1) / below) if below else count
            common, c = common[which], count[which]
            c = c[common]
            base, score = np.zeros(len(hashes)), np.zeros(len(hashes))
            base[common] = log_base[which][common]
            score[common] = np.log10(c * per_count[common] + own[common]) if model is not None else base[common]
            rare = ~common
            rare_first = np.concatenate([[0], np.cumsum(rare)])[first]
            bounds = pa.array(rare_first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.add.reduceat(common, first[:-1]).astype(np.int64)),
                    pa.array(np.add.reduceat(base, first[:-1])),
                    pa.array(np.add.reduceat(score, first[:-1])),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes[rare].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(per_count[rare])),
                    pa.ListArray.from_arrays(bounds, pa.array(own[rare])),
                ],
                names=["doc_id", "n_tokens", "known", "base", "score", "words", "per_count", "own"],
            )

    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("per_count", T.ArrayType(T.DoubleType())),
            T.StructField("own", T.ArrayType(T.DoubleType())),
        ]
    )
    with small_batches(docs.sparkSession, BATCH_BYTES):
        scored = stage(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    c = F.coalesce(F.col("count"), F.lit(0))
    base = F.log10((c + 0.1) / below)
    mixed = F.log10(c * F.col("per_count") + F.col("p")) if model is not None else base
    rare = (
        scored.select("row", F.explode(F.arrays_zip("words", "per_count", "own")).alias("w"))
        .select("row", F.col("w.words").alias("word"), "w.per_count", F.greatest(F.col("w.own"), F.lit(1e-300)).alias("p"))
        .join(counts.withColumnRenamed("key", "word"), "word", "left")
        .groupBy("row")
        .agg(F.sum((c > 0).cast("bigint")).alias("_known"), F.sum(base).alias("_base"), F.sum(mixed).alias("_score"))
    )
    zero = F.lit(0.0)
    return scored.drop("words", "per_count", "own").join(rare, "row", "left").select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("_score", zero)).alias("score"),
    )
