"""Personal data, and the terms that give it away.

Patterns find the protected entities: email addresses, IP addresses, card and telephone numbers. A text
without them may still disclose one, by terms that stand next to it elsewhere. How strongly, the corpus
tells: the information that a term gives about an entity is their pointwise mutual information,
log(P(entity, term) / (P(entity) P(term))), against the information content of the entity, log(1 / P(entity)).
Their ratio is 1 if the term stands only beside the entity, and about 0 if they are independent. A term with a ratio
of at least ``threshold`` for some entity is sanitised wherever it stands: generalised to its make-up (as many
letters and digits) if that class of terms stays below the threshold, else removed.

Probabilities are shares of distinct texts, so exact copies count once. Beside means among the ``window`` terms before or
after, those within other entities left out. A pair must stand in ``min_contexts`` different surroundings,
so copies of one passage do not make a pair, and an entity that occurs once discloses nothing by others.

Rows that leave a task are entities times a window, not pairs of all that a text has. Terms are first bounded from
below (texts in which they stand beside any entity), so frequent ones never need to be counted; the others are counted over
all documents. Keys go to tasks as a sorted list if there are at most ``broadcast_terms``, and as a bitmap of fixed size
beyond, followed by a join, with the same result.
"""

from __future__ import annotations

import re

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.decontaminate import hash_filter, passing
from lumenprep.llm.search import block_terms
from lumenprep.llm.words import Block, PrefixHash, blocks, mix64
from lumenprep.operators.staging import stage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 5
MIN_CONTEXTS = 3
THRESHOLD = 0.95
BROADCAST_TERMS = 1_000_000
GENERALISED, REMOVED = 1, 2

SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and never begun within digits: a match takes whole groups of digits, so both change nothing but the time.
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, dtype=bool)  # first bytes of letters, and of all beyond ASCII
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True
_LOCAL = _DIGIT | (_LETTER & (np.arange(256) < 0x80))
_LOCAL[list(b"._%+-")] = True
_CLASS_SALT = np.uint64(0x5851F42D4C957F2D)


def passes_luhn(digits: bytes) -> bool:
    """Checksum of card numbers, over ASCII digits."""
    values = [d - 48 for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """A local part holds no ``@``, so each ``@`` has at most one, and texts without ``@`` cost nothing."""
    at = text.find(b"@")
    if at < 0:
        return
    outside = np.flatnonzero(~_LOCAL[np.frombuffer(text, dtype=np.uint8)])
    end = 0
    while at >= 0:
        before = np.searchsorted(outside, at) - 1
        start = max(end, int(outside[before]) + 1 if before >= 0 else 0)
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            end = domain.end()
            yield start, end
        at = text.find(b"@", at + 1)


def digits_of(text: bytes) -> bytes:
    return bytes(b for b in text if 48 <= b < 58)


def entities(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities of a text, in bytes, by start and kind. Kinds may overlap each other."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m.group().split(b".")]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            found.append((m.start(), 2, m.end()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity_hash(kind: int, text: bytes) -> int:
    """One value for all ways to write an entity: letter case and signs between digits do not count."""
    value = text.lower() if kind < 2 else digits_of(text)
    h = PrefixHash(np.frombuffer(value, dtype=np.uint8)).ranges(np.array([0]), np.array([len(value)]))
    return int(mix64(h + np.uint64(kind + 1)).view(np.int64)[0])


class Terms:
    """The terms of a block: where they are, their hashes, and those of their classes."""

    def __init__(self, block: Block):
        self.starts, self.ends, self.first = block_terms(block)
        self.hashes = PrefixHash(block.data, lower=True).ranges(self.starts, self.ends)
        self.letters = self._count(block, _LETTER)
        self.digits = self._count(block, _DIGIT)
        self.classes = mix64((self.letters.astype(np.uint64) << np.uint64(32) | self.digits.astype(np.uint64)) ^ _CLASS_SALT)

    def _count(self, block: Block, kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind[block.data])])
        return upto[self.ends] - upto[self.starts]


def block_entities(block: Block) -> list[list[tuple[int, int, int]]]:
    """Entities of each text. Only texts with two digits or an ``@`` are searched."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[block.data])])
    at = np.concatenate([[0], np.cumsum(block.data == ord("@"))])
    low, high = block.offsets[:-1], block.offsets[1:]
    some = (digits[high] - digits[low] >= 2) | (at[high] > at[low])
    return [entities(block.data[a:b].tobytes()) if s else [] for a, b, s in zip(low, high, some, strict=True)]


def outside(starts: np.ndarray, ends: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the terms (in order) that touch no entity."""
    free = np.ones(len(starts), dtype=bool)
    for s, _, e in found:
        free[np.searchsorted(ends, s, side="right") : np.searchsorted(starts, e)] = False
    return free


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """entity, text_hash, context, term and class of every term beside an entity of documents (text_hash, text).

    An entity without terms beside it gives a row without them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            every = block_entities(block)
            if not any(every):
                continue
            terms = Terms(block)
            out: list[tuple] = []
            texts = block.rows.column("text_hash")
            for i, found in enumerate(every):
                if not found:
                    continue
                low, part = block.offsets[i], slice(terms.first[i], terms.first[i + 1])
                starts, ends = terms.starts[part] - low, terms.ends[part] - low
                free = np.flatnonzero(outside(starts, ends, found))
                hashes, classes = terms.hashes[part][free], terms.classes[part][free]
                text = block.data[low : block.offsets[i + 1]].tobytes()
                for s, kind, e in found:
                    middle = np.searchsorted(starts[free], s)
                    near = slice(max(0, middle - window), middle + window)
                    h = hashes[near]
                    place = np.arange(len(h), dtype=np.uint64) + np.uint64(window + max(0, middle - window) - middle)
                    context = int(mix64((mix64(h + place)).sum(dtype=np.uint64)[None]).view(np.int64)[0])
                    entity = entity_hash(kind, text[s:e])
                    pairs = sorted(set(zip(h.view(np.int64).tolist(), classes[near].view(np.int64).tolist(), strict=True)))
                    out.extend((entity, texts[i].as_py(), context, t, c) for t, c in pairs or [(None, None)])
            if out:
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["entity", "text_hash", "context", "term", "class"])

    return docs.mapInArrow(run, "entity bigint, text_hash bigint, context bigint, term bigint, class bigint")


class Keys:
    """Hashes looked for in tasks: a sorted list, or beyond ``most`` a bitmap that lets a few others pass."""

    def __init__(self, keys: DataFrame, most: int):
        self.exact = keys.count() <= most
        if self.exact:
            held = np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64))
        else:
            held = hash_filter(keys.toDF("seed"))
        self.shared: Broadcast = keys.sparkSession.sparkContext.broadcast(held)

    def finder(self):
        """A function of hashes that returns the positions of those looked for; to be used in tasks."""
        shared, exact = self.shared, self.exact

        def find(h: np.ndarray) -> np.ndarray:
            held = shared.value
            if not exact:
                return passing(held, h)
            if not len(held):
                return np.zeros(0, dtype=np.int64)
            return np.flatnonzero(held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h)

        return find


def text_frequencies(docs: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """key and the number of distinct texts with it, for terms and classes in ``keys`` (key), of documents (text_hash, text)."""
    find = Keys(keys, most).finder()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            terms = Terms(block)
            text_of = np.repeat(np.arange(len(block.offsets) - 1), np.diff(terms.first))
            hits = [(h[at], text_of[at]) for h in (terms.hashes, terms.classes) for at in (find(h),)]
            h, text = (np.concatenate(x) for x in zip(*hits, strict=True))
            if not len(h):
                continue
            pairs = np.unique(np.stack([text.astype(np.uint64), h], axis=1), axis=0)
            rows, begin = np.unique(pairs[:, 0], return_index=True)
            bounds = pa.array(np.append(begin, len(pairs)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("text_hash").take(pa.array(rows.astype(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(pairs[:, 1].view(np.int64)))],
                names=["text_hash", "keys"],
            )

    held = docs.mapInArrow(run, "text_hash bigint, keys array<bigint>").dropDuplicates(["text_hash"])
    counted = held.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    return counted.join(keys, "key", "left_semi")


def disclosure(together: Column, texts: Column, entity_texts: Column, n: int) -> Column:
    """Mutual information of term and entity over the information of the entity; 0 for an entity that all texts have."""
    information = F.log2(F.lit(float(n)) / entity_texts)
    shared = F.log2(together.cast("double") * n / (texts.cast("double") * entity_texts))
    return F.when(information > 0, shared / information).otherwise(F.lit(0.0))


def disclosing_terms(
    docs: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    min_contexts: int = MIN_CONTEXTS,
    threshold: float = THRESHOLD,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """term (hash), action (1: generalise, 2: remove), disclosure (the highest ratio) of terms that reveal an entity."""
    texts = docs.select(F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    beside = stage(contexts(texts, window), "contexts")
    entity_texts = beside.groupBy("entity").agg(F.count_distinct("text_hash").alias("entity_texts"))
    pairs = beside.groupBy("entity", "term", "class").agg(F.count_distinct("text_hash").alias("together"), F.count_distinct("context").alias("contexts"))
    pairs = pairs.where(F.col("term").isNotNull() & (F.col("contexts") >= min_contexts)).join(entity_texts, "entity")
    anywhere = beside.groupBy("term").agg(F.count_distinct("text_hash").alias("texts_beside"))
    n = texts.select("text_hash").distinct().count()
    ratio = lambda c, k: disclosure(F.col(c), F.col(k), F.col("entity_texts"), n)
    # A term stands in at least the texts in which it stands beside an entity, so its ratio is at most this one.
    likely = stage(pairs.join(anywhere, "term").where(ratio("together", "texts_beside") >= threshold), "likely_terms")
    keys = likely.select(F.col("term").alias("key")).union(likely.select(F.col("class").alias("key"))).distinct()
    counted = stage(text_frequencies(texts, stage(keys, "likely_keys"), broadcast_terms), "term_texts")
    over = likely.join(counted.select(F.col("key").alias("term"), "texts"), "term").withColumn("ratio", ratio("together", "texts")).where(F.col("ratio") >= threshold)
    class_pairs = beside.groupBy("entity", "class").agg(F.count_distinct("text_hash").alias("class_together"))
    classes = counted.select(F.col("key").alias("class"), F.col("texts").alias("class_texts"))
    judged = over.join(class_pairs, ["entity", "class"]).join(classes, "class").withColumn("class_ratio", ratio("class_together", "class_texts"))
    return judged.groupBy("term").agg(
        F.max(F.when(F.col("class_ratio") < threshold, GENERALISED).otherwise(REMOVED)).alias("action"), F.max("ratio").alias("disclosure")
    )


def rewrite(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``text`` with each span replaced; of spans that overlap the first one's replacement stands for all."""
    out, at = [], 0
    for _, start, end, new in spans:
        if start >= at:
            out.append(text[at:start])
            out.append(new)
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(
    docs: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    min_contexts: int = MIN_CONTEXTS,
    threshold: float = THRESHOLD,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """``docs`` with ``pii_spans`` and ``sanitised``.

    ``pii_spans`` (kind, start, end; code points, end exclusive) are by start, then kind: email, ip, card, phone, term. Entities may overlap
    entities of other kinds; terms overlap none. In ``sanitised`` an entity is its kind in brackets, a generalised
    term as many ``a`` and ``9`` as it has letters and digits, and a removed term is gone.

    NULL and empty texts have no spans and an empty ``sanitised``. Rows are treated one by one, so repeated ones stay. Input columns
    named like the two results (in any case) are replaced, all others pass unchanged. With no entities, or none that recurs, no terms go.
    """
    terms = stage(disclosing_terms(docs, text_col, window, min_contexts, threshold, broadcast_terms), "disclosing_terms")
    rest = [c for c in docs.columns if c.lower() not in ("pii_spans", "sanitised")]
    fields = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.fields
    numbered = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)]  # no name can clash, nor hold a dot
    rows = docs.select(*numbered, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_pii_text"))
    keys = Keys(terms.select("term"), broadcast_terms)
    if keys.exact:
        held = terms.select("term", "action").toArrow().to_pydict()
        actions = dict(zip(held["term"], held["action"], strict=True))
        return _sanitised(rows, fields, keys, actions)
    # Too many to send: the terms that pass the bitmap are listed by text and met with the terms by a join.
    rows = stage(rows.withColumn("_pii_hash", F.md5("_pii_text")), "pii_rows")
    seen = term_places(rows.select("_pii_hash", "_pii_text").dropDuplicates(["_pii_hash"]), keys)
    marked = seen.select("_pii_hash", F.explode("terms").alias("term")).join(terms, "term")
    actions = marked.groupBy("_pii_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_pii_actions"))
    met = rows.join(actions, "_pii_hash", "left").drop("_pii_hash")
    return _sanitised(met, fields, keys, None)


def term_places(texts: DataFrame, keys: Keys) -> DataFrame:
    """_pii_hash and the distinct hashes of the text's terms that ``keys`` lets pass."""
    find = keys.finder()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_pii_text"):
            terms = Terms(block)
            held = [np.unique(h[find(h)]).view(np.int64) for h in np.split(terms.hashes, terms.first[1:-1])]
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(held)))
            yield pa.RecordBatch.from_arrays([block.rows.column("_pii_hash"), listed], names=["_pii_hash", "terms"])

    return texts.mapInArrow(run, "_pii_hash string, terms array<bigint>")


def _sanitised(rows: DataFrame, fields: list[T.StructField], keys: Keys, actions: dict[int, int] | None) -> DataFrame:
    """The rewritten texts after columns of ``fields``; ``actions`` by term, or by row in ``_pii_actions`` if None."""
    find = keys.finder()
    shared = rows.sparkSession.sparkContext.broadcast(actions)
    by_row = actions is None
    schema = T.StructType([*fields, T.StructField("pii_spans", T.ArrayType(SPAN, False), False), T.StructField("sanitised", T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_pii_text"):
            every = block_entities(block)
            terms = Terms(block)
            hit = find(terms.hashes)
            bounds = np.searchsorted(hit, terms.first)
            chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            texts = block.rows.column("_pii_text")
            listed, changed = [], []
            for i, found in enumerate(every):
                mine = hit[bounds[i] : bounds[i + 1]]
                if not found and not len(mine):
                    listed.append([])
                    changed.append(texts[i].as_py())
                    continue
                low = int(block.offsets[i])
                spans = [(s, k, e, f"[{KINDS[k].upper()}]") for s, k, e in found]
                known = dict(block.rows.column("_pii_actions")[i].as_py() or []) if by_row else shared.value
                starts, ends = terms.starts[mine] - low, terms.ends[mine] - low
                for j in np.flatnonzero(outside(starts, ends, found)):
                    action = known.get(int(terms.hashes[mine[j]].view(np.int64)))
                    if action is not None:
                        like = "a" * int(terms.letters[mine[j]]) + "9" * int(terms.digits[mine[j]])
                        spans.append((int(starts[j]), len(KINDS), int(ends[j]), like if action == GENERALISED else ""))
                spans = [
                    ((*KINDS, TERM)[k], int(chars[low + s] - chars[low]), int(chars[low + e] - chars[low]), new) for s, k, e, new in sorted(spans)
                ]
                listed.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in spans])
                changed.append(rewrite(texts[i].as_py(), spans))
            kind = pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])
            yield pa.RecordBatch.from_arrays(
                [*[block.rows.column(c) for c in range(len(fields))], pa.array(listed, pa.list_(kind)), pa.array(changed, pa.string())], names=schema.names
            )

    return rows.mapInArrow(run, schema)
