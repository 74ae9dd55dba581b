"""Find benchmark items inside documents, by spaced seeds.

A mask such as ``1101`` picks some of the words at a position and ignores the others, so its hash is
the same where only ignored words differ. Hashes of all masks at all positions of all documents meet
those of the benchmark, and every hit is verified: along its diagonal, the ungapped stretch with most
equal words, among those with a large enough share of them, must reach enough words.

Document hashes first pass a bitmap of the benchmark's hashes. It has a fixed size (8 MiB), so it can be
sent to every task whatever the benchmark's size; it lets all hits pass, and few others. What passes
is joined with the benchmark by hash, exactly.

Words are compared with A-Z lower-cased. Items of 20 words or more have masks that span 8 to 13 words, shorter ones
narrower masks, and those of 3 to 7 words must stand in a document word for word. Items of one or two words
would be found nearly everywhere and are not searched for. Items with
equal texts count as one, under their smallest id. NULL texts are empty; repeated documents are
reported one by one; NULL ids stay NULL. Without items or documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.columns import number_of, numbered
from lumenprep.llm.words import Block, PrefixHash, blocks, mix64
from lumenprep.operators.staging import stage

MASKS = ("11111111", "110101011011", "1110100110101", "1011001011101")
SHORT_MASKS = ("111111", "11100111", "11011011", "110111", "111011", "1101011")
SHORT_WORDS, WHOLE_WORDS, LEAST_WORDS = 20, 8, 3  # items under the first have short masks, under the second one that covers them
WHOLE_MASKS = tuple("1" * n for n in range(LEAST_WORDS, WHOLE_WORDS))
ALL_MASKS = (*MASKS, *SHORT_MASKS, *WHOLE_MASKS)
FILTER_BITS = 26
MIN_MATCHED = 13
MIN_SHARE = 0.8  # of the words of an item shorter than that
MIN_IDENTITY = 0.75


def seed_hashes(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``mask`` at every position where it fits into its text, and those positions.

    ``first`` has the first word of each text, and the number of words at its end.
    """
    span = len(mask)
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    salt = np.uint64(int(mask, 2))
    for j, bit in enumerate(mask):
        if bit == "1":
            total += words[j : j + n] * mix64(np.array([j * 1000003], dtype=np.uint64) + salt)[0]
    ends = np.repeat(first[1:], np.diff(first))
    fits = np.flatnonzero(np.arange(n) + span <= ends[:n])
    return mix64(total[fits] + salt), fits


def block_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = block.words()
    return PrefixHash(block.data, lower=True).ranges(starts, ends), first


def _bits(h: np.ndarray) -> tuple[np.ndarray, ...]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return h >> np.uint64(64 - FILTER_BITS), (h >> np.uint64(12)) & low, h & low


def masks_of(n: int) -> tuple[str, ...]:
    """Masks for an item of ``n`` words."""
    if n >= SHORT_WORDS:
        return MASKS
    if n >= WHOLE_WORDS:
        return SHORT_MASKS
    return ("1" * n,) if n >= LEAST_WORDS else ()


def needed(n: int, min_matched: int = MIN_MATCHED, min_share: float = MIN_SHARE) -> int:
    """How many words of an item of ``n`` words must agree."""
    return n if n < WHOLE_WORDS else min(min_matched, int(np.ceil(min_share * n)))


def item_seeds(items: DataFrame) -> DataFrame:
    """seed, item, item_pos, mask (its number) of every mask of an item at every position of ``items`` (item, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words, first = block_words(block)
            text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            ids = block.rows.column("item")
            own = [masks_of(int(n)) for n in np.diff(first)]
            for number, mask in enumerate(ALL_MASKS):
                has = np.array([mask in masks for masks in own], dtype=bool)
                h, at = seed_hashes(words, first, mask)
                use = has[text_of[at]]
                h, at = h[use], at[use]
                rows = text_of[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        ids.take(pa.array(rows)),
                        pa.array((at - first[rows]).astype(np.int32)),
                        pa.array(np.full(len(at), number, np.int32)),
                    ],
                    names=["seed", "item", "item_pos", "mask"],
                )

    item = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"seed bigint, item {item}, item_pos int, mask int")


def hash_filter(seeds: DataFrame) -> np.ndarray:
    """Bitmap with three bits set per seed. Its size is fixed, and so is what reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            spots = np.unique(np.concatenate(_bits(h)))
            words, start = np.unique(spots >> np.uint64(6), return_index=True)
            if len(spots):
                ones = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(ones.view(np.int64))], names=["word", "bits"])

    words = seeds.select("seed").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def passing(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions in ``h`` whose three bits are all set."""
    left = np.arange(len(h))
    for k in range(3):
        spot = _bits(h[left])[k]
        left = left[(bitmap[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
    return left


def document_hits(docs: DataFrame, bitmap: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Documents (doc_id, text) with a hash of ``masks`` that passes the filter; ``seeds`` and ``places`` of all those."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for block in blocks(batches, "text"):
            words, first = block_words(block)
            seeds, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for mask in masks:
                h, at = seed_hashes(words, first, mask)
                left = passing(marks, h)
                seeds.append(h[left])
                places.append(at[left])
            place = np.concatenate(places)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, seed = place[order], np.concatenate(seeds)[order]
            row = np.searchsorted(first, place, side="right") - 1
            kept, begin = np.unique(row, return_index=True)
            bounds = pa.array(np.append(begin, len(row)).astype(np.int32))
            rows = block.rows.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("text"),
                    pa.ListArray.from_arrays(bounds, pa.array(seed.view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array((place - first[row]).astype(np.int32))),
                ],
                names=["doc_id", "text", "seeds", "places"],
            )

    schema = T.StructType(
        [
            *docs.select("doc_id", "text").schema.fields,
            T.StructField("seeds", T.ArrayType(T.LongType())),
            T.StructField("places", T.ArrayType(T.IntegerType())),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_stretch(same: np.ndarray, min_identity: float) -> tuple[int, int]:
    """Start and end of the stretch with most True among those whose share of True is at least ``min_identity``.

    Of several the shortest. It begins and ends with True; without any it is empty.
    """
    equal = np.concatenate([[0], np.cumsum(same)])
    over = equal - min_identity * np.arange(len(equal))  # a stretch has the share if this does not fall
    highest = np.maximum.accumulate(over[::-1])[::-1]  # from here on, so the last end that is high enough can be looked up
    end = np.searchsorted(-highest, -over + 1e-9, side="right") - 1
    matched = equal[end] - equal
    most = matched.max()
    if not most:
        return 0, 0
    hits = np.flatnonzero(same)
    begin = np.searchsorted(hits, np.flatnonzero(matched == most))  # in ``hits``, of every best stretch
    size = hits[begin + most - 1] - hits[begin]
    first = begin[np.argmin(size)]
    return int(hits[first]), int(hits[first + most - 1]) + 1


def verify(pairs: DataFrame, min_matched: int, min_share: float, min_identity: float) -> DataFrame:
    """Best stretch of each pair (doc_id, text, item, item_text, diagonals) that is long enough."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch], "text"):
                doc_words, doc_first = block_words(block)
                whole = list(blocks([block.rows], "item_text", limit=1 << 40))[0]
                item_words, item_first = block_words(whole)
                found = []
                for i, diagonals in enumerate(block.rows.column("diagonals").to_pylist()):
                    doc = doc_words[doc_first[i] : doc_first[i + 1]]
                    item = item_words[item_first[i] : item_first[i + 1]]
                    best = (0, 0, 0)
                    for d in sorted(diagonals):
                        low, high = max(0, -d), min(len(item), len(doc) - d)
                        same = item[low:high] == doc[low + d : high + d]
                        begin, end = best_stretch(same, min_identity)
                        matched = int(same[begin:end].sum())
                        if matched > best[0]:
                            best = (matched, end - begin, low + begin + d)
                    if best[0] >= needed(len(item), min_matched, min_share):
                        found.append((i, len(item), *best))
                if found:
                    at, size, matched, aligned, start = (list(x) for x in zip(*found, strict=True))
                    rows = block.rows.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("doc_id"),
                            rows.column("text_hash"),
                            rows.column("item"),
                            *[pa.array(x, pa.int64()) for x in (size, matched, aligned, start)],
                        ],
                        names=["doc_id", "text_hash", "item_id", "item_words", "matched", "aligned", "at_word"],
                    )

    schema = T.StructType(
        [
            pairs.schema["doc_id"],
            pairs.schema["text_hash"],
            T.StructField("item_id", pairs.schema["item"].dataType),
            *[T.StructField(c, T.LongType()) for c in ("item_words", "matched", "aligned", "at_word")],
        ]
    )
    return pairs.mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_matched: int = MIN_MATCHED,
    min_share: float = MIN_SHARE,
    min_identity: float = MIN_IDENTITY,
) -> DataFrame:
    """Pairs of a document and an item found in it.

    doc_id, text_hash (of the document), item_id, item_words, matched, aligned (words of the stretch, equal
    or not), at_word (where it begins). A pair is found if at least ``min_matched`` words agree (for short items
    ``min_share`` of theirs, for those under 8 words all), and ``min_identity`` of the stretch.
    """
    items = (
        benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
        .groupBy("text")
        .agg(F.min("item").alias("item"))
    )
    items = stage(items.select("item", "text"), "items")
    seeds = stage(item_seeds(items), "item_seeds")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    used = tuple(ALL_MASKS[r["mask"]] for r in seeds.select("mask").distinct().orderBy("mask").collect())  # at most one row per mask
    hits = stage(document_hits(rows, hash_filter(seeds), used).withColumn("row", F.monotonically_increasing_id()), "hits")
    candidates = (
        hits.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("h"))
        .select("row", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
        .join(seeds, "seed")
        .select("row", "item", (F.col("place") - F.col("item_pos")).alias("diagonal"))
        .groupBy("row", "item")
        .agg(F.collect_set("diagonal").alias("diagonals"))
    )
    pairs = (
        candidates.join(hits.select("row", "doc_id", "text"), "row")
        .join(items.select(F.col("item").alias("_item"), F.col("text").alias("item_text")), F.col("item").eqNullSafe(F.col("_item")))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "item", "item_text", "diagonals")
    )
    return verify(pairs, min_matched, min_share, min_identity)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which an item was found; all columns as they were, whatever their names."""
    found = find_contamination(docs, benchmark, id_col, text_col, **options)
    bad = stage(found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    own_id, own_text = number_of(docs, id_col), number_of(docs, text_col)
    same = (F.xxhash64(F.col(own_text)) == F.col("bad_hash")) & F.col(own_id).eqNullSafe(F.col("bad_id"))
    return numbered(docs).join(bad, same, "left_anti").toDF(*docs.columns)
