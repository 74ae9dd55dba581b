"""Ranked lexical search: every document is scored for every item, and the best of each item are kept.

A term's weight and a document's impact of it are whole numbers, so scores are exact and the order is
total. The score of an item is a sum of impacts over its terms. For a tile of items and a tile
of documents that is a matrix product: rows of ones at an item's terms, times impacts by term and
document. The tile's vocabulary is compact: only the terms of its items, numbered anew. BLAS multiplies in
float64; a tile of terms is kept so small that no sum reaches 2^53, so every partial sum is exact, and
tiles of terms are added as 64-bit integers.

Of each tile a document stays if its score reaches the item's score at the cut so far; equal scores are told apart by id,
so a task holds ``limit`` documents an item and the tile at hand. What the tasks keep is ranked by Spark.

Documents are read once, and the counts of the items' terms in them written as a narrow table, from which
document frequencies and then scores follow. The items' vocabulary goes to every task; it is bounded, since
items are taken in blocks of about ``block_bytes`` of text, a pass over the documents for each.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.words import Block, PrefixHash, blocks
from lumenprep.operators.staging import stage

LIMIT = 50
BLOCK_BYTES = 8 << 20
TILE_CELLS = 1 << 18  # ones and zeros of a tile of items
TILE_TERMS = 2048
TILE_DOCS = 512
EXACT = 1 << 53
SALTS = 64
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def block_terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each term (letters and digits of ASCII, and all beyond ASCII), and the first term of each text."""
    full = np.append(_TERM[block.data], False)
    begins, ends = full.copy(), full.copy()
    apart = np.zeros(len(full), dtype=bool)
    apart[block.offsets] = True
    begins[1:] &= ~full[:-1] | apart[1:]
    ends[:-1] &= ~full[1:] | apart[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, block.offsets)


def term_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term with A-Z lower-cased, and the first term of each text."""
    starts, ends, first = block_terms(block)
    return PrefixHash(block.data, lower=True).ranges(starts, ends), first


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct item and term of ``items`` (item, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            terms, first = term_hashes(block)
            text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            yield pa.RecordBatch.from_arrays([block.rows.column("item").take(pa.array(text_of)), pa.array(terms.view(np.int64))], names=["item", "term"])

    schema = T.StructType([items.schema["item"], T.StructField("term", T.LongType())])
    return items.mapInArrow(run, schema).distinct()


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc, size (all terms), terms and times (numbers in the sorted ``vocabulary``, and how often) of documents (doc, text) with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for block in blocks(batches, "text"):
            terms, first = term_hashes(block)
            sizes = np.diff(first)
            spot = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            hit = np.flatnonzero(known[spot] == terms)
            text = np.searchsorted(first, hit, side="right") - 1
            cells, times = np.unique(text * len(known) + spot[hit], return_counts=True)
            rows = np.flatnonzero(sizes)
            bounds = np.append(np.searchsorted(cells, rows * len(known)), len(cells)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("doc").take(pa.array(rows)),
                    pa.array(sizes[rows].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array((cells % len(known)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int64))),
                ],
                names=["doc", "size", "terms", "times"],
            )

    schema = T.StructType(
        [
            docs.schema["doc"],
            T.StructField("size", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )
    return docs.mapInArrow(run, schema)


def frequencies(counts: DataFrame, n_terms: int) -> np.ndarray:
    """Documents with each term; then the number of documents, and of all their terms. Summed in the tasks, then by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, dtype=np.int64)
        for batch in batches:
            total[:n_terms] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
            total[n_terms] += batch.num_rows
            total[n_terms + 1] += batch.column("size").to_numpy().sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = counts.select("size", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_terms + 2, dtype=np.int64)
    total[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return total


@dataclass
class Tile:
    """Consecutive items, the terms they have, and a row of ones for each."""

    first: int
    vocabulary: np.ndarray
    ones: np.ndarray


def item_tiles(item: np.ndarray, term: np.ndarray, cells: int) -> list[Tile]:
    """Tiles of at most ``cells`` cells (or a single item) from pairs sorted by item, items numbered from 0."""
    tiles = []
    bounds = np.searchsorted(item, np.arange(item[-1] + 2))
    first = 0
    while first < len(bounds) - 1:
        last, vocabulary = first, set()
        while last < len(bounds) - 1:
            more = vocabulary.union(term[bounds[last] : bounds[last + 1]].tolist())
            if last > first and len(more) * (last + 1 - first) > cells:
                break
            last, vocabulary = last + 1, more
        compact = np.array(sorted(vocabulary), dtype=np.int64)
        part = slice(bounds[first], bounds[last])
        ones = np.zeros((last - first, len(compact)))
        ones[item[part] - first, np.searchsorted(compact, term[part])] = 1
        tiles.append(Tile(first, compact, ones))
        first = last
    return tiles


def impacts(weights: np.ndarray, size: np.ndarray, times: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whole-number impact of terms that occur ``times`` times in documents of ``size`` terms."""
    length = 50 + (50 * size * n) // total
    return weights * ((1_000_000_000 * times) // (1000 * times + 20 * length))


def tile_scores(tile: Tile, terms: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, tile_terms: int) -> np.ndarray:
    """Scores of the tile's items (rows) in ``n_docs`` documents, exactly."""
    spot = np.minimum(np.searchsorted(tile.vocabulary, terms), len(tile.vocabulary) - 1)
    held = np.flatnonzero(tile.vocabulary[spot] == terms)
    spot, doc, impact = spot[held], doc[held], impact[held]
    tile_terms = max(1, min(tile_terms, (EXACT - 1) // max(1, int(impact.max(initial=0)))))
    scores = np.zeros((len(tile.ones), n_docs), dtype=np.int64)
    for low in range(0, len(tile.vocabulary), tile_terms):
        part = np.flatnonzero((spot >= low) & (spot < low + tile_terms))
        dense = np.zeros((min(tile_terms, len(tile.vocabulary) - low), n_docs))
        dense[spot[part] - low, doc[part]] = impact[part]
        scores += (tile.ones[:, low : low + tile_terms] @ dense).astype(np.int64)
    return scores


def id_order(ids: pa.Array) -> list[np.ndarray]:
    """Keys by which ``ids`` are in ascending order, NULL first; the most important one first."""
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(ids.type):
        return [valid, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)]
    return [valid, np.array(ids.cast(pa.string()).fill_null("").to_pylist(), dtype=str)]


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, limit: int, ids: pa.DataType):
        self.limit = limit
        self.cut = np.ones(n_items, dtype=np.int64)  # scores below are out
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], ids))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        item, doc = np.nonzero(scores >= self.cut[first : first + len(scores), None])
        if len(item):
            self.waiting.append((item + first, scores[item, doc], ids.take(pa.array(doc))))
            self.n_waiting += len(item)
        if self.n_waiting > max(1 << 16, 2 * len(self.kept[0])):
            self.settle()

    def settle(self) -> tuple:
        item, score, ids = zip(self.kept, *self.waiting, strict=True)
        item, score, ids = np.concatenate(item), np.concatenate(score), pa.concat_arrays(ids)
        order = np.lexsort([*id_order(ids)[::-1], -score, item])
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[rank < self.limit], item[rank < self.limit]
        score = score[order]
        last = np.flatnonzero(rank[rank < self.limit] == self.limit - 1)
        self.cut[item[last]] = score[last]
        self.kept, self.waiting, self.n_waiting = (item, score, ids.take(pa.array(order))), [], 0
        return self.kept


def score_block(counts: DataFrame, terms: pa.Table, limit: int, n_terms: int, cells: int, tile_terms: int) -> DataFrame:
    """item, doc and score of the best documents of each task. ``terms`` has the item and the number of each of its terms."""
    total = frequencies(counts, n_terms)
    n, length = int(total[n_terms]), int(total[n_terms + 1])
    weights = np.array([int(1000 * log((2 * n + 2) / (2 * df + 1))) for df in total[:n_terms].tolist()], dtype=np.int64)
    names = terms.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    item = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(item, kind="stable")
    tiles = item_tiles(item[order], terms.column("term").to_numpy()[order], cells)
    shared = counts.sparkSession.sparkContext.broadcast((weights, tiles, names.dictionary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tiles, names = shared.value
        best = None
        for batch in batches:
            if best is None:
                best = Best(len(names), limit, batch.schema.field("doc").type)
            for row in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(row, TILE_DOCS)
                size, ids = part.column("size").to_numpy(), part.column("doc")
                terms, times = (part.column(c).flatten().to_numpy() for c in ("terms", "times"))
                doc = np.repeat(np.arange(len(size)), part.column("terms").value_lengths().to_numpy())
                impact = impacts(weights[terms], size[doc], times, n, length)
                for tile in tiles:
                    best.add(tile.first, tile_scores(tile, terms, doc, impact, len(size), tile_terms), ids)
        if best is not None:
            item, score, ids = best.settle()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), ids, pa.array(score)], names=["item", "doc", "score"])

    schema = T.StructType([T.StructField("item", T.StringType()), counts.schema["doc"], T.StructField("score", T.LongType())])
    return counts.mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    tile_cells: int = TILE_CELLS,
    tile_terms: int = TILE_TERMS,
) -> DataFrame:
    """The ``limit`` highest-scoring documents with a score above 0 for each item.

    item_id, rank (from 1), doc_id, score; equal scores by ascending document id, NULL ids first. With ``N`` documents that have a term,
    ``L`` their terms, ``df`` documents with a term and ``n`` terms in a document, a term that occurs ``tf`` times adds
    floor(1000 ln((2N+2)/(2df+1))) * ((10^9 tf) div (1000 tf + 20 m)), where m = 50 + (50 n N) div L.

    Item rows of one id (NULL too) are one item with the terms of all of them, each counted once. NULL texts have no
    terms; repeated documents are ranked one by one. Without items, documents or common terms there are no rows.
    Other columns are not read. Ids of documents are whole numbers or strings.
    """
    rows = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    item_type = rows.schema["item"].dataType
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n_blocks = ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes)
    named = rows.select(F.col("item").cast("string").alias("item"), "text")
    scored = []
    for block in range(n_blocks):
        some = named.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
        terms = item_terms(some).toArrow()
        if not terms.num_rows:
            continue
        vocabulary, number = np.unique(terms.column("term").to_numpy().view(np.uint64), return_inverse=True)
        numbered = pa.table({"item": terms.column("item"), "term": pa.array(number)})
        counts = stage(term_counts(texts, vocabulary), "term_counts")
        scored.append(score_block(counts, numbered, limit, len(vocabulary), tile_cells, tile_terms))
    if not scored:
        return rows.limit(0).select(
            F.col("item").alias("item_id"), F.lit(0).alias("rank"), F.lit(None).cast(texts.schema["doc"].dataType).alias("doc_id"), F.lit(0).cast("bigint").alias("score")
        )
    found = reduce(DataFrame.union, scored)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_first()]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).orderBy(*order)
    some = found.withColumn("part", F.row_number().over(salted)).where(F.col("part") <= limit)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= limit)
    return ranked.select(F.col("item").cast(item_type).alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
