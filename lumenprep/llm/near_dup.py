"""Near copies by weighted MinHash (BagMinHash) of the multisets of word shingles.

Every shingle of a text has a weight, the number of times it stands there. Weights are cut into the intervals
[0,1), [1,2), [2,4), [4,8), ...; each interval of each shingle has a Poisson process of its own, whose rate is its length, and
whose points (time, height, component) depend on the shingle alone. A text sees the points below its weight; its
signature has the earliest time in each component. Two signatures agree in a component with a probability equal to the
weighted Jaccard similarity. Points are generated in the order of time and a process ends as soon as it is later
than all components found, so a signature costs little more than a point per shingle.

Equal texts are one text from the start. Bands of the signature are buckets. In a bucket the most central text (the one
with the most neighbours in all its buckets) is compared with the others by the exact multiset overlap, and texts that
are in one group with it are done with. The texts of buckets that still hold different groups meet through their rarest
shingles: near texts must have one in common so early, in the order of all shingles by frequency, that what comes after it is enough for the overlap
they need (a prefix filter, exact). Texts of a large group that differ from its others do so by rare shingles, so
outsiders of the group meet the few that share those and not the whole group, and once however many buckets
they share. So in the end no link between two texts of a bucket is missing, and a large group of copies costs a comparison each and not
one per pair. Groups are the connected components of the links.

Texts under five words are one shingle. Texts without words are near copies only of equal texts. NULL texts are empty.
A group's id is its smallest doc_id (NULL if it has none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.llm.columns import number_of, numbered
from lumenprep.llm.components import connected_components
from lumenprep.llm.words import Block, PrefixHash, blocks, mix64
from lumenprep.operators.staging import join_staged, stage, unstage

WORDS = 5
BANDS, ROWS = 24, 4
THRESHOLD = 0.8
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _nth(n: int) -> np.uint64:
    """A constant for the n-th of several draws."""
    return np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def shingles(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of a block, and the text it stands in."""
    starts, ends, first = block.words()
    h = PrefixHash(block.data).ranges(starts, ends)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    factors = mix64(np.arange(1, words + 1, dtype=np.uint64))
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    left = first[1:][text_of] - np.arange(len(h))  # words from here to the end of the text
    total = np.zeros(len(h), dtype=np.uint64)
    for j in range(words):
        total += np.where(left > j, padded[j : j + len(h)] * factors[j], np.uint64(0))
    opens = np.zeros(len(h), dtype=bool)
    opens[first[:-1][counts > 0]] = True
    fits = (left >= words) | opens
    size = np.minimum(left[fits], words).astype(np.uint64)
    return mix64(total[fits] + size * _GOLDEN), text_of[fits]


def weigh(h: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a block: shingle, text, number of times."""
    _, at, n = np.unique(mix64(h ^ mix64(text_of.astype(np.uint64) + _GOLDEN)), return_index=True, return_counts=True)
    return h[at], text_of[at], n


def signatures(h: np.ndarray, text_of: np.ndarray, weight: np.ndarray, texts: int, components: int) -> np.ndarray:
    """Earliest times (text, component); infinite for texts without shingles."""
    sig = np.full(texts * components, np.inf)
    if not len(h):
        return sig.reshape(texts, components)
    seeds, owners, lows, lengths, heights = [], [], [], [], []
    low, length, j = 0.0, 1.0, 0
    while True:
        of = np.flatnonzero(weight > low)
        if not len(of):
            break
        seeds.append(mix64(h[of] + _nth(j)))
        owners.append(text_of[of])
        lows.append(np.full(len(of), low))
        lengths.append(np.full(len(of), length))
        heights.append(weight[of].astype(np.float64))
        low = 1.0 if j == 0 else low * 2
        length, j = low, j + 1
    seed, owner, low_of, length_of, height = (np.concatenate(x) for x in (seeds, owners, lows, lengths, heights))
    time = np.zeros(len(seed))
    latest = np.full(texts, np.inf)
    step = 0
    while len(seed):
        step += 1
        draw = mix64(seed + _nth(step))
        time -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / length_of
        alive = time < latest[owner]
        if not alive.all():
            seed, owner, low_of, length_of, height, time, draw = (x[alive] for x in (seed, owner, low_of, length_of, height, time, draw))
        other = mix64(draw ^ _GOLDEN)
        component = ((other >> np.uint64(32)) * np.uint64(components)) >> np.uint64(32)
        level = low_of + length_of * ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        seen = level < height
        np.minimum.at(sig, owner[seen] * components + component[seen].astype(np.int64), time[seen])
        latest = sig.reshape(texts, components).max(axis=1)
        # The processes go on only where a later point can still matter.
        alive = time < latest[owner]
        if not alive.all():
            seed, owner, low_of, length_of, height, time = (x[alive] for x in (seed, owner, low_of, length_of, height, time))
    return sig.reshape(texts, components)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band (text, band)."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix64(key + bits[:, :, r] * _nth(2 * r + 1))
    return key


def text_id(text: Column) -> Column:
    """Identity of a text: equal for equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def distinct_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (tid, text) with each text once: of exact copies only the first of a batch gets a signature."""
    for batch in batches:
        codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        _, first = np.unique(codes, return_index=True)
        yield batch.take(pa.array(np.sort(first))) if len(first) < batch.num_rows else batch


def text_bands(texts: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """key, tid, size (number of shingles): a row per band of every text of ``texts`` (tid, text) that has words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(distinct_texts(batches), "text"):
            h, text_of = shingles(block, words)
            size = np.bincount(text_of, minlength=block.rows.num_rows)
            keys = band_keys(signatures(*weigh(h, text_of), block.rows.num_rows, bands * rows), bands, rows)
            some = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[some].ravel().view(np.int64)),
                    block.rows.column("tid").take(pa.array(np.repeat(some, bands))),
                    pa.array(np.repeat(size[some], bands).astype(np.int64)),
                ],
                names=["key", "tid", "size"],
            )

    return texts.mapInArrow(run, "key bigint, tid binary, size bigint")


def overlap(pairs: DataFrame, threshold: float, words: int) -> DataFrame:
    """a, b and near (whether their multisets overlap enough) of ``pairs`` (a, b, text_a, text_b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in blocks([batch], "text_a"):
                for block in blocks([one.rows], "text_b"):
                    n = block.rows.num_rows
                    sides = []
                    for side in ("text_a", "text_b"):
                        whole = next(blocks([block.rows], side, limit=1 << 40))
                        h, text_of = shingles(whole, words)
                        keys, at, count = np.unique(mix64(h ^ mix64(text_of.astype(np.uint64) + _GOLDEN)), return_index=True, return_counts=True)
                        sides.append((keys, text_of[at], count, np.bincount(text_of, minlength=n)))
                    (ka, ta, ca, na), (kb, _, cb, nb) = sides
                    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                    both = np.bincount(ta[ia], np.minimum(ca[ia], cb[ib]), minlength=n)
                    near = both >= threshold * (na + nb - both) - 1e-9
                    yield pa.RecordBatch.from_arrays([block.rows.column("a"), block.rows.column("b"), pa.array(near)], names=["a", "b", "near"])

    return pairs.mapInArrow(run, "a binary, b binary, near boolean")


def find_groups(rows: DataFrame, threshold: float, bands: int, band_rows: int, words: int) -> DataFrame:
    """Staged (tid, root) of the texts of ``rows`` (tid, text) that have near copies."""
    keyed = stage(text_bands(rows, bands, band_rows, words).distinct(), "bands")
    crowd = keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    shared = stage(keyed.join(crowd, "key"), "members")
    unstage(keyed)
    central = shared.groupBy("tid").agg(F.sum("_n").alias("central"))
    members = stage(shared.drop("_n").join(central, "tid"), "members")
    unstage(shared)
    # Texts that share a bucket, once each. An inner join, as a semi join would be moved before the grouping, and all copies of a text to one task.
    texts = stage(rows.groupBy("tid").agg(F.any_value("text").alias("text")).join(members.select("tid").distinct(), "tid"), "texts")
    by_centre = Window.partitionBy("key").orderBy(F.desc("central"), "tid")
    ranked = members.withColumn("_rank", F.row_number().over(by_centre)).where(F.col("_rank") == 1)
    first = stage(ranked.select("key", F.col("tid").alias("b"), F.col("size").alias("_size_b")), "pivots")
    met = (
        members.join(first, "key")
        .where((F.col("tid") != F.col("b")) & possible(F.col("size"), F.col("_size_b"), threshold))
        .select(F.least("tid", "b").alias("a"), F.greatest("tid", "b").alias("b"))
        .distinct()
    )
    groups = linked(None, met, texts, threshold, words)
    # Buckets whose texts are not all in one group yet.
    now = with_roots(members, groups)
    open_keys = now.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where(F.col("_low") != F.col("_high")).select("key")
    waiting = stage(now.join(open_keys, "key").select("tid", "size", "root").distinct(), "waiting")
    if waiting.limit(1).count():
        before, groups = groups, linked(groups, sharing(waiting, texts, threshold, words), texts, threshold, words)
        unstage(before)
    unstage(members, first, waiting, texts)
    return members.select("tid", F.col("tid").alias("root")).limit(0) if groups is None else groups


def with_roots(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``members`` with the ``root`` of their group, themselves if they have none."""
    if groups is None:
        return members.withColumn("root", F.col("tid"))
    return members.join(groups, "tid", "left").withColumn("root", F.coalesce("root", "tid"))


def linked(groups: DataFrame | None, pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame | None:
    """``groups`` joined by the links among ``pairs`` (a, b), which are compared by their texts."""
    wide = (
        pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    links = stage(overlap(wide, threshold, words).where("near").select("a", "b"), "links")
    edges = links if groups is None else links.unionByName(groups.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    out = connected_components(edges) if edges.limit(1).count() else None
    unstage(links)
    return out


def possible(size: Column, other: Column, threshold: float) -> Column:
    """Whether two texts of these sizes can be near."""
    return F.least(size, other) >= threshold * F.greatest(size, other) - 1e-9


def sharing(waiting: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Pairs (a, b) of ``waiting`` (tid, size, root) that can be near and have different roots: a prefix filter.

    The shingles of all texts are put in one order: those of a single root, which no pair needs, then the rarest first. If the first that two texts have in common has so
    many before it that what is left of either is less than the overlap they need, they are not near.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            h, text_of, n = weigh(*shingles(block, words))
            tids = block.rows.column("tid").take(pa.array(text_of))
            of = block.rows.column("of").take(pa.array(text_of))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), tids, of, pa.array(n)], names=["shingle", "tid", "of", "n"])

    named = texts.join(waiting.select("tid", F.xxhash64("root").alias("of")), "tid").select("tid", "of", "text")
    held = stage(named.mapInArrow(run, "shingle bigint, tid binary, of bigint, n bigint"), "shingles")
    counted = held.groupBy("shingle").agg(F.count("*").alias("_texts"), F.min("of").alias("_low"), F.max("of").alias("_high"))
    often = counted.where(F.col("_low") != F.col("_high")).select("shingle", "_texts")
    # From the end of the order: what is left of a text at each of its shingles, the most that can be in common from there on.
    onward = Window.partitionBy("tid").orderBy(F.desc("_texts"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    placed = held.select("shingle", "tid", "n").join(often, "shingle").withColumn("left", F.sum("n").over(onward)).join(waiting, "tid")
    early = stage(placed.where(F.col("left") >= threshold * F.col("size") - 1e-9).select("shingle", "tid", "root", "size", "left"), "early")
    share = threshold / (1 + threshold)  # of the sizes of two texts, what their overlap must have
    # No text with the shingle is smaller than this, nor is a near one.
    least = stage(early.groupBy("shingle").agg(F.min("size").alias("_smallest"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n"), "least")
    enough = F.col("left") >= share * (F.col("size") + F.greatest("_smallest", threshold * F.col("size"))) - 1e-9
    able = stage(join_staged(early, least, ["shingle"], spread="tid").where(enough).drop("_smallest"), "able")
    # Of two texts of different roots, one is not of the root that most texts with the shingle have.
    crowds = able.groupBy("shingle", "root").agg(F.count("*").alias("_n")).groupBy("shingle")
    most = crowds.agg(F.max_by("root", F.struct("_n", "root")).alias("_most"), F.count("*").alias("_roots")).where(F.col("_roots") > 1).drop("_roots")
    several = stage(join_staged(able, stage(most, "most"), ["shingle"], spread="tid"), "several")
    others = several.where(F.col("root") != F.col("_most")).select("shingle", *[F.col(c).alias(f"_{c}") for c in ("tid", "root", "size", "left")])
    need = share * (F.col("size") + F.col("_size")) - 1e-9
    pairs = several.join(others, "shingle").where((F.col("root") != F.col("_root")) & (F.least("left", "_left") >= need))
    found = stage(pairs.select(F.least("tid", "_tid").alias("a"), F.greatest("tid", "_tid").alias("b")).distinct(), "pairs")
    unstage(held, early, least, able, several)
    return found


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    band_rows: int = ROWS,
    words: int = WORDS,
) -> DataFrame:
    """One row per input row: doc_id, tid (identity of the text), class_id, keep_tid.

    ``class_id`` is the smallest id of the group, and ``keep_tid`` the text of that document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(F.col(text_col)).alias("tid"), F.coalesce(text_col, F.lit("")).alias("text"))
    groups = find_groups(rows.select("tid", "text"), threshold, bands, band_rows, words)
    narrow = join_staged(rows.select("doc_id", "tid"), groups, ["tid"], spread="doc_id", how="left").withColumn("root", F.coalesce("root", "tid"))
    # The smallest id that is not NULL comes first.
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tid"))
    firsts = narrow.groupBy("root").agg(least.alias("_first"))
    return narrow.join(firsts, "root").select(
        "doc_id", "tid", F.col("_first.doc_id").alias("class_id"), F.col("_first.tid").alias("keep_tid")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id. All columns as they were, whatever their names."""
    classes = near_copies(docs, id_col, text_col, **options)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("keep_tid")))
    kept = stage(kept.select(F.col("doc_id").alias("kept_id"), F.col("tid").alias("kept_tid")).distinct(), "kept")
    own_id, own_text = number_of(docs, id_col), number_of(docs, text_col)
    same = (F.col("tid") == F.col("kept_tid")) & F.col(own_id).eqNullSafe(F.col("kept_id"))
    joined = numbered(docs).withColumn("tid", text_id(F.col(own_text))).join(kept, same, "left_semi")
    return joined.dropDuplicates([own_id, "tid"]).drop("tid").toDF(*docs.columns)
