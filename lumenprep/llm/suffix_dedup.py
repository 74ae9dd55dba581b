"""Remove long passages that stand more than once anywhere in the corpus, byte by byte.

A byte goes if some string of ``length`` bytes covers it that also starts elsewhere, in the same text or another.

Suffixes are sorted only where repeats can be. Of all 64-byte grams inside a window of ``length`` bytes, the one with
the smallest hash is the window's anchor; equal windows have equal anchors, at the same place. So windows that are
equal meet in the group of one anchor, and grams that anchor a single window drop out. Within the groups:

- the suffixes that begin at the anchors are sorted, which gives an interval per group, the common prefixes of
  neighbours, and for each suffix the bytes that stand before it (the Burrows-Wheeler transform, and the bytes before);
- intervals are extended backwards breadth first, by one byte per level: an interval splits into those of its suffixes
  that have the same byte before them. After ``o`` levels, suffixes of an interval agree on ``o`` bytes before
  the anchor, and on as many after it as neighbours in the interval have in common (a range minimum);
- a window that starts ``o`` before its anchor is repeated as soon as both reach ``length`` together; levels stop at the
  longest offset a window can have, so no longer common prefix is ever derived.

All groups of a block advance together, level by level, in numpy arrays. Equal surroundings of an anchor count once,
so many copies of a passage are one suffix. A group of more than ``group_limit`` different surroundings is not gathered
in a task; its windows are hashed and counted by Spark instead, with the same result.

Texts that stand several times as a whole are repeated throughout (from ``length`` bytes on). NULL texts are empty; empty and
short texts are kept. Strings are judged on the input, never on what is left. Repeated rows with the same id are texts
that stand twice. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.words import Block, PrefixHash, blocks, mix64
from lumenprep.operators.staging import join_staged, stage, unstage

LENGTH = 400
GRAM = 64
GROUP_LIMIT = 80_000  # surroundings of one anchor in a task: 736 bytes each, at most about 56 MiB
BLOCK_ROWS = 8_000
_PLACE = np.uint64(0xFFFFFFFF)


def anchors(block: Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, PrefixHash]:
    """Bytes at which the anchors of all windows of a block begin, the hashes of their grams, and the prefix hash."""
    prefix = PrefixHash(block.data)
    grams = prefix.grams(gram)
    width = length - gram + 1
    n = len(block.data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    # 32 bits of the hash, then the place: the minimum is the leftmost of the smallest.
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(ranked)] = ranked
    runs = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(runs, axis=1).ravel()
    back = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for end in block.offsets[1:]:
        inside[max(0, end - length + 1) : end] = False
    places = lowest[inside]
    places = places[np.append(True, places[1:] != places[:-1])] if len(places) else places
    return places, grams[places], prefix


def find_spots(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per anchor of ``texts`` (doc_id, text_hash, text): doc_id, text_hash, pos, anchor, ctx, before, after.

    ``before`` and ``after`` are the bytes of the text around ``pos`` that windows with this anchor can reach;
    ``ctx`` is a hash of them all.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            at, anchor, prefix = anchors(block, length, gram)
            row = np.searchsorted(block.offsets, at, side="right") - 1
            before = np.minimum(at - block.offsets[row], length - gram)
            after = np.minimum(block.offsets[row + 1] - at, length)
            ctx = mix64(prefix.ranges(at - before, at + after) ^ mix64((before * (length + 1) + after).astype(np.uint64)))
            rows = block.rows.select(["doc_id", "text_hash"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array((at - block.offsets[row]).astype(np.int64)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(ctx.view(np.int64)),
                    pa.array(before.astype(np.int32)),
                    pa.array(after.astype(np.int32)),
                ],
                names=["doc_id", "text_hash", "pos", "anchor", "ctx", "before", "after"],
            )

    schema = T.StructType(
        [
            *texts.select("doc_id", "text_hash").schema.fields,
            *[T.StructField(c, T.LongType()) for c in ("pos", "anchor", "ctx")],
            *[T.StructField(c, T.IntegerType()) for c in ("before", "after")],
        ]
    )
    return texts.mapInArrow(run, schema)


def cut_surroundings(wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, ctx, and the bytes before (nearest first) and after, of ``wanted`` (text, spots of anchor, ctx, pos)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            spots = block.rows.column("spots")
            sizes = np.diff(spots.offsets.to_numpy())
            flat = spots.flatten()
            pos = flat.field("pos").to_numpy()
            start = np.repeat(block.offsets[:-1], sizes)
            end = np.repeat(block.offsets[1:], sizes)
            text = block.data.tobytes()
            at = start + pos
            low, high = np.maximum(start, at - (length - gram)), np.minimum(end, at + length)
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("anchor"),
                    flat.field("ctx"),
                    pa.array([text[a:b][::-1] for a, b in zip(low, at, strict=True)], pa.binary()),
                    pa.array([text[a:b] for a, b in zip(at, high, strict=True)], pa.binary()),
                ],
                names=["anchor", "ctx", "left", "right"],
            )

    return wanted.mapInArrow(run, "anchor bigint, ctx bigint, left binary, right binary")


def byte_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column as rows of ``width`` bytes, filled with 0xFF (in no UTF-8 text), and their lengths."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.diff(bounds)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    out = np.full((len(size), width), 255, dtype=np.uint8)
    out[np.arange(width) < size[:, None]] = data[bounds[0] : bounds[-1]]
    return out, size


class RangeMinimum:
    """Minimum of any range of an array, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (1 << (len(self.rows) - 1)) <= len(values):
            half = 1 << (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of [low, high); every range has at least one value."""
        level = np.floor(np.log2(high - low)).astype(np.int64)
        out = np.empty(len(low), dtype=self.rows[0].dtype)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.rows[k][low[of]], self.rows[k][high[of] - (1 << k)])
        return out


def repeated_offsets(group: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset before the anchor at which each row's window is also another row's; -1 if none.

    ``group`` is the anchor of each row, ``left`` its bytes before the anchor, nearest first, ``right`` those from it on.
    """
    n = len(group)
    low, high = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return low, high
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), right], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    suffix = right[order]
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    common = np.minimum(common, np.minimum(right_size[order][1:], right_size[order][:-1]))
    lcp = np.concatenate([[0], common]).astype(np.int32)
    minimum = RangeMinimum(lcp)
    bwt, reach = left[order], left_size[order]
    rank = np.arange(n)  # of the rows still in intervals of two or more, in the order of their intervals
    interval = np.cumsum(np.append(True, group[order][1:] != group[order][:-1]))
    found_low, found_high = np.full(n, -1), np.full(n, -1)
    changed = True
    for offset in range(left.shape[1] + 1):
        if len(rank) < 2:
            break
        if changed:
            same = interval[1:] == interval[:-1]
            alone = ~(np.append(False, same) | np.append(same, False))
            rank, interval = rank[~alone], interval[~alone]
            if len(rank) < 2:
                break
            same = interval[1:] == interval[:-1]
            near = np.zeros(len(rank) + 1, dtype=np.int32)
            pairs = np.flatnonzero(same)
            near[pairs + 1] = minimum.between(rank[pairs] + 1, rank[pairs + 1] + 1)
            agree = np.maximum(near[:-1], near[1:])
        valid = rank[agree + offset >= length]
        found_low[valid[found_low[valid] < 0]] = offset
        found_high[valid] = offset
        if offset == left.shape[1]:
            break
        # The next level: by the byte before; a text that begins here goes no further.
        on = reach[rank] > offset
        byte = bwt[rank, offset].astype(np.int64)
        changed = not on.all() or bool(((byte[1:] != byte[:-1]) & (interval[1:] == interval[:-1])).any())
        if changed:
            rank, interval, byte = rank[on], interval[on], byte[on]
            key = interval * 256 + byte
            again = np.argsort(key, kind="stable")
            rank, key = rank[again], key[again]
            interval = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(key) else key
    low[order], high[order] = found_low, found_high
    return low, high


def expand_groups(surroundings: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, ctx, low, high of surroundings that have a repeated window; each task handles whole groups, in blocks."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        anchor, ctx = (rows.column(c).to_numpy() for c in ("anchor", "ctx"))
        # A row that reached this task twice counts once.
        order = np.lexsort((ctx, anchor))
        keep = order[np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (ctx[order][1:] != ctx[order][:-1]))]
        part = rows.take(pa.array(keep)).combine_chunks()
        left, left_size = byte_matrix(part.column("left").chunk(0), length - gram)
        right, right_size = byte_matrix(part.column("right").chunk(0), length)
        low, high = repeated_offsets(anchor[keep].view(np.uint64), left, left_size, right, right_size, length)
        some = np.flatnonzero(low >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[keep][some]), pa.array(ctx[keep][some]), pa.array(low[some].astype(np.int32)), pa.array(high[some].astype(np.int32))],
            names=["anchor", "ctx", "low", "high"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(i, BLOCK_ROWS)
                held.append(piece)
                size += piece.num_rows
                if size >= BLOCK_ROWS:
                    table = pa.Table.from_batches(held)
                    keys = table.column("anchor").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                    if cut:
                        yield solve(table.slice(0, cut))
                        held, size = table.slice(cut).combine_chunks().to_batches(), len(keys) - cut
        if size:
            yield solve(pa.Table.from_batches(held))

    return surroundings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor bigint, ctx bigint, low int, high int")


def count_windows(surroundings: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for groups of any size: every window is hashed, and hashes are counted with partial aggregation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                anchor, ctx = (part.column(c).to_numpy() for c in ("anchor", "ctx"))
                for row, (left, right) in enumerate(zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True)):
                    data = np.frombuffer(left[::-1] + right, np.uint8)
                    windows = PrefixHash(data).grams(length)
                    offset = len(left) - np.arange(len(windows))
                    fits = (offset >= 0) & (offset <= length - gram)
                    m = int(fits.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, anchor[row])), pa.array(np.full(m, ctx[row])), pa.array(offset[fits].astype(np.int32)), pa.array(windows[fits].view(np.int64))],
                        names=["anchor", "ctx", "offset", "window"],
                    )

    windows = surroundings.mapInArrow(run, "anchor bigint, ctx bigint, offset int, window bigint").distinct()
    several = windows.groupBy("anchor", "offset", "window").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    return windows.join(several, ["anchor", "offset", "window"]).groupBy("anchor", "ctx").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))


def find_repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Staged table of texts with repeats, of ``rows`` (doc_id, text_hash, text): whole, spans (start, end; may overlap).

    A row of the input is known by its doc_id and the hash of its text.
    """
    spots = stage(find_spots(rows, length, gram), "spots")
    # Most anchors stand once in the corpus; only the others go on.
    several = stage(spots.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"), "several")
    every = spots
    spots = stage(join_staged(every, several, ["anchor"], spread="doc_id"), "spots")
    unstage(every, several)
    kinds = spots.groupBy("anchor", "ctx", "before", "after").agg(
        F.count("*").alias("n"), F.min(F.struct("text_hash", "pos", "doc_id")).alias("one")
    )
    counted = stage(kinds, "kinds")
    crowded = stage(counted.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1), "crowded")
    met = join_staged(counted, crowded, ["anchor"], spread="ctx", how="left")
    kinds = stage(met.withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("bigint"))), "kinds")
    unstage(counted, crowded)
    wanted = (
        kinds.where(F.col("kinds") > 1)
        .groupBy(F.col("one.text_hash").alias("_hash"), F.col("one.doc_id").alias("_id"))
        .agg(F.collect_list(F.struct("anchor", "ctx", F.col("one.pos").alias("pos"), (F.col("kinds") > group_limit).alias("large"))).alias("spots"))
    )
    texts = rows.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    of = lambda large: texts.select("text", F.filter("spots", lambda s: s["large"] == large).alias("spots")).where(F.size("spots") > 0)
    expanded = expand_groups(cut_surroundings(of(False), length, gram), length, gram)
    if kinds.where(F.col("kinds") > group_limit).limit(1).count():
        expanded = expanded.unionByName(count_windows(cut_surroundings(of(True), length, gram), length, gram))
    # Surroundings that stand more than once are repeated at every offset they have.
    equal = kinds.where(F.col("n") > 1).select("anchor", "ctx", F.greatest(F.lit(0), length - F.col("after")).alias("low"), F.col("before").alias("high")).where("low <= high")
    ranges = stage(expanded.unionByName(equal).groupBy("anchor", "ctx").agg(F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    spans = (
        join_staged(spots, ranges, ["anchor", "ctx"], spread="doc_id")
        .select("doc_id", "text_hash", F.struct((F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end")).alias("span"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("span").alias("spans"), F.lit(False).alias("whole"))
    )
    ids = stage(rows.where(F.octet_length("text") >= length).select("doc_id", "text_hash", F.unhex(F.md5("text")).alias("tid")), "ids")
    copies = ids.groupBy("tid").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("tid")
    none = F.array().cast(spans.schema["spans"].dataType)
    whole = join_staged(ids, stage(copies, "copies"), ["tid"], spread="doc_id").select("doc_id", "text_hash", none.alias("spans"), F.lit(True).alias("whole"))
    both = spans.unionByName(whole).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.max("whole").alias("whole"))
    return stage(both.select("doc_id", "text_hash", "whole", F.when(F.col("whole"), none).otherwise(F.col("spans")).alias("spans")), "repeats")


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(new[1:], True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of every removed run), kept (bytes that are left), one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    repeats = find_repeats(rows, length, gram, group_limit).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sizes = np.diff(block.offsets)
            whole = block.rows.column("whole").to_pylist()
            text, spans, kept = block.data.tobytes(), [], []
            for i, found in enumerate(block.rows.column("spans").to_pylist()):
                data = text[block.offsets[i] : block.offsets[i + 1]]
                if whole[i]:
                    found = [{"start": 0, "end": len(data)}]
                if not found:
                    spans.append([])
                    kept.append(data)
                    continue
                a, b = merge_spans(np.array([s["start"] for s in found]), np.array([s["end"] for s in found]))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(repeats, same, "left").select("doc_id", "text", "whole", "spans").mapInArrow(run, schema)
