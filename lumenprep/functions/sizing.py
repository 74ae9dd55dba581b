"""Sizes as column arithmetic: pixel budgets, frame choice, run length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_plan(
    height: Column, width: Column, min_pixels: int, max_pixels: int, factor: int = 32
) -> tuple[Column, Column]:
    """Height and width as multiples of ``factor`` within a pixel budget.

    Sides are rounded to the nearest multiple (at least one); above the budget both
    shrink by the same ratio and round down, below it both grow and round up.
    """
    h, w, f = height.cast("double"), width.cast("double"), F.lit(float(factor))
    rounded_h = F.greatest(F.rint(h / f) * f, f)
    rounded_w = F.greatest(F.rint(w / f) * f, f)
    area = rounded_h * rounded_w
    shrink = F.sqrt(h * w / F.lit(float(max_pixels)))
    grow = F.sqrt(F.lit(float(min_pixels)) / (h * w))

    def side(length: Column, rounded: Column) -> Column:
        down = F.greatest(F.floor(length / shrink / f) * f, f)
        up = F.ceil(length * grow / f) * f
        return (
            F.when(area > max_pixels, down).when(area < min_pixels, up).otherwise(rounded)
        ).cast("int")

    return side(h, rounded_h), side(w, rounded_w)


def area_matched_size(
    height: Column, width: Column, target_h: Column, target_w: Column
) -> tuple[Column, Column]:
    """Size with the area of the target and the shape of the source, sides at least one."""
    area = height.cast("double") * width.cast("double")
    scale = F.sqrt(target_h.cast("double") * target_w.cast("double") / area)

    def side(length: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(length.cast("double") * scale).cast("int"))

    return side(height), side(width)


def all_frames(n_frames: Column) -> Column:
    """Indices of all frames; none for an empty video, NULL for one of unknown length."""
    n = n_frames.cast("bigint")
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).when(
        n <= 0, F.array().cast("array<bigint>")
    )


def frame_range(n_frames: Column, block: int = 1 << 20) -> tuple[Column, Column]:
    """How many frames ``all_frames`` lists, and the last one.

    Of more than ``block`` frames that many are listed at a time, since a row cannot hold the list of a
    long video. Without frames these are the number as given and one before it (0 and -1), and NULL if it
    is not known.
    """
    n, size, nothing = n_frames.cast("bigint"), F.lit(block).cast("bigint"), F.lit(0).cast("bigint")
    whole = all_frames(F.when(n <= size, n))

    def add(listed: Column, first: Column) -> Column:
        frames = all_frames(F.least(size, n - first))
        count = listed["count"] + F.size(frames)
        return F.struct(count.alias("count"), (first + F.element_at(frames, -1)).alias("last"))

    start = F.struct(nothing.alias("count"), nothing.alias("last"))
    listed = F.aggregate(F.sequence(nothing, n - 1, size), start, add)
    count = F.when(n > size, listed["count"]).when(n > 0, F.size(whole)).otherwise(n)
    last = F.when(n > size, listed["last"]).when(n > 0, F.element_at(whole, -1)).otherwise(n - 1)
    return count, last


def spread_frames(n_frames: Column, wanted: int) -> Column:
    """At most ``wanted`` frame indices, spread evenly; NULL for a video of unknown length."""
    n = n_frames.cast("bigint")
    k = F.least(n, F.lit(wanted).cast("bigint"))
    chosen = F.transform(
        F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.floor(i * n / k).cast("bigint")
    )
    return F.when(n > 0, chosen).when(n <= 0, F.array().cast("array<bigint>"))


def run_steps(
    n_samples: Column, per_device_batch: Column, devices: Column, accumulation: Column, epochs: Column
) -> Column:
    """Optimizer steps of a run: whole batches, whole accumulations, times epochs."""
    per_step = (per_device_batch * devices).cast("bigint")
    batches = F.call_function("div", n_samples.cast("bigint"), per_step)
    updates = F.call_function("div", batches, accumulation.cast("bigint"))
    return updates * epochs.cast("bigint")
