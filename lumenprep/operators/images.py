"""Image operators: NumPy kernels over Arrow batches, plans and choices as columns."""

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.functions.draws import gate, hash52, pick
from lumenprep.operators import pixels
from lumenprep.operators.index import global_index
from lumenprep.operators.staging import stage
from lumenprep.plans.spec import DegradeParams
from lumenprep.sources.schema import IMAGE
from lumenprep.sources.sinks import decode_images, encode_images

# Profiles up to this many rows travel to the tasks as three arrays (20 bytes a row).
BROADCAST_PROFILE_ROWS = 200_000

STACK_BYTES = 1 << 21

# What a function returns leaves the task in pieces of about this many bytes, whatever the plan makes of a batch.
OUTPUT_BYTES = 64 << 20

Recompress = Callable[[np.ndarray, np.ndarray], np.ndarray]  # a stack of images and their qualities to a stack of three channels

MODES = {1: 0, 3: 16, 4: 24}  # OpenCV type codes of 8-bit images, as in Spark's image source


# --- Arrow <-> NumPy -------------------------------------------------------------------


def _views(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> list:
    """One (h, w, c) view per image, None where there is no image."""
    shapes = zip(height.to_pylist(), width.to_pylist(), channels.to_pylist(), data)
    return [
        np.frombuffer(d.as_buffer(), np.uint8, count=h * w * c).reshape(h, w, c)
        if d.is_valid and h and h > 0
        else None
        for h, w, c, d in shapes
    ]


def _by_shape(images: list, rows: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal shape, stacked: small images share one NumPy call.

    A stack holds at most STACK_BYTES (or one image), so the temporary arrays of a kernel
    stay small beside the Arrow batch.
    """
    groups: dict[tuple, list[int]] = {}
    for i in rows:
        if images[i] is not None:
            groups.setdefault(images[i].shape, []).append(i)
    for shape, members in groups.items():
        step = max(1, STACK_BYTES // max(1, math.prod(shape)))
        for start in range(0, len(members), step):
            part = members[start : start + step]
            yield np.array(part), np.stack([images[i] for i in part])


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Start and number of consecutive rows of at most ``limit`` bytes together; a larger row stands alone."""
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop - start
        start, before = stop, ends[stop - 1]


def _pack(images: list, origin: pa.Array) -> pa.StructArray:
    shape = [(None, None, None) if x is None else x.shape for x in images]
    h, w, c = (pa.array([s[i] for s in shape], pa.int32()) for i in range(3))
    mode = pa.array([None if s[2] is None else MODES[s[2]] for s in shape], pa.int32())
    data = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
    missing = pa.array([x is None for x in images], pa.bool_())
    return pa.StructArray.from_arrays(
        [origin.cast(pa.string()), h, w, c, mode, data],
        names=["origin", "height", "width", "nChannels", "mode", "data"],
        mask=missing,
    )


def _fields(images: pa.StructArray) -> list[pa.Array]:
    """Columns of an image struct, NULL where the struct is NULL."""
    return images.flatten()


def _image_views(images: pa.StructArray) -> list:
    _, h, w, c, _, data = _fields(images)
    return _views(h, w, c, data)


# --- single operators ------------------------------------------------------------------


def blur_estimate(image: Column) -> Column:
    """Variance of the Laplacian of an image: high where it is sharp, NULL without image."""

    @F.arrow_udf("double")
    def run(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
        images = _views(height, width, channels, data)
        out = np.full(len(images), np.nan)
        for rows, stack in _by_shape(images, range(len(images))):
            out[rows] = pixels.laplacian_variance(stack)
        return pa.array(out, mask=np.array([x is None for x in images], bool))

    return run(image["height"], image["width"], image["nChannels"], image["data"])


def _stackwise(images: pa.StructArray, kernel) -> pa.StructArray:
    views = _image_views(images)
    out = list(views)
    for rows, stack in _by_shape(views, range(len(views))):
        for i, result in zip(rows, kernel(stack, rows)):
            out[i] = result
    return _pack(out, _fields(images)[0])


def to_rgb(image: Column) -> Column:
    """Image with three channels: gray repeated, alpha dropped."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array) -> pa.Array:
        return _stackwise(images, lambda stack, rows: pixels.three_channels(stack))

    return run(image)


def gaussian_blur(image: Column, sigma: float) -> Column:
    """Gaussian blur with mirrored edges."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array) -> pa.Array:
        return _stackwise(images, lambda stack, rows: pixels.gaussian_blur(stack, sigma))

    return run(image)


def _shapes(images: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Height, width and channels, 0 without an image."""
    _, *shape, _, _ = _fields(images)
    return tuple(np.maximum(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0) for x in shape)


def resize_image(image: Column, height: Column, width: Column, output_bytes: int = OUTPUT_BYTES) -> Column:
    """Bilinear, antialiased resize to a size per row; the image itself where a size is NULL.

    The sizes say how much a batch will return, so it leaves in pieces of about ``output_bytes``, or a row.
    """

    @F.arrow_udf(IMAGE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for images, heights, widths in batches:
            yield from _resized(images, heights, widths, output_bytes)

    return run(image, height.cast("int"), width.cast("int"))


def _resized(images: pa.StructArray, heights: pa.Array, widths: pa.Array, limit: int) -> Iterator[pa.Array]:
    h, w, c = _shapes(images)
    given = heights.is_valid().to_numpy(zero_copy_only=False) & widths.is_valid().to_numpy(zero_copy_only=False) & (h * w > 0)
    h, w = (np.where(given, x.fill_null(0).to_numpy(zero_copy_only=False), own) for x, own in ((heights, h), (widths, w)))
    for start, n in pieces(h * w * c, limit):
        part = images.slice(start, n)
        out = [
            pixels.resize(x[None], int(h[i]), int(w[i]))[0] if given[i] else x
            for i, x in enumerate(_image_views(part), start)
        ]
        yield _pack(out, _fields(part)[0])


def recompress(image: Column, quality: Column) -> Column:
    """Three-channel image with the artefacts of JPEG at a quality per row."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array, qualities: pa.Array) -> pa.Array:
        q = qualities.to_numpy(zero_copy_only=False)
        return _stackwise(images, lambda stack, rows: pixels.recompress(stack, q[rows]))

    return run(image, quality.cast("int"))


def add_noise(image: Column, sigma: int, seed: Column, channels: str = "all") -> Column:
    """Gaussian noise from a seed per row."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array, seeds: pa.Array) -> pa.Array:
        views = _image_views(images)
        out = [
            x if x is None else pixels.add_noise(x, sigma, s, channels)
            for x, s in zip(views, seeds.to_pylist())
        ]
        return _pack(out, _fields(images)[0])

    return run(image, seed.cast("bigint"))


# --- profile of real images ------------------------------------------------------------


def _measured(df: DataFrame, key: str, real_label: int) -> DataFrame:
    real = df.where(F.col("label") == real_label).select(
        F.col(key).alias("_key"), F.posexplode("images").alias("_image", "image")
    )
    return real.select(
        "_key",
        "_image",
        blur_estimate(F.col("image")).alias("blur"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
    ).where("height > 0")


def sampled_profile(df: DataFrame, key: str, size: int, seed: int, real_label: int = 0) -> DataFrame:
    """A profile of at most ``size`` real images: those with the smallest seeded hashes, in their order, with ``hash``.

    An even sample whatever the number of images, and mergeable: see ``merge_profiles``. Keys are unique.
    """
    measured = _measured(df, key, real_label)
    hashed = measured.select(hash52(image_key(F.col("_key"), F.col("_image")), seed, "profile").alias("hash"), "blur", "height", "width")
    return _smallest(hashed, size)


def merge_profiles(profiles: Sequence[DataFrame], size: int) -> DataFrame:
    """The sample of all images from samples of their parts (of ``size`` or more, with one seed), as if they were drawn together."""
    if not profiles:
        raise ValueError("there is no profile to merge")
    columns = ("hash", "blur", "height", "width")
    return _smallest(reduce(DataFrame.union, [p.select(*columns) for p in profiles]), size)


def _smallest(hashed: DataFrame, size: int) -> DataFrame:
    # Each task keeps its own smallest ones; ``size`` rows meet in one, and only those are numbered.
    kept = stage(hashed.orderBy("hash", "blur", "height", "width").limit(size), "sample")
    order = Window.orderBy("hash", "blur", "height", "width")
    return kept.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).select("idx", "blur", "height", "width", "hash")


def real_profile(df: DataFrame, key: str, real_label: int = 0) -> DataFrame:
    """``idx``, ``blur``, ``height``, ``width`` of every real image, numbered from 0."""
    # Measured once; what is sorted afterwards are numbers.
    measured = stage(_measured(df, key, real_label), "profile")
    return global_index(measured, ["_key", "_image"], "idx").select("idx", "blur", "height", "width")


def profile_summary(profile: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row: size, range, mean and quantiles of blur and area."""
    area = F.col("height").cast("double") * F.col("width")
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    return profile.agg(
        F.count("*").alias("n_images"),
        F.min("blur").alias("min_blur"),
        F.max("blur").alias("max_blur"),
        F.avg("blur").alias("avg_blur"),
        F.percentile_approx("blur", shares, accuracy).alias("blur_quantiles"),
        F.avg(area).alias("avg_area"),
        F.percentile_approx(area, shares, accuracy).alias("area_quantiles"),
    )


# --- degradation -----------------------------------------------------------------------


def profile_size(profile: DataFrame) -> tuple[int, int]:
    """Number of resolutions and of blur values; they may differ."""
    row = profile.agg(
        F.count("height").alias("sizes"),
        F.count("blur").alias("blurs"),
        F.count("*").alias("n"),
        F.min("idx").alias("first"),
        F.max("idx").alias("last"),
        F.countDistinct("idx").alias("places"),
    ).first()
    if not row["sizes"] or not row["blurs"]:
        raise ValueError("the profile of real images is empty")
    if (row["first"], row["last"], row["places"]) != (0, row["n"] - 1, row["n"]):
        raise ValueError("the index of the profile must run from 0 without gaps or repeats")
    return row["sizes"], row["blurs"]


def draw_plan(key: Column, size: tuple[int, int], params: DegradeParams, seed: int) -> Column:
    """All random choices for one image, as a struct that can be stored and audited."""
    p = params.probability
    qualities = params.quality_to - params.quality_from
    return F.struct(
        gate(key, seed, "resize", p).alias("resize"),
        gate(key, seed, "blur", p).alias("blur"),
        gate(key, seed, "noise", p).alias("noise"),
        gate(key, seed, "jpeg", p).alias("jpeg"),
        pick(key, seed, "resolution", size[0]).alias("res_idx"),
        pick(key, seed, "target_blur", size[1]).alias("blur_idx"),
        (pick(key, seed, "quality", qualities) + params.quality_from).cast("int").alias("quality"),
        hash52(key, seed, "noise_seed").alias("noise_seed"),
    )


def image_key(key: Column, position: Column) -> Column:
    return F.concat_ws("#", key.cast("string"), position.cast("string"))


def plan_rows(
    df: DataFrame, key: str, n_images: Column, profile: DataFrame, params: DegradeParams, seed: int
) -> DataFrame:
    """One row per image: key, place in the row, choices and the targets they point to.

    The targets come by join on the profile's index, which is uniform, so no index is
    hot; a profile of any size works, and a small one is broadcast by its file size.
    """
    size = profile_size(profile)
    some = df.where(n_images > 0)
    images = some.select(key, F.explode(F.sequence(F.lit(0), n_images - 1)).alias("image_pos"))
    drawn = images.withColumn(
        "plan",
        draw_plan(image_key(F.col(key), F.col("image_pos")), size, params, seed),
    )
    sizes = profile.select(
        F.col("idx").alias("_res"), F.col("height").alias("target_h"), F.col("width").alias("target_w")
    )
    blurs = profile.select(F.col("idx").alias("_blur"), F.col("blur").alias("target_blur"))
    return (
        drawn.join(sizes, F.col("plan.res_idx") == F.col("_res"))
        .join(blurs, F.col("plan.blur_idx") == F.col("_blur"))
        .select(key, "image_pos", "plan", "target_h", "target_w", "target_blur")
    )


def planned_shapes(images: pa.StructArray, plan: dict[str, np.ndarray], targets: tuple) -> tuple[np.ndarray, ...]:
    """Height, width and bytes of each image after the chain, known before any pixel is touched."""
    h, w, c = _shapes(images)
    target_h, target_w, _ = targets
    resized = plan["resize"].astype(bool) & (h * w > 0)
    scale = np.sqrt(target_h.astype(np.float64) * target_w / np.maximum(h * w, 1))
    h, w = (np.where(resized, np.maximum(1, np.trunc(x * scale)), x).astype(np.int64) for x in (h, w))
    return h, w, h * w * np.where(plan["jpeg"].astype(bool), 3, c)


def _degrade_batch(
    images: list,
    plan: dict[str, np.ndarray],
    height: np.ndarray,
    width: np.ndarray,
    target_blur: np.ndarray,
    params: DegradeParams,
    recompress: Recompress,
) -> list:
    """The four stages in order, each on the images whose gate is open."""
    out = list(images)
    present = np.array([x is not None for x in images], bool)

    def chosen(stage: str) -> np.ndarray:
        return np.flatnonzero(plan[stage].astype(bool) & present)

    for i in chosen("resize"):
        out[i] = pixels.resize(out[i][None], int(height[i]), int(width[i]))[0]
    for rows, stack in _by_shape(out, chosen("blur")):
        sharp = pixels.laplacian_variance(stack) > params.blur_margin * target_blur[rows]
        if sharp.any():
            for i, result in zip(rows[sharp], pixels.gaussian_blur(stack[sharp], params.blur_sigma)):
                out[i] = result
    for i in chosen("noise"):
        out[i] = pixels.add_noise(
            out[i], params.noise_sigma, int(plan["noise_seed"][i]), params.noise_channels
        )
    for rows, stack in _by_shape(out, chosen("jpeg")):
        for i, result in zip(rows, recompress(stack, plan["quality"][rows])):
            out[i] = result
    return out


PLAN_FIELDS = ("resize", "blur", "noise", "jpeg", "quality", "noise_seed")


def _degrade_lists(
    images: pa.ListArray, plans: pa.ListArray, targets_of, params: DegradeParams, recompress: Recompress, limit: int
) -> Iterator[pa.Array]:
    """Degrade lists of images without exploding them: flat values, same offsets, cut by what the plan will return."""
    flat, flat_plan = images.flatten(), plans.flatten()
    names = [flat_plan.type.field(i).name for i in range(flat_plan.type.num_fields)]
    columns = dict(zip(names, flat_plan.flatten()))
    plan = {f: columns[f].to_numpy(zero_copy_only=False) for f in PLAN_FIELDS}
    targets = targets_of(columns)
    height, width, size = planned_shapes(flat, plan, targets)
    lengths = images.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    upto = np.concatenate([[0], np.cumsum(size)])
    for start, n in pieces(np.diff(upto[offsets]), limit):
        first, last = int(offsets[start]), int(offsets[start + n])
        here = slice(first, last)
        part = flat.slice(first, last - first)
        chosen = {k: v[here] for k, v in plan.items()}
        done = _degrade_batch(_image_views(part), chosen, height[here], width[here], targets[2][here], params, recompress)
        yield pa.ListArray.from_arrays(
            pa.array(offsets[start : start + n + 1] - first), _pack(done, _fields(part)[0]), mask=images.slice(start, n).is_null()
        )


def _degrade_udf(params: DegradeParams, lookup: Broadcast | None, recompress: Recompress, output_bytes: int):
    def targets_of(columns: dict) -> tuple:
        numbers = {k: v.to_numpy(zero_copy_only=False) for k, v in columns.items()}
        if lookup is None:
            return numbers["target_h"], numbers["target_w"], numbers["target_blur"]
        height, width, blur = lookup.value
        return height[numbers["res_idx"]], width[numbers["res_idx"]], blur[numbers["blur_idx"]]

    @F.arrow_udf(f"array<{IMAGE}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for images, plans in batches:
            yield from _degrade_lists(images, plans, targets_of, params, recompress, output_bytes)

    return run


def needs_degradation(degrade_eval: bool = False, fake_label: int = 1) -> Column:
    """Fake rows of flagged datasets with images; held-out rows only on request."""
    needed = (F.col("label") == fake_label) & F.col("degrade_fake") & (F.size("images") > 0)
    if not degrade_eval:
        needed = needed & F.coalesce(F.col("split") != "eval", F.lit(True))
    return F.coalesce(needed, F.lit(False))


def degrade(
    df: DataFrame,
    profile: DataFrame,
    params: DegradeParams,
    seed: int,
    key: str = "example_id",
    needed: Column | None = None,
    broadcast_rows: int = BROADCAST_PROFILE_ROWS,
    recompress: Recompress = pixels.recompress,
    output_bytes: int = OUTPUT_BYTES,
) -> DataFrame:
    """``df`` with each image of the needed rows degraded towards the profile.

    A Python function under ``when`` still runs for every row, so the rows that need
    nothing are passed to it as NULL and their pixels never leave the JVM. A profile
    above ``broadcast_rows`` is joined instead of sent to the tasks; the result is equal.
    ``recompress`` is the caller's lossy codec, for stacks of images of one shape. A batch leaves its task in
    pieces of about ``output_bytes`` of planned pixels, or of one row, however small its images were.
    """
    element = df.schema["images"].dataType.elementType
    if "data" not in element.fieldNames():
        raise ValueError("the images are encoded: use degrade_encoded with a decoder")
    needed = needs_degradation() if needed is None else needed
    profile = stage(profile.select("idx", "blur", "height", "width"), "profile")
    size = profile_size(profile)
    marked = df.withColumn("_needed", needed)
    if max(size) <= broadcast_rows:
        rows = profile.orderBy("idx").toArrow()
        arrays = tuple(rows[c].to_numpy() for c in ("height", "width", "blur"))
        run = _degrade_udf(params, df.sparkSession.sparkContext.broadcast(arrays), recompress, output_bytes)
        plans = F.transform(
            F.sequence(F.lit(0), F.size("images") - 1),
            lambda i: draw_plan(image_key(F.col(key), i), size, params, seed),
        )
    elif df.isStreaming:
        raise ValueError("the profile is too large to be sent to the tasks of a stream")
    else:
        run = _degrade_udf(params, None, recompress, output_bytes)
        per_image = plan_rows(
            marked.where("_needed"), key, F.size("images"), profile, params, seed
        )
        # One list per row of images, as long as the list of images of that row.
        item = F.struct("image_pos", "plan.*", "target_h", "target_w", "target_blur")
        lists = per_image.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_plans"))
        marked = marked.join(lists, key, "left")
        plans = F.col("_plans")
    done = run(F.when(F.col("_needed"), F.col("images")), F.when(F.col("_needed"), plans))
    return marked.withColumn("images", F.when(F.col("_needed"), done).otherwise(F.col("images"))).select(
        *df.columns
    )


def degrade_encoded(
    df: DataFrame,
    profile: DataFrame,
    params: DegradeParams,
    seed: int,
    decoder: Callable[[bytes], dict],
    encoder: Callable[[dict], bytes],
    key: str = "example_id",
    needed: Column | None = None,
    **options,
) -> DataFrame:
    """``degrade`` for images kept as file bytes, by way of the caller's codec.

    Only images that are degraded are decoded and encoded again; others keep their bytes. ``options`` are those of ``degrade``.
    """
    needed = needs_degradation() if needed is None else needed
    opened = df.withColumns({"_kept": F.col("images"), "_todo": needed}).withColumn(
        "images", decode_images(F.when(F.col("_todo"), F.col("_kept")), decoder)
    )
    done = degrade(opened, profile, params, seed, key, F.col("_todo"), **options)
    packed = encode_images(F.when(F.col("_todo"), F.col("images")), encoder)
    return done.withColumn(
        "images", F.when(F.col("_todo"), packed).otherwise(F.col("_kept"))
    ).select(*df.columns)
