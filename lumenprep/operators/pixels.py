"""NumPy kernels on stacks of images, shape (n, height, width, channels), uint8, BGR order.

Small functions used inside Arrow batches; Spark partitions the images.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Luma weights in 15-bit fixed point, for blue, green and red.
GRAY_WEIGHTS = (3735, 19235, 9798)
GRAY_BITS = 15
RESIZE_BITS = 22
BLUR_BITS = 8

# Quantisation tables of the JPEG standard (annex K) at quality 50.
LUMA_TABLE = """
16 11 10 16  24  40  51  61
12 12 14 19  26  58  60  55
14 13 16 24  40  57  69  56
14 17 22 29  51  87  80  62
18 22 37 56  68 109 103  77
24 35 55 64  81 104 113  92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103  99
"""
CHROMA_TABLE = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""


# Nearest whole number, halves up; the small term keeps exact halves stable in floating point.
_HALF = 0.5 + 1e-9


def round_half_up(x: np.ndarray) -> np.ndarray:
    x = x + _HALF
    return np.floor(x, out=x)


def to_uint8(x: np.ndarray) -> np.ndarray:
    x = round_half_up(x)
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


def three_channels(stack: np.ndarray) -> np.ndarray:
    """Gray repeated, alpha dropped."""
    if stack.shape[-1] == 1:
        return np.repeat(stack, 3, axis=-1)
    return stack[..., :3]


def gray(stack: np.ndarray) -> np.ndarray:
    """Luma of each pixel, rounded to a whole number."""
    if stack.shape[-1] == 1:
        return stack[..., 0]
    blue, green, red = (stack[..., i].astype(np.int32) * w for i, w in enumerate(GRAY_WEIGHTS))
    return ((blue + green + red + (1 << (GRAY_BITS - 1))) >> GRAY_BITS).astype(np.uint8)


def _reflect(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """One pixel added on both sides of ``axes``, mirrored without repeating the edge."""
    for axis in axes:
        mode = "reflect" if x.shape[axis] > 1 else "edge"
        pads = [(1, 1) if a == axis else (0, 0) for a in range(x.ndim)]
        x = np.pad(x, pads, mode=mode)
    return x


def laplacian_variance(stack: np.ndarray) -> np.ndarray:
    """Blur estimate of each image: variance of the four-neighbour Laplacian of its luma."""
    p = _reflect(gray(stack).astype(np.int32), (1, 2))
    centre = p[:, 1:-1, 1:-1]
    edges = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * centre
    return edges.reshape(len(stack), -1).astype(np.float64).var(axis=1)


@lru_cache(maxsize=256)
def resize_taps(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Source positions and fixed-point weights (n_out, taps) of a triangle filter.

    When shrinking, the triangle widens with the ratio, so every source pixel counts.
    """
    ratio = n_in / n_out
    reach = max(ratio, 1.0)
    centre = (np.arange(n_out) + 0.5) * ratio
    first = np.maximum((centre - reach + 0.5).astype(np.int64), 0)
    last = np.minimum((centre + reach + 0.5).astype(np.int64), n_in)
    offsets = np.arange(int((last - first).max()))
    position = first[:, None] + offsets
    weight = np.maximum(1.0 - np.abs((position - centre[:, None] + 0.5) / reach), 0.0)
    weight[position >= last[:, None]] = 0.0
    weight /= weight.sum(axis=1, keepdims=True)
    fixed = np.floor(weight * (1 << RESIZE_BITS) + 0.5).astype(np.int32)
    return np.minimum(position, n_in - 1), fixed


def _resample(stack: np.ndarray, axis: int, n_out: int) -> np.ndarray:
    n_in = stack.shape[axis]
    if n_in == n_out:
        return stack
    position, weight = resize_taps(n_in, n_out)
    shape = [1] * stack.ndim
    shape[axis] = n_out
    total = np.full(stack.shape[:axis] + (n_out,) + stack.shape[axis + 1 :], 1 << (RESIZE_BITS - 1), np.int32)
    for tap in range(position.shape[1]):
        total += np.take(stack, position[:, tap], axis=axis) * weight[:, tap].reshape(shape)
    return np.clip(total >> RESIZE_BITS, 0, 255).astype(np.uint8)


def resize(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with antialiasing: across, then down."""
    return _resample(_resample(stack, 2, width), 1, height)


def blur_kernel(sigma: float) -> np.ndarray:
    """Gaussian weights in 8-bit fixed point that sum to one."""
    size = int(round(sigma * 6 + 1)) | 1
    x = np.arange(size) - size // 2
    weights = np.exp(-(x**2) / (2.0 * sigma * sigma))
    fixed = np.floor(weights / weights.sum() * (1 << BLUR_BITS) + 0.5).astype(np.int32)
    fixed[size // 2] += (1 << BLUR_BITS) - fixed.sum()
    return fixed


def gaussian_blur(stack: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur with mirrored edges."""
    kernel = blur_kernel(sigma)
    x = stack.astype(np.int32)
    for axis in (2, 1):
        padded = x
        for _ in range(len(kernel) // 2):
            padded = _reflect(padded, (axis,))
        n = x.shape[axis]
        shifted = (padded[:, :, i : i + n] if axis == 2 else padded[:, i : i + n] for i in range(len(kernel)))
        x = sum(k * part for k, part in zip(kernel, shifted))
    half = 1 << (2 * BLUR_BITS - 1)
    return ((x + half) >> (2 * BLUR_BITS)).astype(np.uint8)


NOISE_PRIME = 2**31 - 1
NOISE_STEP = 1_103_515_245
NOISE_UNIT = 1024


def noise_scale(sigma: int) -> int:
    """What the sum of four uniform numbers is multiplied by, in units of 1/NOISE_UNIT."""
    return round(sigma * 3**0.5 * NOISE_UNIT)


def noise_levels(n: int, sigma: int, seed: int) -> np.ndarray:
    """Nearly Gaussian whole numbers for ``n`` bytes of an image.

    The sum of four uniform numbers, each the square of the one before modulo a prime; the
    first follows from the seed and the place of the byte. Whole numbers throughout, so every
    engine gets the same noise.
    """
    x = (seed % NOISE_PRIME + np.arange(n, dtype=np.int64) * NOISE_STEP) % NOISE_PRIME
    total = np.zeros(n, np.int64)
    for i in range(4):
        x = (x + i) * (x + i) % NOISE_PRIME
        total += x
    unit = NOISE_PRIME * NOISE_UNIT
    return ((total - 2 * NOISE_PRIME) * noise_scale(sigma) + unit // 2) // unit


def add_noise(image: np.ndarray, sigma: int, seed: int, channels: str = "all") -> np.ndarray:
    """Gaussian noise on one image, saturated."""
    if sigma <= 0:
        return image
    noise = noise_levels(image.size, sigma, int(seed)).reshape(image.shape)
    if channels == "first" and image.shape[-1] > 1:
        noise[..., [c for c in range(image.shape[-1]) if c != 2]] = 0  # red only, in BGR order
    return np.clip(image.astype(np.int16) + noise.astype(np.int16), 0, 255).astype(np.uint8)


def quantisation_tables(quality: np.ndarray, base: str) -> np.ndarray:
    """Tables (n, 8, 8) for the given qualities."""
    q = np.asarray(quality, np.int64)
    scale = np.where(q < 50, 5000 // np.maximum(q, 1), 200 - 2 * q)
    table = np.array(base.split(), np.int64).reshape(8, 8)
    return np.clip((table * scale[:, None, None] + 50) // 100, 1, 255).astype(np.float64)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2.0)
    return basis


def _both_axes(blocks: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``matrix @ block @ matrix.T`` for all 8x8 blocks, as two large products."""
    for _ in range(2):
        blocks = (blocks.reshape(-1, 8) @ matrix.T).reshape(-1, 8, 8).transpose(0, 2, 1)
    return blocks


def _quantise_plane(plane: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Planes (n, h, w), sides multiples of 8, after quantising their 8x8 cosine blocks."""
    n, h, w = plane.shape
    blocks = plane.reshape(n, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4) - 128.0
    steps = _both_axes(blocks, _cosines()).reshape(n, -1, 8, 8)
    tables = tables[:, None]
    steps /= tables
    steps = np.copysign(round_half_up(np.abs(steps)), steps)
    steps *= tables
    back = to_uint8(_both_axes(steps, _cosines().T) + 128.0).reshape(n, h // 8, w // 8, 8, 8)
    return back.transpose(0, 1, 3, 2, 4).reshape(n, h, w)


# Colour transform of JPEG files, for red, green and blue, in 16-bit fixed point.
COLOUR_BITS = 16
LUMA = (19595, 38470, 7471)
CHROMA_BLUE = (-11059, -21709, 32768)
CHROMA_RED = (32768, -27439, -5329)
RED_FROM_RED = 91881
GREEN_FROM_BLUE = -22554
GREEN_FROM_RED = -46802
BLUE_FROM_BLUE = 116130


def to_ycc(stack: np.ndarray) -> list[np.ndarray]:
    """Luma, blue and red chroma of BGR pixels, as whole numbers in 0..255."""
    blue, green, red = (stack[..., i].astype(np.int32) for i in range(3))
    half = 1 << (COLOUR_BITS - 1)
    centre = (128 << COLOUR_BITS) + half - 1
    return [
        (r * red + g * green + b * blue + offset) >> COLOUR_BITS
        for (r, g, b), offset in ((LUMA, half), (CHROMA_BLUE, centre), (CHROMA_RED, centre))
    ]


def to_bgr(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << (COLOUR_BITS - 1)
    out = np.empty((*y.shape, 3), np.uint8)
    shifts = (BLUE_FROM_BLUE * cb, GREEN_FROM_BLUE * cb + GREEN_FROM_RED * cr, RED_FROM_RED * cr)
    for i, shift in enumerate(shifts):
        out[..., i] = np.clip(y + ((shift + half) >> COLOUR_BITS), 0, 255)
    return out


def _halve(plane: np.ndarray) -> np.ndarray:
    """Mean of 2x2 pixels; halves go down and up in alternate columns."""
    p = plane.astype(np.int32)
    total = p[:, ::2, ::2] + p[:, 1::2, ::2] + p[:, ::2, 1::2] + p[:, 1::2, 1::2]
    return (total + 1 + np.arange(total.shape[2]) % 2) >> 2


def _double(plane: np.ndarray) -> np.ndarray:
    """Twice the size: each pixel three parts its own, one part its neighbour, both ways."""
    p = plane.astype(np.int32)
    up = np.concatenate([p[:, :1], p[:, :-1]], axis=1)
    down = np.concatenate([p[:, 1:], p[:, -1:]], axis=1)
    rows = np.stack([3 * p + up, 3 * p + down], axis=2).reshape(len(p), -1, p.shape[2])
    left = np.concatenate([rows[:, :, :1], rows[:, :, :-1]], axis=2)
    right = np.concatenate([rows[:, :, 1:], rows[:, :, -1:]], axis=2)
    both = np.stack([(3 * rows + left + 8) >> 4, (3 * rows + right + 7) >> 4], axis=3)
    return both.reshape(len(p), rows.shape[1], -1)


def recompress(stack: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Three-channel images as they come out of JPEG compression at each quality.

    Colour transform, halved chroma, 8x8 cosine transform and quantisation; the entropy
    coding after it loses nothing and is left out. A gray image has luma only.
    """
    n, h, w, channels = stack.shape
    luma = quantisation_tables(quality, LUMA_TABLE)
    if channels == 1:
        padded = np.pad(stack[..., 0], ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge")
        return three_channels(_quantise_plane(padded, luma)[:, :h, :w, None])
    chroma = quantisation_tables(quality, CHROMA_TABLE)
    padded = np.pad(stack[..., :3], ((0, 0), (0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    y, cb, cr = to_ycc(padded)
    y = _quantise_plane(y, luma)
    cb, cr = (_double(_quantise_plane(_halve(p), chroma)) for p in (cb, cr))
    return to_bgr(y, cb, cr)[:, :h, :w]
