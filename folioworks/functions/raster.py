"""Array kernels over single images. Gray images are uint8 arrays [y, x]; ink is 1, paper 0.

Kernels know nothing of Spark. Where the result depends on rounding, the precision of each
step is spelled out with explicit float32/float64 types.
"""

from __future__ import annotations

import numpy as np

f32 = np.float32

#: Operation codes as truth tables, bit (2 * source + destination).
RASTER_OPS = {"clear": 0x0, "notsrc": 0x3, "xor": 0x6, "and": 0x8, "src": 0xC, "or": 0xE, "set": 0xF}


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of an 8-bit RGB image: 16-bit channels, weights 19595, 38470, 7471, rounded."""
    wide = rgb.astype(np.int64) * 257
    return ((wide @ np.array([19595, 38470, 7471]) + (1 << 15)) >> 24).astype(np.uint8)


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(bool), axis=1).tobytes()


def unpack(data: bytes, width: int, height: int) -> np.ndarray:
    stride = (width + 7) // 8
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, stride), axis=1)[:, :width]


# -- thresholds --------------------------------------------------------------


def otsu_threshold(image: np.ndarray) -> int:
    """Level with the largest between-class variance, the smallest of equals; 0 for a flat image."""
    count = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(count), float(image.size)
    mass = np.cumsum(count * np.arange(256))
    above = total - below
    ok = (below > 0) & (above > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where(ok, below * above * (mass / below - (mass[-1] - mass) / above) ** 2, 0.0)
    return int(np.argmax(spread)) if spread.max(initial=0) > 0 else 0


def otsu(image: np.ndarray) -> np.ndarray:
    return (image <= otsu_threshold(image)).astype(np.uint8)


def check_window(window: int, width: int, height: int) -> int:
    half = (window - 1) // 2
    if half < 2 or half + 1 > min(width, height):
        raise ValueError(f"window {window} does not suit an image of {width} x {height}")
    return half


def sauvola(image: np.ndarray, window: int, k: float) -> np.ndarray:
    """Ink where darker than mean * (1 - k * (1 - deviation / 128)) of the mirrored window around."""
    half = check_window(window, image.shape[1], image.shape[0])
    side = 2 * half + 1
    padded = np.pad(image.astype(np.int64), half, mode="symmetric")

    def box(v: np.ndarray) -> np.ndarray:
        run = np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return run[side:, side:] - run[:-side, side:] - run[side:, :-side] + run[:-side, :-side]

    mean = (box(padded).astype(f32) * f32(1 / (side * side))).astype(np.int64)
    square = (1 / (side * side) * box(padded**2) + 0.5).astype(np.int64)
    deviation = np.sqrt(np.maximum(square - mean**2, 0).astype(float)).astype(f32).astype(float)
    level = np.trunc(mean * (1 - k * (1 - deviation / 128))).astype(np.int64)
    return (image < level).astype(np.uint8)


# -- raster algebra and rotation --------------------------------------------


def clip_rect(dst_size, src_size, rect, at, uses_src: bool):
    """(x, y, w, h, sx, sy) of a destination rectangle cut jointly with its source; w or h may be 0."""
    (dw, dh), (x, y, w, h) = dst_size, rect
    sx, sy = at
    lo_x, lo_y = max(0, -x), max(0, -y)
    hi_x, hi_y = min(w, dw - x), min(h, dh - y)
    if uses_src:
        lo_x, lo_y = max(lo_x, -sx), max(lo_y, -sy)
        hi_x, hi_y = min(hi_x, src_size[0] - sx), min(hi_y, src_size[1] - sy)
    return x + lo_x, y + lo_y, max(0, hi_x - lo_x), max(0, hi_y - lo_y), sx + lo_x, sy + lo_y


def raster_op(dst: np.ndarray, rect, op: str, src: np.ndarray | None = None, at=(0, 0), full: int = 1) -> np.ndarray:
    """dst with op done bitwise in a rectangle; full is 1 for ink, 255 for gray."""
    code = RASTER_OPS[op]
    uses = op not in ("clear", "set")
    size = (src.shape[1], src.shape[0]) if uses else (0, 0)
    x, y, w, h, sx, sy = clip_rect((dst.shape[1], dst.shape[0]), size, rect, at, uses)
    out = dst.copy()
    d = dst[y : y + h, x : x + w]
    s = src[sy : sy + h, sx : sx + w] if uses else np.zeros_like(d)
    new = np.zeros_like(d)
    for bit in range(4):
        if code >> bit & 1:
            new |= (s if bit & 2 else ~s) & (d if bit & 1 else ~d)
    out[y : y + h, x : x + w] = new & full
    return out


def rotate(bits: np.ndarray, radians: float) -> np.ndarray:
    """Turned clockwise about the centre; every pixel takes the source pixel it truncates to."""
    h, w = bits.shape
    angle = f32(radians)
    s, c = float(f32(np.sin(float(angle)))), float(f32(np.cos(float(angle))))
    cx, cy = w // 2, h // 2
    dy, dx = (cy - np.arange(h))[:, None].astype(float), (cx - np.arange(w))[None].astype(float)
    x = cx + np.trunc((-dx * c - dy * s).astype(f32)).astype(int)
    y = cy + np.trunc((-dy * c + dx * s).astype(f32)).astype(int)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return np.where(inside, bits[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 0).astype(np.uint8)


# -- scaling -----------------------------------------------------------------


def scaled_size(scale: f32, n: int) -> int:
    return int(float(f32(scale) * f32(n)) + 0.5)


def enlarge(image: np.ndarray, k: int) -> np.ndarray:
    """Exactly 2 or 4 times: bilinear weights in k-ths over the pixel, its right, lower and diagonal neighbours."""
    p = np.pad(image.astype(np.int64), ((0, 1), (0, 1)), mode="edge")
    h, w = image.shape
    out = np.empty((k * h, k * w), np.uint8)
    for b in range(k):
        for a in range(k):
            v = (k - a) * (k - b) * p[:-1, :-1] + a * (k - b) * p[:-1, 1:] + (k - a) * b * p[1:, :-1] + a * b * p[1:, 1:]
            out[b::k, a::k] = v // (k * k)
    return out


def interpolate(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear in sixteenths of a pixel."""
    h, w = image.shape

    def grid(n_src: int, n: int):
        at = (f32(16 * n_src) / f32(n) * np.arange(n, dtype=f32)).astype(np.int64)
        return at >> 4, np.minimum((at >> 4) + 1, n_src - 1), at & 15

    (x, x1, fx), (y, y1, fy) = grid(w, width), grid(h, height)
    v, fy = image.astype(np.int64), fy[:, None]
    top = (16 - fx) * v[y][:, x] + fx * v[y][:, x1]
    low = (16 - fx) * v[y1][:, x] + fx * v[y1][:, x1]
    return (((16 - fy) * top + fy * low + 128) // 256).astype(np.uint8)


def halve(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[0] // 2, image.shape[1] // 2
    return (image[: 2 * h, : 2 * w].astype(np.int64).reshape(h, 2, w, 2).sum((1, 3)) >> 2).astype(np.uint8)


def area_average(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Weighted by the sixteenths of source pixels that a pixel covers; near the far edges the source pixel itself."""

    def cover(n_src: int, n: int):
        step = f32(16 * n_src) / f32(n)
        lo = (step * np.arange(n, dtype=f32)).astype(np.int64)
        hi = np.trunc(float(step) * (np.arange(n) + 1.0)).astype(np.int64)
        edges = np.arange(n_src) * 16
        weight = np.clip(np.minimum(hi[:, None], edges + 16) - np.maximum(lo[:, None], edges), 0, 16)
        return lo >> 4, hi >> 4, weight

    h, w = image.shape
    (x0, x1, wx), (y0, y1, wy) = cover(w, width), cover(h, height)
    v = image.astype(np.int64)
    area = wy.sum(1)[:, None] * wx.sum(1)
    mean = (wy @ v @ wx.T + 128) // np.maximum(area, 1)
    edge = (y1 > h - 2)[:, None] | (x1 > w - 2)
    return np.where(edge, v[y0][:, x0], mean).astype(np.uint8)


def box_subsample(image: np.ndarray, scale: f32) -> np.ndarray:
    """Mean of a square of about 1 / scale pixels at each sampled corner."""
    h, w = image.shape
    side = min(10000, max(2, int(float(f32(1.0) / scale) + 0.5)))
    if w < side or h < side:
        return image[h // 2 : h // 2 + 1, w // 2 : w // 2 + 1].copy()
    width, height = max(1, scaled_size(scale, w)), max(1, scaled_size(scale, h))
    at = lambda n_src, n: np.minimum((f32(n_src) / f32(n) * np.arange(n, dtype=f32)).astype(np.int64), n_src - side)
    run = np.pad(image.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    x, y = at(w, width), at(h, height)[:, None]
    total = run[y + side, x + side] - run[y, x + side] - run[y + side, x] + run[y, x]
    return (total.astype(f32) * (f32(1.0) / f32(side * side))).astype(np.int64).astype(np.uint8)


def unsharp(image: np.ndarray, half: int, fraction: float) -> np.ndarray:
    """v + fraction * (v - mean of the square around), in float32; a border of half stays."""
    h, w = image.shape
    side, out = 2 * half + 1, image.copy()
    if h <= 2 * half or w <= 2 * half:
        return out
    rows = np.lib.stride_tricks.sliding_window_view(image.astype(np.int64), side, axis=1).sum(-1).astype(f32)
    total = np.zeros((h - 2 * half, w - 2 * half), f32)
    for k in range(side):  # from the top down
        total = total + rows[k : k + h - 2 * half]
    low = (f32(1.0) / (f32(side) * f32(side))) * total
    v = image[half : h - half, half : w - half].astype(f32)
    new = np.trunc((v + f32(fraction) * (v - low)).astype(float) + 0.5)
    out[half : h - half, half : w - half] = np.clip(new, 0, 255)
    return out


def scale_gray(image: np.ndarray, factor: float) -> np.ndarray:
    """Isotropic scaling: 1 copies, below 0.02 box means, below 0.7 area means, else interpolation; then sharpening."""
    if factor <= 0:
        raise ValueError(f"scale factor {factor} is not positive")
    scale = f32(factor)
    f = float(scale)
    if f == 1.0:
        return image.copy()
    size = scaled_size(scale, image.shape[1]), scaled_size(scale, image.shape[0])
    if f < 0.02:
        out = box_subsample(image, scale)
    elif f in (0.5, 0.25, 0.125, 0.0625):
        out = image
        for _ in range(round(-np.log2(f))):
            out = halve(out)
    elif f < 0.7:
        out = area_average(image, *size)
    elif f in (2.0, 4.0):
        out = enlarge(image, int(f))
    else:
        out = interpolate(image, *size)
    if 0.2 < f < 0.7:
        return unsharp(out, 1, 0.2)
    return unsharp(out, 2, 0.4) if 0.7 <= f < 1.4 else out


# -- morphology, connectivity, distance -------------------------------------


def check_brick(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise ValueError(f"brick {width} x {height} is empty")


def _counts(bits: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """Ink in [i - before, i + after] along an axis, nothing beyond the edges."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (before, after)
    run = np.cumsum(np.pad(bits.astype(np.int64), pad), axis=axis)
    pad[axis] = (1, 0)
    run = np.pad(run, pad)
    n = before + after + 1
    return np.take(run, range(n, run.shape[axis]), axis) - np.take(run, range(run.shape[axis] - n), axis)


def dilate(bits: np.ndarray, width: int, height: int) -> np.ndarray:
    check_brick(width, height)
    x = _counts(bits, width - 1 - width // 2, width // 2, 1) >= 1
    return (_counts(x, height - 1 - height // 2, height // 2, 0) >= 1).astype(np.uint8)


def erode(bits: np.ndarray, width: int, height: int) -> np.ndarray:
    """The whole brick must be ink, so pixels whose brick leaves the image clear."""
    check_brick(width, height)
    x = _counts(bits, width // 2, width - 1 - width // 2, 1) == width
    return (_counts(x, height // 2, height - 1 - height // 2, 0) == height).astype(np.uint8)


def opening(bits: np.ndarray, width: int, height: int) -> np.ndarray:
    return dilate(erode(bits, width, height), width, height)


def closing(bits: np.ndarray, width: int, height: int) -> np.ndarray:
    return erode(dilate(bits, width, height), width, height)


def label(bits: np.ndarray, connectivity: int) -> np.ndarray:
    """For every ink pixel the raster position of its component's first pixel, -1 elsewhere."""
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity {connectivity} is neither 4 nor 8")
    h, w = bits.shape
    index, ink = np.arange(h * w).reshape(h, w), bits.astype(bool)
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)
    u, v = [], []
    for dy, dx in steps:
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = ink[a] & ink[b]
        u.append(index[a][both]), v.append(index[b][both])
    u, v = np.concatenate(u), np.concatenate(v)
    root = np.arange(h * w)
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return np.where(ink, root.reshape(h, w), -1)


def components(bits: np.ndarray, connectivity: int) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) with half-open bounds, in raster order of the first pixels."""
    mark = label(bits, connectivity)
    y, x = np.nonzero(mark >= 0)
    names, at, count = np.unique(mark[y, x], return_inverse=True, return_counts=True)
    edge = lambda op, v, start: (lambda o: (op.at(o, at, v), o)[1])(np.full(len(names), start))
    x0, y0 = edge(np.minimum, x, bits.shape[1]), edge(np.minimum, y, bits.shape[0])
    x1, y1 = edge(np.maximum, x, -1) + 1, edge(np.maximum, y, -1) + 1
    return [tuple(map(int, r)) for r in zip(x0, y0, x1, y1, count)]


def seed_fill(seed: np.ndarray, mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Components of the mask that hold a seed."""
    if seed.shape != mask.shape:
        raise ValueError("seed and mask differ in size")
    mark = label(mask, connectivity)
    hit = np.unique(mark[seed.astype(bool) & mask.astype(bool)])
    return (np.isin(mark, hit) & (mark >= 0)).astype(np.uint8)


def city_block(bits: np.ndarray) -> np.ndarray:
    """Distance of ink to paper by steps along the axes, the outside is paper; at most 255."""
    d = np.where(np.pad(bits.astype(bool), 1), np.int64(1 << 30), 0)
    for axis in (0, 1):
        at = np.arange(d.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
        ahead = np.minimum.accumulate(d - at, axis) + at
        back = np.flip(np.minimum.accumulate(np.flip(d + at, axis), axis), axis) - at
        d = np.minimum(ahead, back)
    return np.minimum(d[1:-1, 1:-1], 255).astype(np.uint8)


# -- skew --------------------------------------------------------------------

#: Degrees of the coarse and the fine sweep, their steps.
SKEW_COARSE, SKEW_FINE = (5.0, 0.1), (0.1, 0.01)


def shear_profile(bits: np.ndarray, degrees: float) -> np.ndarray:
    """Ink per row after a vertical shear about the middle column, split between the two rows it falls between."""
    h, w = bits.shape
    pad = int(w / 2 * np.tan(np.radians(SKEW_COARSE[0] + SKEW_FINE[0]))) + 1
    y, x = np.nonzero(bits)
    shift = (x - w / 2) * np.tan(degrees * np.pi / 180)
    row, part = np.floor(shift), shift - np.floor(shift)
    at, size = (y + row + pad).astype(int), h + 2 * pad + 1
    return np.bincount(at, 1 - part, size) + np.bincount(at + 1, part, size)


def sweep(centre: float, radius: float, step: float) -> list[float]:
    return [centre - radius + i * step for i in range(round(2 * radius / step) + 1)]


def skew_angle(bits: np.ndarray) -> float:
    """Radians by which the text is tilted: the first best of two sweeps over sums of squares of profiles."""
    if not bits.any():
        return 0.0
    score = lambda deg: float((shear_profile(bits, deg) ** 2).sum())
    best, top = 0.0, -np.inf
    for radius, step in (SKEW_COARSE, SKEW_FINE):
        for deg in sweep(best, radius, step):
            if (s := score(deg)) > top:
                best, top = deg, s
    return -best * np.pi / 180


# -- line normalisation ------------------------------------------------------


def fractile(values: np.ndarray, part: float) -> float:
    """Value below which a part of the samples lies, inside buckets of width one that end at value + 1."""
    count = np.bincount(np.clip(values, 0, 255).astype(int), minlength=256)
    if not count.sum():
        return 0.0
    goal = min(max(part * count.sum(), 1.0), float(count.sum()))
    run = np.cumsum(count)
    v = int(np.searchsorted(run, goal))
    return v + 1 - (run[v] - goal) / count[v]


def black_white(image: np.ndarray) -> tuple[float, float]:
    """Quartiles of the dark and light turning points on the middle row."""
    row = image[image.shape[0] // 2].astype(int)
    left, here, right = row[:-2], row[1:-1], row[2:]
    dark = here[((here < left) & (here <= right)) | ((here <= left) & (here < right))]
    light = here[((here > left) & (here >= right)) | ((here >= left) & (here > right))]
    return fractile(dark if len(dark) else np.array([0]), 0.25), fractile(light if len(light) else np.array([255]), 0.75)
