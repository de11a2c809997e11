"""Scaling of images as two grouped sums, one for each axis.

Each row or column of an image counts for a few scaled ones, with whole weights that arithmetic
gives; these taps are joined to the pixels, an axis at a time, and summed. Sums of whole
numbers make the two axes separable. pixels is (image_id, y, x, v) with complete rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels as P
from .recurrent import spread

#: Factors that are one half, or one half again and again.
HALVES = {0.5: 1, 0.25: 2, 0.125: 3, 0.0625: 4}


def single(v: Column) -> Column:
    return v.cast("float")


def whole(v: Column) -> Column:
    return F.floor(v).cast("long")


def shares(kind: str, side: int, at: Column, n: Column, m: Column) -> Column:
    """Array of (i, k, first, far): scaled positions that position ``at`` of n counts for, with weight k; first and far for the edges of area means."""
    step = single(single(16 * n) / single(m))
    pos = lambda i: whole(step * single(i))
    if kind == "box":
        ratio = single(single(n) / single(m))
        begin = lambda i: F.least(whole(ratio * single(i)), n - side)
        lo, hi = whole((at - side) / ratio) - 1, F.when(at >= n - side, m - 1).otherwise(whole(at / ratio) + 1)
        form = lambda i: F.struct(i.alias("i"), ((begin(i) <= at) & (at < begin(i) + side)).cast("long").alias("k"), F.lit(False).alias("first"), F.lit(False).alias("far"))
    elif kind == "area":
        lo, hi = whole((at * 16 - 16) / step) - 1, whole((at * 16 + 16) / step) + 1
        end = lambda i: whole(step.cast("double") * (i + F.lit(1.0)))
        part = lambda i: F.least(F.lit(16), F.greatest(F.lit(0), F.least(end(i), at * 16 + 16) - F.greatest(pos(i), at * 16)))
        form = lambda i: F.struct(i.alias("i"), part(i).cast("long").alias("k"), (F.shiftright(pos(i), 4) == at).alias("first"), (F.shiftright(end(i), 4) > n - 2).alias("far"))
    else:
        times = side
        base = (lambda i: F.floor(i / times)) if times else (lambda i: F.shiftright(pos(i), 4))
        rest = (lambda i: i % times) if times else (lambda i: pos(i) % 16)
        unit = times or 16
        lo, hi = (at * times - times, at * times + times) if times else (whole((at * 16 - 16) / step) - 1, whole((at * 16 + 16) / step) + 1)
        weight = lambda i: F.when(base(i) == at, unit - rest(i)).otherwise(0) + F.when(F.least(base(i) + 1, n - 1) == at, rest(i)).otherwise(0)
        form = lambda i: F.struct(i.alias("i"), weight(i).cast("long").alias("k"), F.lit(False).alias("first"), F.lit(False).alias("far"))
    lo, hi = F.greatest(F.lit(0), lo).cast("long"), F.least(m - 1, hi).cast("long")
    near = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    return F.filter(F.transform(near, form), lambda t: (t["k"] > 0) | t["first"])


def summed(df: DataFrame, sizes: DataFrame, axis: str, kind: str, side: int, scale: float) -> DataFrame:
    """One axis scaled: weighted sums, weights, the value where scaled positions begin, and whether they reach the far edge.

    Weights are worked out once for each row or column of an image and joined to its pixels.
    """
    n = F.col({"x": "w", "y": "h"}[axis])
    m = whole(single(F.lit(scale).cast("float") * single(n)).cast("double") + 0.5)
    m = F.greatest(m, F.lit(1)) if kind == "box" else m
    taps = sizes.withColumn("m", m).withColumn(axis, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    taps = taps.select("image_id", axis, F.explode(shares(kind, side, F.col(axis).cast("long"), n.cast("long"), F.col("m"))).alias("t"))
    each = df.join(taps, ["image_id", axis])
    keys = ["image_id", "y" if axis == "x" else "x"]
    corner = F.max(F.when(F.col("t.first"), F.col("corner")))
    # weights multiply rows, so tasks are not to be joined by the few bytes they read
    each = spread(each.withColumn("i", F.col("t.i")), *keys, "i")
    out = each.groupBy(*keys, "i").agg(F.sum(F.col("t.k") * F.col("total")).alias("total"), F.sum(F.col("t.k") * F.col("area")).alias("area"), corner.alias("corner"), F.max(F.col("far") | F.col("t.far")).alias("far"))
    return out.withColumn(axis, F.col("i").cast("int")).drop("i")


def scale_gray(pixels: DataFrame, factor: float) -> DataFrame:
    """Isotropic scaling: 1 copies, below 0.02 box means, below 0.7 area means (halves by blocks of four), else interpolation; then sharpening.

    Images lower or narrower than the box of a factor below 0.02 give their middle pixel.
    """
    if factor <= 0:
        raise ValueError(f"scale factor {factor} is not positive")
    f = float(np.float32(factor))
    if f == 1.0:
        return pixels
    if f in HALVES:
        out = pixels
        for _ in range(HALVES[f]):
            out = P.halve(out)
        return P.unsharp(out, 1, 0.2) if f > 0.2 else out
    sizes, start = P.sizes(pixels), pixels.withColumns({"total": F.col("v").cast("long"), "area": F.lit(1).cast("long"), "corner": F.col("v"), "far": F.lit(False)})
    kind, side = ("box", min(10000, max(2, int(float(np.float32(1) / np.float32(f)) + 0.5)))) if f < 0.02 else ("area", 0) if f < 0.7 else ("line", int(f) if f in (2.0, 4.0) else 0)
    small = None
    if kind == "box":
        fits = (F.col("w") >= side) & (F.col("h") >= side)
        small = pixels.join(sizes, "image_id").where(~fits & (F.col("y") == F.floor(F.col("h") / 2)) & (F.col("x") == F.floor(F.col("w") / 2))).select("image_id", F.lit(0).alias("y"), F.lit(0).alias("x"), "v")
        sizes = sizes.where(fits)
    sums = summed(summed(start, sizes, "x", kind, side, f), sizes, "y", kind, side, f)
    if kind == "box":
        value = F.floor(single(F.col("total")) * F.lit(float(np.float32(1) / np.float32(side * side))).cast("float"))
    elif kind == "area":
        value = F.when(F.col("far"), F.col("corner")).otherwise(F.expr("(total + 128) div greatest(area, 1)"))
    else:
        value = F.expr(f"total div {side * side}" if side else "(total + 128) div 256")
    out = sums.select("image_id", "y", "x", value.cast("int").alias("v"))
    if small is not None:
        return out.unionByName(small)
    if 0.2 < f < 0.7:
        return P.unsharp(out, 1, 0.2)
    return P.unsharp(out, 2, 0.4) if 0.7 <= f < 1.4 else out
