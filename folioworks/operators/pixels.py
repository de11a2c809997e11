"""Operators over pixels(image_id, y, x, v): every pixel of every image is a row.

Neighbourhoods are window frames along rows and columns (separable), so images are never
joined with themselves position by position. Rows of an image must be complete.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster
from . import runs

ROW, COLUMN = ("image_id", "y"), ("image_id", "x")


def _over(keys: tuple[str, ...], order: str, before: int, after: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, w, h)."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


# -- thresholds --------------------------------------------------------------


def otsu_thresholds(pixels: DataFrame, digits: int | None = None) -> DataFrame:
    """(image_id, threshold) from 256-bin histograms; the smallest of equal levels, 0 if flat.

    With digits, spreads are equal that are so when rounded; else the last place of a quotient decides.
    """
    hist = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("v")
    whole = Window.partitionBy("image_id")
    run = hist.select("image_id", "v", F.sum("n").over(upto).alias("wb"), F.sum(F.col("n") * F.col("v")).over(upto).alias("sb"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    wf = F.col("n") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.nullif(wf, F.lit(0))
    spread = F.coalesce(F.col("wb").cast("double") * wf * gap * gap, F.lit(0.0))
    spread = spread if digits is None else F.round(spread, digits)
    # the largest spread; of equals the smallest level
    best = run.groupBy("image_id").agg(F.min(F.struct((-spread).alias("d"), F.col("v"))).alias("b"))
    return best.select("image_id", F.when(F.col("b.d") < 0, F.col("b.v")).otherwise(0).cast("int").alias("threshold"))


def otsu(pixels: DataFrame) -> DataFrame:
    """Ink where a pixel is at most its image's threshold; thresholds are a row for each image."""
    t = otsu_thresholds(pixels)
    return pixels.join(t, "image_id").select("image_id", "y", "x", (F.col("v") <= F.col("threshold")).cast("int").alias("v"))


def ink(pixels: DataFrame, level: int) -> DataFrame:
    return pixels.select("image_id", "y", "x", (F.col("v") <= level).cast("int").alias("v"))


def _mirrored(df: DataFrame, axis: str, size: str, half: int) -> DataFrame:
    """Adds the rows beyond both ends of an axis: the edge twice, then inwards."""
    at = F.col(axis)
    places = F.array_compact(F.array(at, F.when(at < half, -1 - at), F.when(at >= F.col(size) - half, 2 * F.col(size) - 1 - at)))
    return df.withColumn(axis, F.explode(places))


def sauvola(pixels: DataFrame, window: int, k: float) -> DataFrame:
    """Local thresholds from sums over the mirrored window: along x, then along y."""
    half = (window - 1) // 2
    if half < 2:
        raise ValueError(f"window {window} is below 5")
    side = 2 * half + 1
    sized = pixels.join(sizes(pixels), "image_id").where((F.col("w") > half) & (F.col("h") > half))
    along = _over(ROW, "x", half, half)
    x = _mirrored(sized.withColumn("c", F.col("x")), "x", "w", half)
    x = x.select("image_id", "y", "x", "w", "h", "v", F.sum("v").over(along).alias("s"), F.sum(F.col("v") * F.col("v")).over(along).alias("q"))
    x = x.where((F.col("x") >= 0) & (F.col("x") < F.col("w")))
    down = _over(COLUMN, "y", half, half)
    y = _mirrored(x, "y", "h", half)
    y = y.select("image_id", "y", "x", "h", "v", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q")).where((F.col("y") >= 0) & (F.col("y") < F.col("h")))
    mean = F.floor(F.col("s").cast("float") * F.lit(float(np.float32(1 / side**2))).cast("float")).cast("int")
    square = F.floor(F.lit(1 / side**2) * F.col("q") + 0.5).cast("int")
    y = y.withColumn("m", mean).withColumn("d", F.sqrt(F.greatest(square - mean * mean, F.lit(0)).cast("double")).cast("float").cast("double"))
    level = F.col("m") * (1 - F.lit(k) * (1 - F.col("d") / 128))
    level = F.when(level < 0, F.ceil(level)).otherwise(F.floor(level))
    return y.select("image_id", "y", "x", (F.col("v") < level).cast("int").alias("v"))


# -- raster algebra, rotation ------------------------------------------------


def truth(op: str, source: Column, dest: Column, full: int) -> Column:
    """A two-input bit operation."""
    s, d = source, dest
    forms = {"clear": F.lit(0), "set": F.lit(full), "src": s, "notsrc": F.bitwise_not(s), "and": s.bitwiseAND(d), "or": s.bitwiseOR(d), "xor": s.bitwiseXOR(d)}
    if op not in forms:
        raise ValueError(f"unknown raster operation {op!r}")
    return forms[op].bitwiseAND(F.lit(full)).cast("int")


def raster_op(dst: DataFrame, rect: tuple[int, int, int, int], op: str, src: DataFrame | None = None, at: tuple[int, int] = (0, 0), full: int = 1) -> DataFrame:
    """dst with op in the rectangle (x, y, w, h), its origin over ``at`` of the source.

    src has the same image ids. A rectangle that leaves either image is cut: there is no
    source or destination row to join with.
    """
    x, y, w, h = rect
    inside = (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)
    if op in ("clear", "set"):
        return dst.withColumn("v", F.when(inside, truth(op, F.lit(0), F.col("v"), full)).otherwise(F.col("v")))
    moved = src.select("image_id", (F.col("x") - at[0] + x).alias("x"), (F.col("y") - at[1] + y).alias("y"), F.col("v").alias("s"))
    both = dst.join(moved, ["image_id", "x", "y"], "left")
    v = F.when(inside & F.col("s").isNotNull(), truth(op, F.col("s"), F.col("v"), full)).otherwise(F.col("v"))
    return both.select("image_id", "y", "x", v.alias("v"))


def turned(bits: DataFrame, radians: Column) -> DataFrame:
    """Nearest source pixel by truncation about the centre, by each image's angle; what turns in from outside is paper."""
    single = lambda e: e.cast("float").cast("double")
    s, c = single(F.sin(single(radians))), single(F.cos(single(radians)))
    grid = bits.join(sizes(bits), "image_id").withColumn("cx", F.floor(F.col("w") / 2)).withColumn("cy", F.floor(F.col("h") / 2))
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    cut = lambda e: F.when(e < 0, F.ceil(e)).otherwise(F.floor(e))
    sx = F.col("cx") + cut((-dx * c - dy * s).cast("float"))
    sy = F.col("cy") + cut((-dy * c + dx * s).cast("float"))
    want = grid.select("image_id", "y", "x", sx.cast("int").alias("sx"), sy.cast("int").alias("sy"))
    source = bits.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return want.join(source, ["image_id", "sx", "sy"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def rotate(bits: DataFrame, radians: float) -> DataFrame:
    """All images turned by one angle."""
    return turned(bits, F.lit(radians))


# -- scaling, sharpening -----------------------------------------------------


def halve(pixels: DataFrame) -> DataFrame:
    """Means of whole 2 x 2 blocks, rounded down; odd ends are dropped."""
    block = pixels.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    return block.agg(F.sum("v").alias("s"), F.count("*").alias("n")).where("n = 4").select("image_id", "y", "x", F.floor(F.col("s") / 4).cast("int").alias("v"))


def unsharp(pixels: DataFrame, half: int, fraction: float) -> DataFrame:
    """v + fraction * (v - box mean) in single precision; a border of half stays."""
    row, col = _over(ROW, "x", half, half), _over(COLUMN, "y", half, half)
    sums = pixels.join(sizes(pixels), "image_id").withColumn("s", F.sum("v").over(row)).withColumn("s", F.sum("s").over(col))
    norm = float(np.float32(1) / (np.float32(2 * half + 1) * np.float32(2 * half + 1)))
    v = F.col("v").cast("float")
    sharp = v + F.lit(fraction).cast("float") * (v - F.lit(norm).cast("float") * F.col("s").cast("float"))
    level = sharp.cast("double") + 0.5
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.when(level < 0, F.ceil(level)).otherwise(F.floor(level))))
    inner = (F.col("x") >= half) & (F.col("x") < F.col("w") - half) & (F.col("y") >= half) & (F.col("y") < F.col("h") - half)
    return sums.select("image_id", "y", "x", F.when(inner, level).otherwise(F.col("v")).cast("int").alias("v"))


# -- morphology --------------------------------------------------------------


def dilate(bits: DataFrame, width: int, height: int) -> DataFrame:
    raster.check_brick(width, height)
    x = bits.select("image_id", "y", "x", F.max("v").over(_over(ROW, "x", width - 1 - width // 2, width // 2)).alias("v"))
    return x.select("image_id", "y", "x", F.max("v").over(_over(COLUMN, "y", height - 1 - height // 2, height // 2)).alias("v"))


def erode(bits: DataFrame, width: int, height: int) -> DataFrame:
    """Counts must equal the brick: a frame that leaves the image has too few rows."""
    raster.check_brick(width, height)
    x = bits.select("image_id", "y", "x", (F.sum("v").over(_over(ROW, "x", width // 2, width - 1 - width // 2)) == width).cast("int").alias("v"))
    return x.select("image_id", "y", "x", (F.sum("v").over(_over(COLUMN, "y", height // 2, height - 1 - height // 2)) == height).cast("int").alias("v"))


def opening(bits: DataFrame, width: int, height: int) -> DataFrame:
    return dilate(erode(bits, width, height), width, height)


def closing(bits: DataFrame, width: int, height: int) -> DataFrame:
    return erode(dilate(bits, width, height), width, height)


# -- kernels by image --------------------------------------------------------


def dense(pdf: pd.DataFrame, column: str = "v") -> np.ndarray:
    out = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), np.uint8)
    out[pdf["y"], pdf["x"]] = pdf[column]
    return out


def by_image(pixels: DataFrame, kernel, schema: str, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Runs kernel(arrays) -> dict of columns on each image; an image is one task's row group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(kernel(*(dense(pdf, c) for c in columns)))
        out.insert(0, "image_id", pdf["image_id"].iloc[0])
        return out

    return pixels.groupBy("image_id").applyInPandas(run, f"image_id long, {schema}")


def as_rows(image: np.ndarray, name: str = "v", where: np.ndarray | None = None) -> dict:
    y, x = np.indices(image.shape) if where is None else np.nonzero(where)
    y, x = np.ravel(y), np.ravel(x)
    return {"y": y.astype("int32"), "x": x.astype("int32"), name: image[y, x].astype("int32")}


def map_images(pixels: DataFrame, kernel) -> DataFrame:
    """Images to images: kernel(array) -> array."""
    return by_image(pixels, lambda a: as_rows(kernel(a)), "y int, x int, v int")


def components(bits: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, comp, x0, y0, x1, y1, pixels) in raster order of the first pixels."""
    comp = (F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1).cast("int")
    return runs.components(bits, connectivity).select("image_id", comp.alias("comp"), "x0", "y0", "x1", "y1", "pixels")


def seed_fill(seeds: DataFrame, mask: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, y, x) of the mask's components that hold a seed."""
    return runs.seed_fill(seeds, mask, connectivity)


def distance(bits: DataFrame) -> DataFrame:
    """(image_id, y, x, d) of ink: city-block distance to paper or the outside, at most 255."""
    return runs.distance(bits)


# -- skew --------------------------------------------------------------------


def profiles(bits: DataFrame, degrees: Column | float) -> DataFrame:
    """(image_id, deg, row, mass): ink by row after a vertical shear, split between the rows it falls between.

    degrees may be an array column: the angles to try for a pixel's image.
    """
    deg = F.array(F.lit(float(degrees))) if isinstance(degrees, (int, float)) else degrees
    points = bits.where("v = 1").join(sizes(bits), "image_id").select("image_id", "y", F.posexplode(deg).alias("ord", "deg"), "x", "w")
    shift = (F.col("x") - F.col("w") / 2) * F.tan(F.col("deg") * F.lit(math.pi) / 180)
    points = points.withColumn("shift", shift).withColumn("low", F.floor("shift"))
    part = F.col("shift") - F.col("low")
    bins = F.array(F.struct((F.col("y") + F.col("low")).alias("row"), (1 - part).alias("m")), F.struct((F.col("y") + F.col("low") + 1).alias("row"), part.alias("m")))
    return points.select("image_id", "ord", "deg", F.explode(bins).alias("b")).groupBy("image_id", "ord", "deg", "b.row").agg(F.sum("b.m").alias("mass"))


def best_angle(bits: DataFrame, degrees: Column) -> DataFrame:
    """(image_id, deg): the first angle with the largest sum of squares."""
    score = profiles(bits, degrees).groupBy("image_id", "ord", "deg").agg(F.round(F.sum(F.col("mass") * F.col("mass")), 6).alias("score"))
    return score.groupBy("image_id").agg(F.min(F.struct(-F.col("score"), F.col("ord"), F.col("deg"))).alias("b")).select("image_id", F.col("b.deg").alias("deg"))


def skew(bits: DataFrame) -> DataFrame:
    """(image_id, degrees) by which text is tilted; the angles are a fixed list, pixels meet each once."""
    (radius, step), (fine, small) = raster.SKEW_COARSE, raster.SKEW_FINE
    coarse = best_angle(bits, F.array(*(F.lit(d) for d in raster.sweep(0.0, radius, step))))
    near = F.transform(F.sequence(F.lit(0), F.lit(round(2 * fine / small))), lambda i: F.col("around") - fine + i * small)
    around = bits.join(coarse.withColumnRenamed("deg", "around"), "image_id")
    # the coarse winner stays in front, so it keeps ties
    refined = best_angle(around, F.concat(F.array("around"), near))
    return bits.select("image_id").distinct().join(refined, "image_id", "left").select("image_id", F.coalesce(-F.col("deg"), F.lit(0.0)).alias("degrees"))


# -- line normalisation ------------------------------------------------------


def turning_points(pixels: DataFrame) -> DataFrame:
    """(image_id, v, dark): turning points of the middle row."""
    line = pixels.join(sizes(pixels), "image_id").where(F.col("y") == F.floor(F.col("h") / 2))
    along = Window.partitionBy("image_id").orderBy("x")
    line = line.select("image_id", F.lag("v").over(along).alias("l"), "v", F.lead("v").over(along).alias("r")).where("l is not null and r is not null")
    dark = "(v < l and v <= r) or (v <= l and v < r)"
    light = "(v > l and v >= r) or (v >= l and v > r)"
    return line.where(f"{dark} or {light}").select("image_id", "v", F.expr(dark).alias("dark"))


def fractiles(values: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """(keys, ile): from histograms; inside the crossing bucket v, which ends at v + 1, by straight line."""
    hist = values.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.first(part).alias("part"))
    run = hist.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    run = run.withColumn("goal", F.least(F.col("total"), F.greatest(F.lit(1), F.col("part") * F.col("total"))))
    hit = F.min(F.when(F.col("cum") >= F.col("goal"), F.struct(F.col("v"), F.col("cum"), F.col("goal"), F.col("n"))))
    return run.groupBy(*keys).agg(hit.alias("h")).select(*keys, (F.col("h.v") + 1 - (F.col("h.cum") - F.col("h.goal")) / F.col("h.n")).alias("ile"))


def black_white(pixels: DataFrame) -> DataFrame:
    """(image_id, black, white): quartiles of dark and light turning points; 0 and 255 stand in for none."""
    points = turning_points(pixels)
    ile = fractiles(points, ["image_id", "dark"], F.when(F.col("dark"), 0.25).otherwise(0.75))
    sides = pixels.select("image_id").distinct()
    pick = lambda dark, name: ile.where(F.col("dark") == dark).select("image_id", F.col("ile").alias(name))
    out = sides.join(pick(True, "black"), "image_id", "left").join(pick(False, "white"), "image_id", "left")
    return out.select("image_id", F.coalesce("black", F.lit(1.0)).alias("black"), F.coalesce("white", F.lit(256.0)).alias("white"))


def contrast(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, value): (v - black) / contrast - 1 in single precision, not clipped."""
    bw = black_white(pixels).select("image_id", F.col("black").cast("float").alias("b"), F.col("white").cast("float").alias("w"))
    half = ((F.col("w") - F.col("b")) / F.lit(2).cast("float")).cast("float")
    half = F.when(half <= 0, F.lit(1).cast("float")).otherwise(half)
    value = (((F.col("v").cast("float") - F.col("b")) / half).cast("float") - F.lit(1).cast("float")).cast("float")
    return pixels.join(bw, "image_id").select("image_id", "y", "x", value.alias("value"))
