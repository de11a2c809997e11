"""Finding text lines on pages: smearing, blocks, valleys of projection profiles, crops.

bits and gray are (image_id, y, x, v) with complete rows. A page splits over tasks by row,
column, block and cell; only a line's crop, at the end, is one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut
from ..sources.images import dense_images
from . import pixels, runs

#: Paper runs up to these lengths become ink along rows, along columns, and along rows once more.
GAPS = (24, 12, 6)
#: Rows that a line's core has at least; side of the cells in which pixels meet boxes.
LEAST_CORE, CELL = 2, 64


def smear(bits: DataFrame, axis: str, gap: int) -> DataFrame:
    """Ink where paper lies between ink of its row (axis x) or column (axis y) and the run of paper has at most gap pixels."""
    across = {"x": "y", "y": "x"}[axis]
    line = Window.partitionBy("image_id", across).orderBy(axis)
    mark = F.when(F.col("v") == 1, F.col(axis))
    before = F.last(mark, True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, True).over(line.rowsBetween(0, Window.unboundedFollowing))
    return bits.withColumn("v", F.coalesce((after - before <= gap + 1).cast("int"), F.lit(0)))


def smeared(bits: DataFrame, gaps: tuple[int, int, int] = GAPS) -> DataFrame:
    """Smeared along rows and along columns; what both have is smeared along rows again. Holds all ink."""
    along = smear(bits.withColumn("ink", F.col("v")), "x", gaps[0]).withColumn("along", F.col("v")).withColumn("v", F.col("ink"))
    both = smear(along, "y", gaps[1]).withColumn("v", F.col("v") * F.col("along"))
    return smear(both, "x", gaps[2]).select("image_id", "y", "x", "v")


def blocks(bits: DataFrame, gaps: tuple[int, int, int] = GAPS) -> DataFrame:
    """(image_id, y, x, block) of all ink: block is the first pixel of the component of the smeared page, ``y * 2^32 + x``."""
    dots = cut(runs.inked_runs(smeared(bits, gaps)))
    each = cut(dots.groupBy("image_id", "run", "y").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")))
    roots = runs.labelled(each, 8).select("image_id", "run", F.col("root").alias("block"))
    ink = runs.met(dots, bits.where("v = 1").select("image_id", "y", "x"), ["image_id", "y", "x"])
    return runs.met(ink, roots, ["image_id", "run"]).select("image_id", "y", "x", "block")


def profile(ink: DataFrame) -> DataFrame:
    """(image_id, block, y, n) of every row between a block's first and last: its ink, 0 in empty rows."""
    rows = ink.groupBy("image_id", "block", "y").agg(F.count("*").alias("n"))
    block = Window.partitionBy("image_id", "block").orderBy("y")
    rows = rows.withColumn("ahead", F.coalesce(F.lead("y").over(block), F.col("y") + 1))
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ahead") - F.col("y") - 1))).select("image_id", "block", (F.col("y") + F.col("k")).alias("y"), F.when(F.col("k") == 0, F.col("n")).otherwise(0).alias("n"))


def valley_cuts(rows: DataFrame, least: int = LEAST_CORE) -> DataFrame:
    """(image_id, block, cut): rows of profile where a new line begins.

    Runs of rows with at least the mean ink are cores; between two cores of ``least`` rows or
    more, the row with the least ink is the cut, the first of equals.
    """
    key = ["image_id", "block"]
    block, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("y")
    core = F.col("n") * F.count("*").over(block) >= F.sum("n").over(block)
    marked = rows.withColumn("core", core)
    marked = marked.withColumn("turn", F.coalesce((F.lag("core").over(order) != F.col("core")).cast("int"), F.lit(0)))
    marked = marked.withColumn("island", F.sum("turn").over(order))
    marked = marked.withColumn("kept", F.col("core") & (F.count("*").over(Window.partitionBy(*key, "island")) >= least))
    # rows between kept cores share the number of kept islands begun before them
    begins = F.col("kept") & F.coalesce(~F.lag("kept").over(order), F.lit(True))
    marked = marked.withColumn("done", F.sum(begins.cast("int")).over(order)).withColumn("all", F.sum(begins.cast("int")).over(block))
    valley = marked.where("not kept and done > 0 and done < all").groupBy(*key, "done").agg(F.min(F.struct("n", "y")).alias("low"))
    return valley.select(*key, F.col("low.y").alias("cut"))


def lined(bits: DataFrame, gaps: tuple[int, int, int] = GAPS, least: int = LEAST_CORE) -> tuple[DataFrame, DataFrame]:
    """(ink with its block, (image_id, block, y, line) of the rows of every block): lines of a block from 0 on."""
    ink = cut(blocks(bits, gaps))
    rows = cut(profile(ink))
    cuts = valley_cuts(rows, least).groupBy("image_id", "block").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    # a block's cuts are fewer than its rows
    line = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("y"))), F.lit(0))
    return ink, runs.met(rows.select("image_id", "block", "y"), cuts, ["image_id", "block"], "left").select("image_id", "block", "y", line.alias("line"))


def text_lines(bits: DataFrame, gaps: tuple[int, int, int] = GAPS, least: int = LEAST_CORE) -> DataFrame:
    """(image_id, block, line, x0, y0, x1, y1, ink): half-open boxes of the ink of each line."""
    ink, rows = lined(bits, gaps, least)
    each = runs.met(ink, rows, ["image_id", "block", "y"]).groupBy("image_id", "block", "line")
    return each.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("ink"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line_id: the image and, in its lower 20 bits, the number by block and line. A page has far fewer lines than pixels."""
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("block", "line")) - 1
    return lines.withColumn("line_id", F.shiftleft(F.col("image_id"), 20) + n)


def crop_pixels(gray: DataFrame, lines: DataFrame, pad: int = 0) -> DataFrame:
    """(image_id, y, x, v) of each line's rectangle, image_id being line_id; pixels and boxes meet in cells."""
    cells = lambda lo, hi: F.sequence(F.floor(lo / CELL), F.floor((hi - 1) / CELL))
    wide = lines.select("image_id", "line_id", *((F.col(c) - pad).alias(c) for c in ("x0", "y0")), *((F.col(c) + pad).alias(c) for c in ("x1", "y1")))
    # the paper beyond the page is no part of a crop
    wide = wide.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("x0", "y0")})
    wide = wide.withColumn("cy", F.explode(cells(F.col("y0"), F.col("y1")))).withColumn("cx", F.explode(cells(F.col("x0"), F.col("x1"))))
    at = gray.withColumn("cy", F.floor(F.col("y") / CELL)).withColumn("cx", F.floor(F.col("x") / CELL))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    met = runs.met(at, wide, ["image_id", "cy", "cx"]).where(inside)
    return met.select(F.col("line_id").alias("image_id"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def line_images(gray: DataFrame, lines: DataFrame, pad: int = 0) -> DataFrame:
    """(line_id, width, height, pix), as recognition takes them, of lines with line_id."""
    return dense_images(crop_pixels(gray, lines, pad))


def deskewed(bits: DataFrame) -> DataFrame:
    """bits turned upright, each image by its own skew."""
    angle = pixels.skew(bits).select("image_id", (F.col("degrees") * (-math.pi / 180)).alias("radians"))
    return pixels.turned(bits.join(angle, "image_id"), F.col("radians"))


def find_lines(gray: DataFrame, gaps: tuple[int, int, int] = GAPS, least: int = LEAST_CORE) -> DataFrame:
    """The whole detector: ink by Otsu's threshold, upright, smeared, cut to lines, with line_id.

    Boxes are those of the upright page; images whose skew is 0 keep their coordinates.
    """
    return numbered(text_lines(cut(deskewed(cut(pixels.otsu(gray)))), gaps, least))


# -- baselines and words -------------------------------------------------------

#: Points at each end of a line that candidates of its baseline go through.
ENDS = 3
LINE = ["image_id", "block", "line"]


def line_components(bits: DataFrame, gaps: tuple[int, int, int] = GAPS, least: int = LEAST_CORE) -> DataFrame:
    """(image_id, block, line, root, x0, y0, x1, y1) of the components of ink: a component is of the line that has its middle row."""
    ink, rows = lined(bits, gaps, least)
    found = runs.components(bits, 8)
    at = ink.select("image_id", "block", runs.run_name(F.col("y"), F.col("x")).alias("root"))
    middle = F.floor((F.col("y0") + F.col("y1") - 1) / 2).cast("int")
    return runs.met(runs.met(found, at, ["image_id", "root"]).withColumn("y", middle), rows, ["image_id", "block", "y"]).select(*LINE, "root", "x0", "y0", "x1", "y1")


def baselines(boxes: DataFrame) -> DataFrame:
    """(image_id, block, line, slope, offset, error, n) of the components' feet: y = offset + slope * x by least median of squares.

    Candidates go through one of the first and one of the last ENDS feet of a line, so a line has
    nine at most; that with the least median of squared vertical distances wins, of equals the
    first. Outliers (commas, stems, specks) under half of the feet do not move it. A line with
    feet at one x only is level, at the first of them.
    """
    line = Window.partitionBy(*LINE)
    order = line.orderBy("x", "y", "root")
    feet = boxes.select(*LINE, "root", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").cast("double").alias("y"))
    feet = feet.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(line))
    ends = feet.where((F.col("k") <= ENDS) | (F.col("k") > F.col("n") - ENDS))
    at = lambda side: ends.select(*LINE, *(F.col(c).alias(f"{c}{side}") for c in ("k", "x", "y")), *(["n"] if side == "a" else []))
    pairs = runs.met(at("a"), at("b"), LINE).where((F.col("ka") <= ENDS) & (F.col("kb") > F.col("n") - ENDS) & (F.col("xa") < F.col("xb")))
    slope = (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))
    lines = pairs.select(*LINE, "ka", "kb", slope.alias("slope"), (F.col("ya") - slope * F.col("xa")).alias("offset"))
    level = feet.where("k = 1").select(*LINE, F.lit(0).alias("ka"), F.lit(0).alias("kb"), F.lit(0.0).alias("slope"), F.col("y").alias("offset"))
    level = runs.met(level, lines.select(*LINE).distinct(), LINE, "left_anti")
    off = F.col("y") - F.col("offset") - F.col("slope") * F.col("x")
    each = runs.met(lines.unionByName(level), feet.select(*LINE, "x", "y", "n"), LINE).withColumn("r", F.round(off * off, 6))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(*LINE, "ka", "kb").orderBy("r"))).where(F.col("rank") == F.floor(F.col("n") / 2) + 1)
    best = ranked.groupBy(*LINE, "n").agg(F.min(F.struct("r", "ka", "kb", "slope", "offset")).alias("b"))
    return best.select(*LINE, F.col("b.slope").alias("slope"), F.col("b.offset").alias("offset"), F.col("b.r").alias("error"), "n")


def word_gaps(boxes: DataFrame) -> DataFrame:
    """boxes with gap, the columns of paper before a component in its line (null for the first), and space, the largest gap within a word of the line.

    space splits the histogram of a line's gaps where the classes on both sides differ most (as
    Otsu's threshold does for gray levels), the smallest such gap of several; of lines with gaps of
    one size it is that size.
    """
    order = Window.partitionBy(*LINE).orderBy("x0", "y0", "root")
    reached = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = boxes.withColumn("gap", F.when(reached.isNotNull(), F.greatest(F.col("x0") - reached, F.lit(0))))
    known = each.where("gap is not null").select(F.struct(*LINE).alias("image_id"), F.col("gap").alias("v"))
    split = pixels.otsu_thresholds(known, 9).select(*(F.col(f"image_id.{c}").alias(c) for c in LINE), F.col("threshold").alias("cut"))
    widest = known.groupBy("image_id").agg(F.max("v").alias("most"), F.min("v").alias("least"))
    widest = widest.select(*(F.col(f"image_id.{c}").alias(c) for c in LINE), "most", "least")
    both = runs.met(runs.met(each, split, LINE, "left"), widest, LINE, "left")
    return both.withColumn("space", F.when(F.col("most") == F.col("least"), F.col("most")).otherwise(F.col("cut"))).drop("cut", "most", "least")


def word_boxes(boxes: DataFrame) -> DataFrame:
    """(image_id, block, line, word, x0, y0, x1, y1, n): tight boxes of the components between a line's wide gaps."""
    order = Window.partitionBy(*LINE).orderBy("x0", "y0", "root")
    words = word_gaps(boxes).withColumn("word", F.sum(F.coalesce((F.col("gap") > F.col("space")).cast("int"), F.lit(0))).over(order).cast("int"))
    return words.groupBy(*LINE, "word").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


# -- ink of word strips --------------------------------------------------------


def tight_boxes(strips: DataFrame, boxes: DataFrame) -> DataFrame:
    """strips (image_id, strip, x0, x1) that have ink, with the box and number of the components (image_id, x0, y0, x1, y1) in them.

    Recognition places words between letters, so a strip begins and ends in paper, and has the
    line's height; the ink of its components is its tight box. A component is in every strip
    that has its middle column. Points and strips meet in cells of CELL columns.
    """
    wide = strips.where("x0 < x1").select("image_id", "strip", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    wide = wide.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))))
    middle = boxes.withColumn("at", F.floor((F.col("x0") + F.col("x1") - 1) / 2)).withColumn("cell", F.floor(F.col("at") / CELL))
    met = runs.met(middle, wide, ["image_id", "cell"]).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    bounds = (F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return met.groupBy("image_id", "strip").agg(*bounds, F.count("*").alias("n"))
