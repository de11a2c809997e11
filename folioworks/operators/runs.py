"""Connected components of images of any size: rows of ink as runs, runs linked across rows, labels by pointer jumping.

bits is (image_id, y, x, v). No image is ever one task's: windows are by row of an image,
joins by row and cell, labels by run. A run is named by its first pixel in raster order,
``y * 2^32 + x``, so the smallest name of a component is its first pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut

#: Columns of a cell in which runs of neighbouring rows meet: at most half as many runs of a row lie in one.
CELL = 32
RUN = ["image_id", "run"]


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left joined to right, both dealt by their keys. Files of labels are so much smaller than their rows that Spark would send them through the driver."""
    return left.join(right.hint("merge"), on, how)


def inked_runs(bits: DataFrame) -> DataFrame:
    """The ink pixels (image_id, y, x) with the run of their row they belong to."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    ink = bits.where("v = 1").select("image_id", "y", "x")
    # x less its rank is constant within a run
    start = F.min("x").over(Window.partitionBy("image_id", "y", "island"))
    return ink.withColumn("island", F.col("x") - F.row_number().over(row)).withColumn("x0", start).select("image_id", "y", "x", run_name(F.col("y"), F.col("x0")).alias("run"))


def run_name(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32) + x


def runs(bits: DataFrame) -> DataFrame:
    """(image_id, run, y, x0, x1) of the runs of ink, x1 is behind the last pixel."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    ink = bits.where("v = 1").withColumn("island", F.col("x") - F.row_number().over(row))
    each = ink.groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return each.select("image_id", run_name(F.col("y"), F.col("x0")).alias("run"), "y", "x0", "x1")


def links(found: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, a, b): runs that touch, a in the row above b. Pairs meet in cells of their row, and count in the first they share."""
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity {connectivity} is neither 4 nor 8")
    beyond = 1 if connectivity == 8 else 0
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor((hi - 1) / CELL)))
    above = found.select("image_id", F.col("run").alias("a"), (F.col("y") + 1).alias("y"), (F.col("x0") - beyond).alias("a0"), (F.col("x1") + beyond).alias("a1"))
    above = above.withColumn("cell", cells(F.col("a0"), F.col("a1")))
    below = found.select("image_id", F.col("run").alias("b"), "y", "x0", "x1").withColumn("cell", cells(F.col("x0"), F.col("x1")))
    both = met(above, below, ["image_id", "y", "cell"]).where((F.col("a0") < F.col("x1")) & (F.col("x0") < F.col("a1")))
    return both.where(F.floor(F.greatest("a0", "x0") / CELL) == F.col("cell")).select("image_id", "a", "b")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(image_id, run, root) of all runs with a link: root is the smallest run reachable.

    Each round, a run and its parent take the smallest grandparent among the run's neighbours, then
    pointers jump over one parent. Rounds grow with the logarithm of a component's extent; each
    is written, as executors may go.
    """
    both = cut(edges.select("image_id", F.col("a").alias("run"), F.col("b").alias("near")).unionByName(edges.select("image_id", F.col("b").alias("run"), F.col("a").alias("near"))))
    state = both.groupBy(*RUN).agg(F.least(F.min("near"), F.first("run")).alias("up")).withColumn("top", F.col("up"))
    state = cut(state)
    while True:
        near = state.select("image_id", F.col("run").alias("near"), F.col("top").alias("theirs"))
        heard = met(both, near, ["image_id", "near"]).groupBy(*RUN).agg(F.min("theirs").alias("theirs"))
        told = met(state, heard, RUN).withColumn("least", F.least("theirs", "top"))
        hooks = told.select("image_id", F.col("up").alias("run"), "least").unionByName(told.select(*RUN, "least")).groupBy(*RUN).agg(F.min("least").alias("least"))
        moved = cut(met(state, hooks, RUN).select(*RUN, F.least("up", "least").alias("up"), F.col("up").alias("was"), F.col("top").alias("topped")))
        parents = moved.select("image_id", F.col("run").alias("up"), F.col("up").alias("top"))
        after = cut(met(moved, parents, ["image_id", "up"]))
        if after.where("up <> was or top <> topped").isEmpty():
            return after.select(*RUN, F.col("top").alias("root"))
        state = after.select(*RUN, "up", "top")


def labelled(found: DataFrame, connectivity: int) -> DataFrame:
    """runs with root, the first run of their component. found is written already."""
    roots = smallest_reachable(links(found, connectivity))
    return met(found, roots, RUN, "left").withColumn("root", F.coalesce("root", "run"))


def components(bits: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, root, x0, y0, x1, y1, pixels) with half-open bounds."""
    each = labelled(cut(runs(bits)), connectivity).groupBy("image_id", "root")
    bounds = (F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))
    return each.agg(*bounds, F.sum(F.col("x1") - F.col("x0")).cast("int").alias("pixels"))


def seed_fill(seeds: DataFrame, mask: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, y, x) of the mask's components that hold a seed."""
    marks = seeds.where("v = 1").select("image_id", "y", "x")
    dots = cut(inked_runs(mask))
    each = labelled(cut(dots.groupBy(*RUN, "y").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))), connectivity).select(*RUN, "root")
    each = cut(each)
    hit = met(met(dots, marks, ["image_id", "y", "x"], "left_semi").select(*RUN).distinct(), each, RUN).select("image_id", "root").distinct()
    return met(dots, met(each, hit, ["image_id", "root"], "left_semi"), RUN).select("image_id", "y", "x")


def distance(bits: DataFrame) -> DataFrame:
    """(image_id, y, x, d) of ink: city-block distance to paper or the outside, at most 255.

    Two passes of running minima, as the distance is a sum over the axes: along a row to the
    nearest paper, then down and up a column over those plus the rows between.
    """
    sized = bits.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    row = Window.partitionBy("image_id", "y").orderBy("x")
    paper = F.when(F.col("v") == 0, F.col("x"))
    left = F.coalesce(F.last(paper, True).over(row.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    right = F.coalesce(F.first(paper, True).over(row.rowsBetween(0, Window.unboundedFollowing)), F.col("w"))
    along = bits.join(sized, "image_id").withColumn("g", F.least(F.col("x") - left, right - F.col("x")))
    column = Window.partitionBy("image_id", "x").orderBy("y")
    down = F.least(F.min(F.col("g") - F.col("y")).over(column.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)) + F.col("y")
    up = F.least(F.min(F.col("g") + F.col("y")).over(column.rowsBetween(0, Window.unboundedFollowing)), F.col("h")) - F.col("y")
    return along.withColumn("d", F.least(down, up, F.lit(255)).cast("int")).where("v = 1").select("image_id", "y", "x", "d")
