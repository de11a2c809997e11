"""Columns and reading order of a page's boxes: tab stops, bands between spanning boxes, blocks.

boxes is (page, id, x0, y0, x1, y1) with half-open bounds. Edges are counted by position before
anything else, so tab stops come from histograms as wide as a page, not from its boxes. No box
is compared with another: all order comes from windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recurrent import spread

#: Edges this near to each other support one tab stop; a stop has this share of its page's boxes, and is alone within RADIUS.
NEAR, SHARE, RADIUS = 4, 0.1, 40
#: Empty rows between boxes of a column at which a new block begins.
BREAK = 24


def tab_stops(boxes: DataFrame, near: int = NEAR, share: float = SHARE, radius: int = RADIUS) -> DataFrame:
    """(page, side, x, support): where many left or right edges are aligned.

    support is how many edges are within near; a stop has the most within radius, of equals
    the leftmost.
    """
    edges = boxes.select("page", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("x0").alias("x")), F.struct(F.lit("right").alias("side"), F.col("x1").alias("x")))).alias("e"))
    hist = edges.groupBy("page", "e.side", "e.x").agg(F.count("*").alias("n"))
    side = Window.partitionBy("page", "side")
    within = lambda d: side.orderBy("x").rangeBetween(-d, d)
    held = hist.withColumn("support", F.sum("n").over(within(near))).withColumn("all", F.sum("n").over(side))
    first = F.max(F.struct("support", -F.col("x"))).over(within(radius))
    held = held.withColumn("best", first)
    return held.where((-F.col("best.col2") == F.col("x")) & (F.col("support") >= share * F.col("all"))).select("page", "side", "x", "support")


def placed(boxes: DataFrame, stops: DataFrame, near: int = NEAR) -> DataFrame:
    """boxes with col, the last left stop at or before them (0 if none), and spans: they go on beyond the next.

    A page has fewer stops than its width divided by the radius, so its list is short.
    """
    lists = stops.where("side = 'left'").groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("stops"))
    both = boxes.join(lists, "page", "left").withColumn("stops", F.coalesce("stops", F.array().cast("array<long>")))
    upto = F.size(F.filter("stops", lambda s: s <= F.col("x0") + near))
    beyond = F.exists("stops", lambda s: (s > F.col("x0") + near) & (s < F.col("x1") - near))
    return both.withColumn("col", F.greatest(upto - 1, F.lit(0))).withColumn("spans", beyond).drop("stops")


def reading_order(boxes: DataFrame, stops: DataFrame | None = None, near: int = NEAR, gap: int = BREAK) -> DataFrame:
    """boxes with col, spans, band, block and ord, their place in their page's reading order from 0.

    Boxes that span columns split a page into bands, each below the last; a band is read
    column by column, its spanning box first, a column from above. A box above another in its
    column, or left of it in its band, is read before it. Blocks are the boxes of a band's
    column without a break of more than gap rows, numbered in reading order.
    """
    # all windows below keep this dealing, whose tasks are not joined to few large ones
    each = placed(spread(boxes, "page"), tab_stops(boxes, near) if stops is None else stops, near)
    page = Window.partitionBy("page")
    down = page.orderBy("y0", F.desc("spans"), "x0", "id", "x1", "y1")
    each = each.withColumn("band", F.sum(F.col("spans").cast("int")).over(down)).withColumn("c", F.when(F.col("spans"), -1).otherwise(F.col("col")))
    column = Window.partitionBy("page", "band", "c").orderBy("y0", "x0", "id", "x1", "y1")
    reached = F.max("y1").over(column.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("starts", F.coalesce((F.col("y0") - reached > gap).cast("int"), F.lit(1)))
    order = page.orderBy("band", "c", "y0", "x0", "id", "x1", "y1")
    each = each.withColumn("ord", F.row_number().over(order) - 1).withColumn("block", F.sum("starts").over(order) - 1)
    return each.select(*boxes.columns, "col", "spans", F.col("band").cast("int").alias("band"), F.col("block").cast("int").alias("block"), "ord")


def blocks(ordered: DataFrame) -> DataFrame:
    """(page, block, band, col, spans, x0, y0, x1, y1, n) of reading_order's blocks."""
    bounds: list[Column] = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return ordered.groupBy("page", "block", "band", "col", "spans").agg(*bounds, F.count("*").alias("n"))
