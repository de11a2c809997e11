"""Boxes: range join through grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut

#: Rows of query boxes, or of queries, that every task may get (of seven longs at most, so under 24 MB).
FEW = 1 << 18
#: Boxes that a task gets, in the mean: it holds them without a spill, and a dictionary of 1 MB (Parquet's) their ids.
DEALT = 100_000
#: An id's boxes are held against each other up to so many; of more, its pairs are.
HELD = 4
BOX = ["x0", "y0", "x1", "y1"]


def cells(boxes: DataFrame, size: int, bounds: tuple[int, int, int, int]) -> DataFrame:
    """boxes, once for each cell they touch; what lies outside the bounds falls to the edge cells."""
    x0, y0, x1, y1 = bounds
    if size <= 0 or x1 <= x0 or y1 <= y0:
        raise ValueError("cell size and bounds must be positive")
    nx, ny = -(-(x1 - x0) // size), -(-(y1 - y0) // size)
    at = lambda c, low, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / size))).cast("int")
    last = lambda c, low, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - 1 - low) / size))).cast("int")
    solid = boxes.where("x0 < x1 and y0 < y1")
    wide = solid.withColumn("cx", F.explode(F.sequence(at("x0", x0, nx), last("x1", x0, nx))))
    return wide.withColumn("cy", F.explode(F.sequence(at("y0", y0, ny), last("y1", y0, ny))))


def _few(df: DataFrame) -> tuple[DataFrame, bool]:
    """df, written, and whether all of it may go to every task."""
    df = cut(df)
    return df, df.count() <= FEW


def classes(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, x0, y0, x1, y1), (q, c)): query boxes once each, and the queries that have them.

    Queries of one and the same box are a class, c being its number from 0; a query of several
    boxes is a class of its own, below 0. So a query is in one class only.
    """
    solid = queries.where("x0 < x1 and y0 < y1").select("q", *BOX).distinct()
    each = cut(solid.withColumn("alone", F.count("*").over(Window.partitionBy("q")) == 1))
    one, several = each.where("alone"), each.where("not alone")
    shared = cut(one.select(*BOX).distinct().withColumn("c", F.monotonically_increasing_id()))
    own = cut(several.select(F.col("q").alias("of")).distinct().withColumn("c", -1 - F.monotonically_increasing_id()))
    members = one.join(shared, BOX).select("q", "c").unionByName(own.select(F.col("of").alias("q"), "c"))
    return shared.unionByName(several.join(own, F.col("q").eqNullSafe(F.col("of"))).select(*BOX, "c")), members


def overlapping(queries: DataFrame, boxes: DataFrame, size: int, bounds: tuple[int, int, int, int]) -> DataFrame:
    """(q, id) of boxes that overlap query boxes; half-open, so neighbours that touch do not.

    An equi-join on cells with the exact test as residual. A pair that shares several cells is
    kept in one of them (the one with its intersection's corner). Equal query boxes are joined
    once; of an id's boxes that meet the same query the first makes the pair, both before the
    queries of a class take its pairs; pairs are then written as they are found. Boxes are dealt by
    id, by which they stay where classes are few enough to go to every task. There they are
    sorted by place: neighbours have nearly the same queries, so that files of the pairs, which
    are far more than the boxes, compress well.
    """
    spark = boxes.sparkSession
    x0, y0, x1, y1 = bounds
    shapes, members = classes(queries)
    shapes, few = _few(cells(shapes, size, bounds).select("c", "cx", "cy", *(F.col(c).alias("q" + c) for c in BOX)))
    members, light = _few(members)
    # a stated number of tasks: pairs are far more than the bytes of the boxes let expect
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-boxes.count() // DEALT))
    dealt = boxes.select("id", *BOX).where("x0 < x1 and y0 < y1").repartition(parts, "id").distinct()
    # with each box those before it of the same id, null where there is none
    by = Window.partitionBy("id")
    dealt = dealt.select("*", *(F.lag(c, k).over(by.orderBy(*BOX)).alias(f"{c}_{k}") for k in range(1, HELD) for c in BOX)).withColumn("n", F.count("*").over(by))
    nx, ny = -(-(x1 - x0) // size), -(-(y1 - y0) // size)
    corner = lambda a, b, low, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.greatest(a, b) - low) / size)))
    meets = lambda k: "x0{0} < qx1 and qx0 < x1{0} and y0{0} < qy1 and qy0 < y1{0}".format(k)

    def met(b: DataFrame, held: int) -> DataFrame:
        """(c, id), without pairs that one of the held boxes before makes; the tests that rule out most come first."""
        first = (F.col("cx") == corner("x0", "qx0", x0, nx)) & (F.col("cy") == corner("y0", "qy0", y0, ny))
        for k in range(1, held):
            first &= ~F.coalesce(F.expr(meets(f"_{k}")), F.lit(False))
        return cells(b, size, bounds).join(F.broadcast(shapes) if few else shapes, ["cx", "cy"]).where(F.expr(meets("")) & first).select("c", "id")

    single = met(dealt.where(F.col("n") <= HELD).sortWithinPartitions(F.floor(F.col("y0") * 4 / size), *BOX), HELD)
    # a class of several boxes may meet a box more than once
    single = single if shapes.where("c < 0").isEmpty() else single.distinct()
    found = single.unionByName(met(dealt.where(F.col("n") > HELD), 1).distinct())
    return found.join(F.broadcast(members) if light else members, "c").select("q", "id")
