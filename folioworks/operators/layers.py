"""Operators over tensors(line_id, y, x, features) and layer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timestep(y: Column, x: Column, width: Column) -> Column:
    return y * width + x


def affine(features: Column, weights: Column) -> Column:
    """weights: array of rows with the bias last. Products are added from left to right, the bias at the end."""
    dot = lambda row: F.aggregate(F.zip_with(features, F.slice(row, 1, F.size(row) - 1), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) + F.element_at(row, -1)
    return F.transform(weights, dot)


def fully_connected(tensors: DataFrame, weights: DataFrame, activation) -> DataFrame:
    """Every timestep through a matrix: weights is one row (w array<array<double>>), as small as the model."""
    out = tensors.join(F.broadcast(weights))
    return out.select("line_id", "y", "x", F.transform(affine(F.col("features"), F.col("w")), lambda v: activation(v).cast("float")).alias("features"))


def maxpool(tensors: DataFrame, xs: int, ys: int) -> DataFrame:
    """tensors(line_id, y, x, v) by whole windows; what is left over at the ends is dropped."""
    cell = tensors.groupBy("line_id", F.floor(F.col("y") / ys).cast("int").alias("y"), F.floor(F.col("x") / xs).cast("int").alias("x"))
    return cell.agg(F.max("v").alias("v"), F.count("*").alias("n")).where(F.col("n") == xs * ys).drop("n")


def reconfig(tensors: DataFrame, xs: int, ys: int) -> DataFrame:
    """Windows stacked to features: by column, then by row."""
    at = (F.col("x") % xs) * ys + F.col("y") % ys
    cell = tensors.withColumn("at", at).groupBy("line_id", F.floor(F.col("y") / ys).cast("int").alias("y"), F.floor(F.col("x") / xs).cast("int").alias("x"))
    out = cell.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("features"))
    return out.where(F.size("features") == xs * ys)


def parallel(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features of both at each place, left's first."""
    other = right.withColumnRenamed("features", "more")
    return left.join(other, ["line_id", "y", "x"]).select("line_id", "y", "x", F.concat("features", "more").alias("features"))


def reversed_(tensors: DataFrame, kind: str) -> DataFrame:
    """x or y mirrored within each line, or both axes exchanged."""
    if kind == "transpose":
        return tensors.select(*(F.col({"x": "y", "y": "x"}.get(c, c)).alias(c) for c in tensors.columns))
    size = tensors.groupBy("line_id").agg(F.max(kind).alias("m"))
    return tensors.join(size, "line_id").withColumn(kind, F.col("m") - F.col(kind)).drop("m")


def convolve_interior(tensors: DataFrame, half_x: int, half_y: int) -> DataFrame:
    """(line_id, y, x, v) to stacked neighbourhoods of the places whose whole neighbourhood exists."""
    nx, ny = 2 * half_x + 1, 2 * half_y + 1
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-half_x, half_x + 1) for dy in range(-half_y, half_y + 1)))
    taps = tensors.withColumn("d", F.explode(around)).select("line_id", (F.col("y") - F.col("d.dy")).alias("y"), (F.col("x") - F.col("d.dx")).alias("x"), ((F.col("d.dx") + half_x) * ny + F.col("d.dy") + half_y).alias("at"), "v")
    out = taps.groupBy("line_id", "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("features"))
    return out.where(F.size("features") == nx * ny)


def matrix_stats(weights: DataFrame) -> DataFrame:
    """(layer_id, gate, low, high, mean) of weights(layer_id, gate, row, values); zeros for an empty matrix."""
    each = weights.select("layer_id", "gate", F.explode_outer("values").alias("v")).groupBy("layer_id", "gate")
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return each.agg(zero(F.min("v"), "low"), zero(F.max("v"), "high"), zero(F.avg("v"), "mean"))


def tree(layers: DataFrame) -> DataFrame:
    """(layer_id, depth, path, line, total): the tree in depth-first order of path, and weights below each layer.

    A recursive query; a model has a few dozen layers.
    """
    return layers.sparkSession.sql(
        """
        WITH RECURSIVE t (layer_id, depth, path) AS (
            SELECT layer_id, 0, lpad(CAST(ord AS STRING), 3, '0') FROM {layers} WHERE parent_id IS NULL
            UNION ALL
            SELECT l.layer_id, t.depth + 1, concat(t.path, '.', lpad(CAST(l.ord AS STRING), 3, '0')) FROM {layers} l JOIN t ON l.parent_id = t.layer_id)
        SELECT a.layer_id, a.depth, a.path, any_value(concat(repeat('  ', a.depth), l.type, ' ', l.name, ' ni=', l.ni, ' no=', l.no, ' weights=', l.num_weights)) AS line, sum(m.own_weights) AS total
        FROM t a JOIN t b ON b.path = a.path OR startswith(b.path, concat(a.path, '.'))
        JOIN {layers} l ON l.layer_id = a.layer_id JOIN {layers} m ON m.layer_id = b.layer_id
        GROUP BY a.layer_id, a.depth, a.path""",
        layers=layers,
    )


def weight_check(layers: DataFrame) -> DataFrame:
    """(layer_id, declared, actual, ok): a layer's own elements and its children's declared totals."""
    below = layers.where("parent_id is not null").groupBy(F.col("parent_id").alias("layer_id")).agg(F.sum("num_weights").alias("below"))
    out = layers.join(below, "layer_id", "left").withColumn("actual", F.col("own_weights") + F.coalesce("below", F.lit(0)))
    return out.select("layer_id", F.col("num_weights").alias("declared"), "actual", (F.col("num_weights") == F.col("actual")).alias("ok"))
