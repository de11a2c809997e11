"""Recurrences over sequences that Spark deals out, and integer layers.

Tensors are (line_id, y, x, features). A row of a line is one sequence, a line image at most a
row of the table; any number of them splits over tasks. Sequences of one length advance
together, an array operation for each step. Weights are a one-row table, as large as the layer,
which each task gets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tensor
from .decode import let

#: Names of the gates in the order of their matrices; the fifth weighs the state of the row above.
GATES = ("cell", "input", "forget", "output", "above")
#: Values of features and states that advance together.
CELLS = 1 << 20


def spread(tensors: DataFrame, *keys: str) -> DataFrame:
    """tensors dealt to all cores by their sequences: steps are work, however few bytes they read, so small partitions are not to be joined."""
    spark = tensors.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tensors.repartition(n, *keys)


def gate_table(spark: SparkSession, gates: list[np.ndarray]) -> DataFrame:
    """One row (w): a matrix by gate, the bias last in each row."""
    return spark.createDataFrame([([g.tolist() for g in gates],)], "w array<array<array<double>>>")


def advanced(batch: pa.RecordBatch, sides: int, weight: int, kernel) -> Iterator[pa.RecordBatch]:
    """Results of kernel, (n, rows, columns, features) to the like, for a batch (line_id, y, h_, w_, at); sequences of one size together."""
    at = batch.column("at")
    begin = np.concatenate(([0], np.cumsum(np.diff(at.offsets.to_numpy()))))
    places = at.flatten()
    flat = places.flatten().to_numpy().reshape(len(places), -1) if len(places) else np.zeros((0, 1))
    sizes = np.stack([batch.column(c).to_numpy() for c in ("h_", "w_")], axis=1)
    for h, w in np.unique(sizes, axis=0):
        mine = np.flatnonzero((sizes == (h, w)).all(1))
        step = max(1, CELLS // int(h * w * (flat.shape[1] + weight)))
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            out = kernel(flat[begin[part][:, None] + np.arange(h * w)].reshape(len(part), h, w, -1))
            n, rows, cols, size = out.shape
            y, x = np.indices((rows, cols))
            who = pa.array(np.repeat(part, rows * cols))
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), pa.array(out.ravel(), pa.float32()))
            ys = batch.column("y").take(who) if sides == 1 else pa.array(np.tile(y.ravel(), n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("line_id").take(who), ys, pa.array(np.tile(x.ravel(), n), pa.int32()), lists], ["line_id", "y", "x", "features"])


def folded(rows: DataFrame, sides: int, weight: int, kernel) -> DataFrame:
    """(line_id, y, x, features) of rows (line_id, y, h_, w_, at); y is that of rows where they have one side, else a place's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from advanced(batch, sides, weight, kernel)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    y = kinds["y"] if sides == 1 else "int"
    return rows.select("line_id", "y", "h_", "w_", "at").mapInArrow(run, f"line_id {kinds['line_id']}, y {y}, x int, features array<float>")


def lstm(tensors: DataFrame, gates: DataFrame, size: int, summary: bool = False) -> DataFrame:
    """(line_id, y, x, features): each row of a line through an LSTM of size cells, from left to right; with summary only the last place, as x = 0.

    A place sees its features and the outputs before it.
    """
    weights = [np.array(g) for g in gates.first()["w"]]
    places = F.sort_array(F.collect_list(F.struct("x", F.col("features").cast("array<double>").alias("features"))))
    rows = spread(tensors, "line_id", "y").groupBy("line_id", "y").agg(places["features"].alias("at"))
    rows = rows.withColumns({"h_": F.lit(1), "w_": F.size("at")})
    return folded(rows, 1, 6 * size, lambda x: tensor.lstm(x[:, 0], weights, summary)[:, None])


def lstm_2d(tensors: DataFrame, gates: DataFrame, size: int) -> DataFrame:
    """(line_id, y, x, features): a line image through a two-dimensional LSTM, from its upper left corner.

    A place sees its features, the outputs left of it and those above it; the fifth gate weighs the
    state above. Steps go along diagonals, whose places depend on the diagonal before alone.
    Places must be complete.
    """
    weights = [np.array(g) for g in gates.first()["w"]]
    places = F.sort_array(F.collect_list(F.struct("y", "x", F.col("features").cast("array<double>").alias("features"))))
    rows = spread(tensors, "line_id").groupBy("line_id").agg(places["features"].alias("at"), (F.max("x") + 1).alias("w_"), (F.max("y") + 1).alias("h_"))
    return folded(rows.withColumn("y", F.lit(0)), 2, 4 * size, lambda x: tensor.lstm_2d(x, weights))


# -- layers of 8-bit integers ---------------------------------------------------

STEPS = 127


def scale_of(values: Column) -> Column:
    """What one step of 127 stands for; 0 for a row of zeros."""
    return F.aggregate(values, F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double")))) / STEPS


def steps(values: Column, scale: Column) -> Column:
    """values in whole steps of -127 to 127, halves away from zero."""
    return F.transform(values, lambda v: F.when(scale > 0, F.round(v.cast("double") / scale)).otherwise(0).cast("int"))


def quantised(weights: DataFrame) -> DataFrame:
    """One row (q, s, b) of one row (w), rows with the bias last: whole weights and scale by row, biases as they are."""
    row = lambda r: F.slice(r, 1, F.size(r) - 1)
    both = F.transform("w", lambda r: let(scale_of(row(r)), lambda s: F.struct(steps(row(r), s).alias("q"), s.alias("s"), F.element_at(r, -1).alias("b"))))
    return weights.select(F.explode(F.array(both)).alias("rows")).select(*(F.col(f"rows.{n}") for n in ("q", "s", "b")))


def integer_layer(tensors: DataFrame, weights: DataFrame) -> DataFrame:
    """tensors with dots, the exact whole products of steps, features, what they stand for, and bound, by how much each may differ from the unquantised layer.

    weights is quantised()'s row. Each place has its own scale; a product of n steps is below
    n * 16,129, which longs hold exactly. Rounding moves a weight or a feature by half a step
    at most, which gives the bound.
    """
    placed = tensors.join(F.broadcast(weights)).withColumn("xs", scale_of(F.col("features"))).withColumn("xq", steps(F.col("features"), F.col("xs")))
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("xq"), lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda t, v: t + v)
    placed = placed.withColumn("dots", F.transform("q", dot))
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + F.abs(x.cast("double")))
    near = lambda row, s: (size(row) * s * F.col("xs") + size(F.col("features")) * s) / 2 + F.size(row) * s * F.col("xs") / 2
    value = F.transform("dots", lambda d, k: d * F.get("s", k) * F.col("xs") + F.get("b", k))
    bound = F.transform("q", lambda row, k: near(row, F.get("s", k)))
    return placed.select("line_id", "y", "x", "dots", value.alias("features"), bound.alias("bound"))
