"""Image files as rows of gray pixels; and rows of pixels to and from dense images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, pix): Spark's image source; colour becomes luma, the origin (0, 0)."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def luma(data: pd.Series, channels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        def one(d: bytes, c: int, h: int, w: int) -> bytes:
            a = np.frombuffer(d, np.uint8).reshape(h, w, c)
            return a.tobytes() if c == 1 else raster.gray(a[:, :, 2::-1]).tobytes()  # stored as blue, green, red

        return pd.Series([one(*r) for r in zip(data, channels, height, width)])

    return rows.select(F.col("origin").alias("path"), "width", "height", luma("data", "nChannels", "height", "width").alias("pix"))


#: Pixels of a batch that explode_pixels hands on.
BATCH = 1 << 18


def explode_pixels(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(image_id, y, x, v) of images(key, width, height, pix), in batches of whole arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, w, pix in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                v = np.frombuffer(pix.as_buffer(), np.uint8) if pix.is_valid else np.zeros(0, np.uint8)
                for i in range(0, len(v), BATCH):
                    y, x = np.divmod(np.arange(i, min(i + BATCH, len(v)), dtype=np.int32), np.int32(w))
                    yield pa.RecordBatch.from_arrays([pa.repeat(image, len(y)), pa.array(y), pa.array(x), pa.array(v[i : i + BATCH].astype(np.int32))], ["image_id", "y", "x", "v"])

    rows = images.select(F.col(key).alias("image_id"), F.col("width").cast("int"), "pix")
    return rows.mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, y int, x int, v int")


def dense_images(pixels: DataFrame) -> DataFrame:
    """(line_id, width, height, pix) of pixels(image_id, y, x, v); rows of an image must be complete."""
    sorted_ = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    hexed = F.array_join(F.transform(sorted_, lambda p: F.lpad(F.hex(p["v"]), 2, "0")), "")
    out = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), hexed.alias("h"))
    return out.select(F.col("image_id").alias("line_id"), "width", "height", F.unhex("h").alias("pix"))
