"""Recognition over a stream of line images: an addition, the batch plan on readStream.

Rows carry no state from one another, so any trigger and any number of executors give the
results of a batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.recognize import LINES, Recognizer, recognize_lines


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of line images as they arrive under a path."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def recognize_stream(lines: DataFrame, recognizer: Recognizer, out: str, checkpoint: str) -> StreamingQuery:
    """Appends recognised lines as Parquet, exactly once for each input file."""
    return recognize_lines(lines, recognizer).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
