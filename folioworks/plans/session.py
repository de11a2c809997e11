"""Sessions: one for this machine, and what queries need of a session that others made."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "20g", partitions: int = 8) -> SparkSession:
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("folioworks").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of local applications that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only on one machine one of our own may stand in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="folioworks-")
        base = _OWN[app]
    return base


def shared_path(spark: SparkSession) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_folder(spark)}/folioworks/{uuid.uuid4().hex}"


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Has what lies at a shared_path, and is written already, deleted when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """df, written once as Parquet at a shared_path and read from there.

    Unlike checkpoint(), whose result keeps the constraints and statistics of the plan before
    it, the result is a plain table, so plans of many rounds stay small. Tables are deleted
    when the application ends.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    discard_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> SparkSession:
    """Makes this package importable for Python workers that run where the driver does.

    On a cluster the package is installed or shipped with the job; there the entry is harmless.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark
