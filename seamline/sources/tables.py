"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where Spark runs in one process and the setting is absent."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    work_folder.own = getattr(work_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='seamline-work-')}"
    return work_folder.own


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read back: what follows starts from it, also after lost executors."""
    path = f"{work_folder(df.sparkSession)}/seamline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
