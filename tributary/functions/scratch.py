"""Tables that are read more than once: written to the shared folder, so every reader sees the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a private one only where that is unset and one machine does all the work."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not _private:
        _private.append(tempfile.mkdtemp(prefix="tributary-"))
        atexit.register(shutil.rmtree, _private[0], True)
    return _private[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in this application's part of the shared folder."""
    return f"{shared_folder(spark)}/tributary/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
