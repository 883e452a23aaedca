"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}

#: Keys that are broadcast at most; parts that a hot key is dealt out to beyond that.
MOST_KEYS, SALTS = 500_000, 16

#: Records and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    A private one only where that is unset and one machine does all the work.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {_SETTING} to a folder that all executors see")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tributary-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def _folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tributary-llm/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    What follows starts from files, so a lost executor costs only its running tasks.
    """
    bounded_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that are read from them must have been stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, unless it has set bounds of its own: texts may be very long."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if (full := f"spark.sql.execution.arrow.{name}") not in spark.conf.getAll:
            spark.conf.set(full, str(bound))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(rows: DataFrame, keys: DataFrame, key: str, salt: str) -> DataFrame:
    """Left join with a table of distinct keys, of which each is dealt out to SALTS parts by the column ``salt`` of the rows."""
    part = fresh([*rows.columns, *keys.columns], "part")
    dealt = keys.withColumn(part, F.explode(F.array(*(F.lit(n) for n in range(SALTS)))))
    return rows.withColumn(part, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [key, part], "left").drop(part)


def looked_up(rows: DataFrame, keys: DataFrame, key: str, salt: str, most: int = MOST_KEYS) -> DataFrame:
    """Left join with ``keys``, a stored table of distinct keys.

    Up to ``most`` keys are broadcast; more are joined with salt, as one key may hold a third of the rows.
    """
    return rows.join(F.broadcast(keys), key, "left") if keys.count() <= most else salted_join(rows, keys, key, salt)


def flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str, salt: str, most: int = MOST_KEYS) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether ``keys`` has the row's ``key``."""
    joined = looked_up(rows, keys.select(key, F.lit(True).alias(flag)), key, salt, most)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tokens(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only (bytes.lower and bytes.split know just ASCII)."""
    return raw.lower().split()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
