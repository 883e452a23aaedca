"""Windowed counts over a stream of dated rows; late rows are kept apart, never lost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(stream: DataFrame, ts: str) -> tuple[str, DataFrame]:
    """A watermark needs a zoned timestamp; results are cast back the same way."""
    return dict(stream.dtypes)[ts], stream.withColumn(ts, F.col(ts).cast("timestamp"))


def binned(stream: DataFrame, ts: str, width: str, keys: list[str], watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(bin, keys, n): tumbling or sliding windows by event time."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    kind, timed = _timed(stream, ts)
    return timed.withWatermark(ts, watermark).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast(kind).alias("bin"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """(start, end, keys, n): runs of rows with no gap longer than ``gap``."""
    kind, timed = _timed(stream, ts)
    return timed.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), *keys, "n")


def run_to_table(spark: SparkSession, result: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a streaming result over all there is now; what it wrote, read back from ``folder``."""
    out = f"{folder}/out-{uuid.uuid4().hex}"

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables as a file stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a pattern, as a table may be a file or a folder
