"""Other tables as logs tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.template import id_column, template_column


def logs_from_events(events: DataFrame, templates: bool = False) -> DataFrame:
    """An events table as logs: some times, levels and parses are planted as missing."""
    out = events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"),
        (F.col("event_id") % 7 != 0).alias("ts_zoned"),
        F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'audit' WHEN 'view' THEN NULL ELSE 'info' END").alias("level"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("logs/svc-"), (F.col("user_id") % 4).cast("string"), F.lit(".log")).alias("file"),
        F.lit("jsonl").alias("format"),
        (F.col("event_id") + 1).alias("line_no"),
        (F.col("event_id") % 97 != 0).alias("parsed"),
        F.col("props").alias("raw"),
        F.col("props").alias("fields"),
        F.from_json("props", "map<string,string>").alias("bag"),
        F.lit(None).cast("map<string,string>").alias("kinds"),
        "user_id",
        "value",
        "event_type",
    )
    if templates:
        out = out.withColumn("pattern", template_column(F.col("message"))).withColumn("pattern_id", id_column(F.col("pattern")))
    else:
        out = out.withColumn("pattern", F.concat("event_type", F.lit(" by user <num>"))).withColumn("pattern_id", id_column(F.col("pattern")))
    return out
