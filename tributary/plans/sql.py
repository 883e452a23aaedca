"""Raw SQL over the logs table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tributary.plans.session import Logs

SQL_LIMIT = 200


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """Spark SQL over named views; the views are of this call only, and the session's own of these names come back after it."""
    catalog = spark._jsparkSession.sessionState().catalog()
    before = {name: spark.table(name) for name in views if catalog.getTempView(name).isDefined()}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)  # names are resolved here
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


@dataclass
class SqlResult:
    columns: list[str]
    rows: list
    truncated: bool
    total: int


def query(logs: Logs, text: str, limit: int = SQL_LIMIT) -> SqlResult:
    """A user's SQL over ``logs``; rows beyond the limit are counted only if there are any."""
    df = run_sql(logs.table.sparkSession, text, {"logs": logs.table})
    if limit <= 0:
        rows = df.collect()
        return SqlResult(df.columns, rows, False, len(rows))
    rows = df.limit(limit + 1).collect()
    more = len(rows) > limit
    return SqlResult(df.columns, rows[:limit], more, df.count() if more else len(rows))
