"""Record listings: pages, neighbours, folded runs, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.predicates import holds
from tributary.functions.scratch import stored
from tributary.plans.session import Logs, Plan

LISTED = ("ts", "level", "source", "message")
DISPLAY_LIMIT = 200


def ordered(df: DataFrame, newest: bool = False) -> DataFrame:
    """By time, records without one last; ties by ingest order."""
    ts = F.col("ts")
    return df.orderBy(ts.desc_nulls_last(), F.desc("seq")) if newest else df.orderBy(ts.asc_nulls_last(), F.asc("seq"))


def records(logs: Logs, plan: Plan, limit: int = DISPLAY_LIMIT, offset: int = 0, newest: bool = False, columns: tuple[str, ...] = LISTED) -> DataFrame:
    """One page of matching records; a limit of 0 or less is none."""
    out = ordered(logs.matching(plan), newest)
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit > 0 else out
    return out.select(*columns)


@dataclass
class Page:
    rows: list
    truncated: bool
    total: int


def page(logs: Logs, plan: Plan, limit: int = DISPLAY_LIMIT, **kw) -> Page:
    """Rows for display with the true total, which is counted only if there are more."""
    if limit <= 0:
        rows = records(logs, plan, 0, **kw).collect()
        return Page(rows, False, len(rows))
    rows = records(logs, plan, limit + 1, **kw).collect()
    more = len(rows) > limit
    return Page(rows[:limit], more, count(logs, plan).first()["n"] if more else len(rows) + kw.get("offset", 0))


def count(logs: Logs, plan: Plan) -> DataFrame:
    return logs.matching(plan).agg(F.count(F.lit(1)).alias("n"))


#: Records of a file that one window of ``context`` spans.
CONTEXT_BLOCK = 100_000


def context(logs: Logs, plan: Plan, n: int, columns: tuple[str, ...] = (*LISTED, "line_no"), block: int = CONTEXT_BLOCK) -> DataFrame:
    """Matching records and their neighbours: up to ``n`` away in the same file by ingest order, each once, with ``hit``.

    A range frame over ingest order, instead of a self-join that would pair a
    file with itself. A file is cut into blocks of ``block`` records, and the hits
    within ``n`` of a block's edge also go to the block beyond it, so a large
    file is many windows and only hits near edges are there twice.
    """
    block = max(block, 2 * n + 1)
    near = Window.partitionBy("file", "block").orderBy("seq").rangeBetween(-n, n)
    marked = logs.table.withColumn("hit", holds(plan.where)).select("seq", "file", "hit", *columns)
    own = F.floor(F.col("seq") / block)
    beyond = F.when(F.col("hit") & (F.col("seq") - n < own * block), own - 1).when(F.col("hit") & (F.col("seq") + n >= (own + 1) * block), own + 1)
    dealt = marked.withColumn("own", own).withColumn("block", F.explode(F.array_compact(F.array(own, beyond))))
    close = dealt.withColumn("near", F.max("hit").over(near)).where("near AND block = own")
    return close.orderBy("seq").select("seq", "file", "hit", *columns)


def fold(logs: Logs, plan: Plan, by: str = "pattern_id") -> DataFrame:
    """Runs of consecutive records of one template: repeats, and ts, level, source, message of the first.

    Global order without one big window: rows are range-partitioned by time and
    runs are cut in each partition. The runs are stored, as what follows reads
    them twice and must see the same partitions; then the two at most at each
    partition's edges are joined up.
    """
    parts = int(logs.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = logs.matching(plan).select("ts", "seq", "level", "source", "message", F.col(by).alias("key"))
    order = [F.col("ts").asc_nulls_last(), F.col("seq").asc()]
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part").orderBy(*order)
    same = F.col("key").eqNullSafe(F.lag("key").over(own)) & (F.row_number().over(own) > 1)
    runs = dealt.withColumn("run", F.sum((~same).cast("int")).over(own))
    first = F.min(F.struct(F.col("ts").isNull().alias("undated"), "ts", "seq", "level", "source", "message"))
    runs = runs.groupBy("part", "run", "key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    edge = Window.partitionBy("part").orderBy("run")
    marked = stored(runs.withColumn("is_last", F.lead("run").over(edge).isNull()), "runs")
    inner = marked.where("run > 1 AND NOT is_last").select("n", "first", "key")
    edges = marked.where("run = 1 OR is_last")  # two rows a partition at most
    line = Window.orderBy("part", "run")
    again = F.col("key").eqNullSafe(F.lag("key").over(line)) & (F.row_number().over(line) > 1) & ((F.col("run") == 1) & (F.lag("part").over(line) != F.col("part")))
    joined = edges.withColumn("group", F.sum((~again).cast("int")).over(line)).groupBy("group", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    out = inner.unionByName(joined.select("n", "first", "key"))
    out = out.orderBy(F.col("first.undated"), F.col("first.ts"), F.col("first.seq"))
    return out.select(F.col("n").alias("repeats"), "first.ts", "first.level", "first.source", "first.message")
