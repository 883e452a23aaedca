"""Histogram over time, top values, field catalogue, patterns, sources."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.dsl.syntax import DslError, duration_seconds
from tributary.functions import scalar
from tributary.functions.predicates import holds
from tributary.functions.scratch import stored
from tributary.model import BUILTINS
from tributary.plans.session import Logs, Plan

BUCKETS, TOP_LIMIT, PATTERN_LIMIT, FIELD_LIMIT = 60, 20, 30, 50
#: A field that every record has, to count them in the same pass.
EVERY = "\x00record"
MILLISECOND, SECOND, MINUTE, HOUR, DAY = 1_000, 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: Widths that a histogram bucket may have, in microseconds.
STEPS = (
    MILLISECOND, 10 * MILLISECOND, 100 * MILLISECOND,
    SECOND, 2 * SECOND, 5 * SECOND, 10 * SECOND, 15 * SECOND, 30 * SECOND,
    MINUTE, 2 * MINUTE, 5 * MINUTE, 10 * MINUTE, 15 * MINUTE, 30 * MINUTE,
    HOUR, 2 * HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR,
    DAY, 7 * DAY,
)


def limited(df: DataFrame, limit: int, default: int) -> DataFrame:
    """0 is the default, a negative number no limit."""
    limit = default if limit == 0 else limit
    return df if limit < 0 else df.limit(limit)


def bucket_width(span: int, buckets: int = BUCKETS) -> int:
    """The least step of at least this share of ``span`` microseconds (rounded down to nanoseconds); else the widest."""
    ideal = span * 1000 // max(1, buckets)
    return next((s for s in STEPS if s * 1000 >= ideal), STEPS[-1])


def histogram(logs: Logs, plan: Plan, buckets: int = BUCKETS, width: int | None = None) -> DataFrame:
    """(bucket, level, n) for every bucket of the window and every level seen, zeros included.

    The window is the filter's, else the data's, at least a minute wide.
    Records without a level count under ``none``; those without a time nowhere.
    """
    start, end = plan.window
    if start is None or end is None:
        first, last, _ = logs.span
        start = start if start is not None else first
        end = end if end is not None else (last + 1 if last is not None else None)
    spark = logs.table.sparkSession
    if start is None or end is None:
        return spark.createDataFrame([], "bucket timestamp_ntz, level string, n long")
    if end - start < MINUTE:
        pad = MINUTE - (end - start)
        start, end = start - pad // 2, end + (pad - pad // 2)
    width = width or bucket_width(end - start, buckets)
    origin = start - start % width
    ts = F.col("ts")
    inside = (ts >= scalar.instant(start)) & (ts < scalar.instant(end))
    slot = F.floor((scalar.micros(ts) - F.lit(origin)) / F.lit(width)).cast("long")
    found = logs.matching(plan).where(inside).select(slot.alias("slot"), F.coalesce("level", F.lit("none")).alias("level")).groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"))
    # one entry a bucket is gathered for each level, and the missing ones are zero: no second pass for the grid
    by_level = found.groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("counts"))
    grid = by_level.select("level", "counts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((end - 1 - origin) // width).cast("long"))).alias("slot"))
    out = grid.select(scalar.from_micros(F.lit(origin) + F.col("slot") * F.lit(width)).alias("bucket"), "level", F.coalesce(F.try_element_at("counts", F.col("slot")), F.lit(0)).cast("long").alias("n"))
    return out.orderBy("bucket", "level")


def extraction(logs: Logs, what: str) -> Column:
    """A field; ``/re/`` of the raw text; or ``field~/re/``. A regex gives its first group, or all of it; empty is absent."""
    found = re.fullmatch(r"(?s)(?:(?P<field>[^~/]+)~)?/(?P<re>.+)/", what)
    if not found:
        return logs.schema.column(what).cast("string")
    pattern = found["re"].replace("\\/", "/")
    try:
        groups = re.compile(pattern).groups
    except re.error as problem:
        raise DslError(f"{pattern!r} is not a regular expression: {problem}") from None
    text = logs.schema.column(found["field"]).cast("string") if found["field"] else F.col("raw")
    flags = "" if scalar.has_upper(pattern) else "(?iu)"
    return F.nullif(F.regexp_extract(text, flags + pattern, 1 if groups else 0), F.lit(""))


def top(logs: Logs, plan: Plan, what: str, limit: int = TOP_LIMIT) -> DataFrame:
    """(value, n, share): most frequent values and their share of the records that have one."""
    present = logs.matching(plan).select(extraction(logs, what).alias("value")).where("value IS NOT NULL")
    counts = present.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("present"))  # one row
    out = counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("present")).alias("share"))
    return limited(out.orderBy(F.desc("n"), F.asc("value")), limit, TOP_LIMIT)


def top_totals(logs: Logs, plan: Plan, what: str) -> DataFrame:
    """(matched, present, absent, distinct)"""
    value = extraction(logs, what)
    present = F.count(value)
    return logs.matching(plan).agg(F.count(F.lit(1)).alias("matched"), present.alias("present"), (F.count(F.lit(1)) - present).alias("absent"), F.count_distinct(value).alias("distinct"))


def _long_form(rows: DataFrame, names: list[str]) -> DataFrame:
    """(field, place, value, kind): a row for each field that a record has."""
    sql_kinds = {"string": "string", "bigint": "integer", "int": "integer", "double": "float", "boolean": "boolean", "timestamp_ntz": "timestamp"}
    types = dict(rows.dtypes)
    own = [F.struct(F.lit(n).alias("field"), F.lit("column").alias("place"), F.col(f"`{n}`").cast("string").alias("value"), F.lit(sql_kinds.get(types[n], types[n])).alias("kind")) for n in names]
    bag = F.transform(F.map_entries(F.coalesce("bag", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("field"), F.lit("bag").alias("place"), e["value"].alias("value"), F.coalesce(F.col("kinds")[e["key"]], F.lit("string")).alias("kind")))
    return rows.select(F.inline(F.concat(F.array(*own), bag) if own else bag)).where("value IS NOT NULL")


def fields(logs: Logs, plan: Plan, limit: int = FIELD_LIMIT) -> DataFrame:
    """Per field: records, coverage, distinct, numeric, type, types, place, examples (up to three, most frequent first).

    One pass in long form: values are counted once by (field, value) and stored,
    and all figures come from those counts.
    """
    names = [n for n in BUILTINS if n in logs.table.columns and n not in ("seq", "fields", "raw")]
    rows = logs.matching(plan)
    counted = stored(_long_form(rows.withColumn(EVERY, F.lit("")), [EVERY, *names]).groupBy("field", "place", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "values")
    values = counted.where(F.col("field") != EVERY)
    kind = F.max(F.struct("kind_n", F.col("kind"))).alias("most")
    kinds = values.groupBy("field", "kind").agg(F.sum("n").alias("kind_n")).groupBy("field").agg(kind, F.array_sort(F.collect_set("kind")).alias("types"))
    out = values.groupBy("field").agg(
        F.min("place").alias("place"),
        F.sum("n").alias("records"),
        F.count_distinct("value").alias("distinct"),
        F.sum(F.when(scalar.try_double(F.col("value")).isNotNull(), F.col("n")).otherwise(0)).alias("numeric"),
    )
    # the first three of each of many slices, then of those few: a field with endless values is no single window
    per_value = values.groupBy("field", "value").agg(F.sum("n").alias("n")).withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(256)))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value")))
    best = per_value.withColumn("at", first("field", "slice")).where("at <= 3").withColumn("at", first("field")).where("at <= 3")
    examples = best.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]).alias("examples"))
    out = out.join(examples, "field")
    total = counted.where(F.col("field") == EVERY).select(F.col("n").alias("matched"))  # at most one row
    out = out.join(kinds, "field").crossJoin(F.broadcast(total))
    out = out.select("field", "place", "records", (F.col("records") / F.col("matched")).alias("coverage"), "distinct", "numeric", F.col("most.kind").alias("type"), "types", "examples")
    return limited(out.orderBy(F.desc("coverage"), F.asc("field")), limit, FIELD_LIMIT)


def patterns(logs: Logs, plan: Plan, limit: int = PATTERN_LIMIT, new_since: str | None = None) -> DataFrame:
    """Per template: pattern_id, pattern, n, first, last, undated, unparsed, example, sources, before, new.

    ``new_since`` (a duration back from the newest record) keeps templates with no dated record before it.
    """
    cut = None
    if new_since is not None:
        seconds = duration_seconds(new_since)
        if not seconds:
            raise DslError(f"{new_since!r} is not a duration")
        anchor = logs.now if logs.now is not None else logs.span[1]
        cut = (anchor or 0) - round(seconds * 1e6)
    before = F.count_if(holds(F.col("ts") < scalar.instant(cut))) if cut is not None else F.lit(0).cast("long")
    out = logs.matching(plan).groupBy("pattern_id").agg(
        F.min("pattern").alias("pattern"),
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.count_if(F.col("ts").isNull()).alias("undated"),
        F.count_if(~F.col("parsed")).alias("unparsed"),
        F.min(F.when(F.coalesce("message", F.lit("")) != "", F.col("message")).otherwise(F.col("raw"))).alias("example"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        before.alias("before"),
    )
    if cut is not None:
        out = out.where("before = 0 AND n > undated")
    return limited(out.orderBy(F.desc("n"), F.asc("pattern_id")), limit, PATTERN_LIMIT)


def pattern_totals(logs: Logs, plan: Plan) -> DataFrame:
    """(records, templates, unparsed_records, unparsed_templates)"""
    bad = ~F.col("parsed")
    return logs.matching(plan).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("pattern_id").alias("templates"), F.count_if(bad).alias("unparsed_records"), F.count_distinct(F.when(bad, F.col("pattern_id"))).alias("unparsed_templates"))


def sources(logs: Logs) -> DataFrame:
    """Per source, file and format: records, unparsed, undated, zone_assumed, first, last, zone."""
    dated = F.col("ts").isNotNull()
    out = logs.table.groupBy("source", "file", "format").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col("parsed")).alias("unparsed"),
        F.count_if(~dated).alias("undated"),
        F.count_if(dated & ~F.col("ts_zoned")).alias("zone_assumed"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    zone = F.when(F.col("records") == F.col("undated"), "none").when(F.col("zone_assumed") == 0, "known").when(F.col("zone_assumed") == F.col("records") - F.col("undated"), "assumed").otherwise("mixed")
    return out.withColumn("zone", zone).orderBy("source", "file", "format")


def any_column(parts: list[Column]) -> Column:
    return reduce(or_, parts)
