"""The stats clause: grouped aggregates, and what could not be placed."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.dsl.syntax import Aggregate, Bin, DslError, Key, bin_text
from tributary.dsl.timeexpr import local, midnight
from tributary.functions import scalar
from tributary.functions.scratch import stored
from tributary.plans.schema import Schema
from tributary.plans.session import Logs, Plan

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Rows of which quantiles are taken group by group; of more, the values are dealt out by ranges.
MOST_VALUES = 5_000_000


class NonNumericField(DslError):
    def __init__(self, name: str, sample: str | None):
        super().__init__(f"no value of {name!r} is a number" + (f"; one is {sample!r}" if sample is not None else ""))


def numeric(schema: Schema, name: str) -> Column:
    """A field as numbers; booleans are 1 and 0, times are not numbers."""
    kind, c = schema.kind(name), schema.column(name)
    if kind in ("timestamp_ntz", "timestamp"):
        return F.lit(None).cast("double")
    return scalar.try_double(c) if kind == "string" else c.cast("double")


def aggregate_column(a: Aggregate, schema: Schema) -> Column:
    """count and count_distinct are exact; quantiles interpolate."""
    if a.name == "count":
        return F.count(F.lit(1)) if a.field is None else F.count(schema.column(a.field))
    if a.name == "count_distinct":
        return F.count_distinct(schema.column(a.field))
    value = numeric(schema, a.field)
    if a.name in QUANTILES:
        return F.percentile(value, QUANTILES[a.name])
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.name](value)


def key_name(key: Key | Bin) -> str:
    return f"bin({bin_text(key.seconds)})" if isinstance(key, Bin) else key.field


def origin(logs: Logs, plan: Plan) -> int:
    """Bins start at the local midnight before the window (or the data) starts."""
    start = plan.window[0] if plan.window[0] is not None else logs.span[0]
    if start is None:
        return 0
    zone = logs.context().tz
    return midnight(local(start, zone).date(), zone)


def key_column(key: Key | Bin, logs: Logs, plan: Plan) -> Column:
    return scalar.bins(F.col("ts"), key.seconds, origin(logs, plan)) if isinstance(key, Bin) else logs.schema.column(key.field)


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles for each group, however many values it has.

    Distinct values with their counts are dealt out by ranges of (keys, value) and
    stored; sums a range and group tell the ranks at which each range begins, so that a
    group may span many tasks. Columns: the keys, and one for each name wanted.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_value"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counted.repartitionByRange(parts, *keys, value).withColumn("range_no", F.spark_partition_id()), "values")
    before = Window.partitionBy(*keys).orderBy("range_no")
    sums = dealt.groupBy(*keys, "range_no").agg(F.sum("n_value").alias("n_range"))  # a group's rows are as many as its ranges
    sums = sums.withColumn("start", F.sum("n_range").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_range"))
    sums = sums.withColumn("total", F.sum("n_range").over(Window.partitionBy(*keys))).drop("n_range")
    joined = [*keys, "range_no"]
    sums = sums.toDF(*(f"of_{c}" if c in joined else c for c in sums.columns))
    placed = dealt.join(sums, reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in joined])).drop(*(f"of_{c}" for c in joined))
    own = Window.partitionBy(*keys, "range_no").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.col("start") + F.sum("n_value").over(own)).withColumn("begin", F.col("end") - F.col("n_value"))
    out = []
    for name, share in wanted.items():
        rank = (F.col("total") - 1) * share
        held = lambda at: F.max(F.when((F.col("begin") <= at) & (at < F.col("end")), F.col(value)))
        low, high, part = held(F.floor(rank)), held(F.ceil(rank)), F.max(rank - F.floor(rank))
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return placed.groupBy(*keys).agg(*out)


def aggregated(rows: DataFrame, keys: list[Column], wanted: list[Aggregate], made: list[Column], schema: Schema, most: int) -> DataFrame:
    """Rows grouped by ``keys``, with one column an aggregate; large tables get their quantiles in another way, to the same values."""
    special = [a for a in wanted if a.name in QUANTILES]
    if not special or rows.limit(most + 1).count() <= most:
        return rows.groupBy(*keys).agg(*made) if keys else rows.agg(*made)
    names = [f"key_{n}" for n in range(len(keys))]
    fields = {a.field: f"value_{n}" for n, a in enumerate(special)}
    keyed = rows.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    others = [m for a, m in zip(wanted, made) if a not in special]
    out = keyed.groupBy(*names).agg(*(others or [F.count(F.lit(1)).alias("n_rows")]))
    for name, column in fields.items():
        of_field = {a.label: QUANTILES[a.name] for a in special if a.field == name}
        found = quantiles(rows.select(*[k.alias(n) for k, n in zip(keys, names)], numeric(schema, name).alias(column)), names, column, of_field)
        if names:
            found = found.toDF(*[f"own_{n}" for n in names], *of_field)
            out = out.join(found, reduce(and_, [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in names]), "left").drop(*[f"own_{n}" for n in names])
        else:
            out = out.crossJoin(F.broadcast(found))  # one row each
    labels = [key.alias(made_name) for key, made_name in zip([F.col(n) for n in names], _labels(rows, keys))]
    return out.select(*labels, *[F.col(f"`{a.label}`") for a in wanted])


def _labels(rows: DataFrame, keys: list[Column]) -> list[str]:
    return rows.select(*keys).columns if keys else []


def stats(logs: Logs, plan: Plan, names: tuple[str, ...] | None = None, most: int = MOST_VALUES) -> DataFrame:
    """The clause's result. Grouping skips records that lack a key; without ``by`` there is always one row.

    Ordered by the bin and the other keys, or else by the first aggregate
    downwards and the keys. ``names`` rename the columns, keys first.
    """
    clause = plan.stats
    if clause is None:
        raise DslError("there is no stats clause")
    rows = logs.matching(plan)
    made = [aggregate_column(a, logs.schema).alias(a.label) for a in clause.aggregates]
    keys = [key_column(k, logs, plan).alias(key_name(k)) for k in clause.by]
    labels = [key_name(k) for k in clause.by] + [a.label for a in clause.aggregates]
    if keys:
        # what is aggregated is projected first, so that a shuffle carries no more
        present = reduce(and_, [key_column(k, logs, plan).isNotNull() for k in clause.by])
        rows = rows.where(present)
        out = aggregated(rows, keys, clause.aggregates, made, logs.schema, most)
        quoted = [F.col(f"`{key_name(k)}`") for k in clause.by]
        if any(isinstance(k, Bin) for k in clause.by):
            order = sorted(range(len(quoted)), key=lambda n: not isinstance(clause.by[n], Bin))
            out = out.orderBy(*[quoted[n].asc() for n in order])
        else:
            out = out.orderBy(F.col(f"`{clause.aggregates[0].label}`").desc_nulls_last(), *[q.asc() for q in quoted])
    else:
        out = aggregated(rows, [], clause.aggregates, made, logs.schema, most)
    return out.toDF(*names) if names else out.select(*[F.col(f"`{x}`") for x in labels])


@dataclass
class Population:
    """What a stats result covers."""

    matched: int = 0
    grouped: int = 0
    absent: dict[str, int] = field(default_factory=dict)
    undated: int = 0
    empty_bins: int = 0
    notes: list[str] = field(default_factory=list)


def population(logs: Logs, plan: Plan) -> DataFrame:
    """One row: matched, grouped, no_timestamp, one absent_<key> a key, and empty_bins if there is a bin."""
    clause = plan.stats
    keys = {key_name(k): key_column(k, logs, plan) for k in clause.by}
    present = reduce(and_, [c.isNotNull() for c in keys.values()]) if keys else F.lit(True)
    parts = [F.count(F.lit(1)).alias("matched"), F.count_if(present).alias("grouped"), F.count_if(F.col("ts").isNull()).alias("no_timestamp")]
    parts += [F.count_if(c.isNull()).alias(f"absent_{name}") for name, c in keys.items()]
    for k in clause.by:
        if isinstance(k, Bin):
            start = F.when(present, keys[key_name(k)])
            filled = (F.timestamp_diff("SECOND", F.min(start), F.max(start)) / k.seconds).cast("long") + 1 - F.count_distinct(start)
            parts.append(F.coalesce(filled, F.lit(0)).cast("long").alias("empty_bins"))
    return logs.matching(plan).agg(*parts)


def probe(logs: Logs, plan: Plan) -> list[str]:
    """Notes on the aggregated fields; an error if a numeric aggregate has no number to work on. One pass."""
    clause, parts = plan.stats, []
    wanted = [a for a in clause.aggregates if a.field is not None]
    for n, a in enumerate(wanted):
        c, value = logs.schema.column(a.field), numeric(logs.schema, a.field)
        parts += [F.count(c).alias(f"p{n}"), F.count(value).alias(f"n{n}"), F.min(F.when(value.isNull(), c.cast("string"))).alias(f"s{n}")]
    if not parts:
        return []
    row = logs.matching(plan).agg(F.count(F.lit(1)).alias("all"), *parts).first()
    notes = []
    for n, a in enumerate(wanted):
        there, numbers, sample = row[f"p{n}"], row[f"n{n}"], row[f"s{n}"]
        if a.name not in ("count", "count_distinct"):
            if there and not numbers:
                raise NonNumericField(a.field, sample)
            if numbers < there:
                notes.append(f"{there - numbers} of {there} values of {a.field} are no numbers, for example {sample!r}")
        if there < row["all"]:
            notes.append(f"{row['all'] - there} of {row['all']} records have no {a.field}")
    return notes


def disclosed(logs: Logs, plan: Plan) -> Population:
    row = population(logs, plan).first().asDict()
    return Population(row["matched"], row["grouped"], {k.removeprefix("absent_"): v for k, v in row.items() if k.startswith("absent_")}, row["no_timestamp"], row.get("empty_bins", 0), probe(logs, plan))


UTC = timezone.utc
