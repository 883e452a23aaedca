"""A logs table with its schema and time context, and plans over it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.dsl.syntax import DslError, FieldTerm, Query, Stats, TimeTerm, Value, WindowTerm, parse, render
from tributary.dsl.timeexpr import TimeContext, micros, resolve
from tributary.functions.predicates import predicate
from tributary.functions.scalar import micros as micros_of
from tributary.model import Promotion
from tributary.plans.schema import Schema, read_schema

MOST_CANDIDATES = 20


class StatsUnsupported(DslError):
    def __init__(self, operator: str):
        super().__init__(f"{operator} lists records; a stats clause does not belong there")


class UnknownPattern(DslError):
    def __init__(self, name: str, near: list[str]):
        super().__init__(f"no pattern begins with {name!r}" + (f"; near ones are {', '.join(near)}" if near else ""))


class AmbiguousPattern(DslError):
    def __init__(self, name: str, found: list[str]):
        super().__init__(f"pattern {name!r} could be {', '.join(found)}")


class MalformedPattern(DslError):
    def __init__(self, name: str):
        super().__init__(f"{name!r} is not a pattern id: up to 12 hexadecimal digits")


@dataclass
class Plan:
    """One filter, resolved against one table."""

    text: str
    query: Query
    where: Column
    window: tuple[int | None, int | None] = (None, None)
    notes: list[str] = field(default_factory=list)

    @property
    def stats(self) -> Stats | None:
        return self.query.stats


@dataclass
class Logs:
    """A logs table (or any with its base columns) and what queries need to know of it."""

    table: DataFrame
    promotions: tuple[Promotion, ...] = ()
    zone: str = "UTC"
    now: int | None = None  # anchors last: in place of the newest record

    @cached_property
    def schema(self) -> Schema:
        return read_schema(self.table, self.promotions)

    @cached_property
    def span(self) -> tuple[int | None, int | None, int]:
        """First and last time in microseconds, and how many records have none: one pass, kept."""
        ts = F.col("ts")
        row = self.table.agg(F.min(micros_of(ts)).alias("first"), F.max(micros_of(ts)).alias("last"), F.count_if(ts.isNull()).alias("undated")).first()
        return row["first"], row["last"], row["undated"]

    def context(self) -> TimeContext:
        first, last, _ = self.span
        return TimeContext(first, last, self.zone, self.now)

    def plan(self, text: str | Query, aggregate: bool = False, operator: str = "this command") -> Plan:
        query = parse(text) if isinstance(text, str) else text
        if query.stats and not aggregate:
            raise StatsUnsupported(operator)
        context = self.context() if any(isinstance(t, TimeTerm) for t in query.terms) else TimeContext(zone=self.zone)
        resolved = self._with_patterns(resolve(query, context))
        window = next(((t.start, t.end) for t in resolved.terms if isinstance(t, WindowTerm)), (None, None))
        return Plan(text if isinstance(text, str) else render(query), resolved, predicate(resolved, self.schema), window, context.notes)

    def matching(self, plan: Plan) -> DataFrame:
        return self.table.where(plan.where)

    def _with_patterns(self, query: Query) -> Query:
        """Pattern ids written short are completed."""
        terms = []
        for term in query.terms:
            if isinstance(term, FieldTerm) and term.op == "=" and term.key.lower() in ("pattern", "pattern_id") and "pattern_id" in self.schema.columns:
                values = tuple(v if not v.quoted and v.text.lower() in ("none", "*") else Value(self.pattern(v.text), v.quoted) for v in term.values)
                term = FieldTerm(term.key, term.op, values, term.negated, term.quoted_key)
            terms.append(term)
        return Query(tuple(terms), query.stats)

    def pattern(self, text: str) -> str:
        """The id that begins with ``text``."""
        low = text.lower()
        if not 0 < len(low) <= 12 or any(c not in "0123456789abcdef" for c in low):
            raise MalformedPattern(text)
        ids = self.table.select("pattern_id").where(F.col("pattern_id").startswith(low)).distinct().orderBy("pattern_id")
        found = [r.pattern_id for r in ids.limit(MOST_CANDIDATES + 1).collect()]
        if low in found or len(found) == 1:
            return low if low in found else found[0]
        if found:
            raise AmbiguousPattern(text, found[:MOST_CANDIDATES])
        near = self.table.select("pattern_id").where(F.col("pattern_id").startswith(low[:2])).distinct().orderBy("pattern_id").limit(4)
        raise UnknownPattern(text, [r.pattern_id for r in near.collect()])

    def time_range(self) -> DataFrame:
        """(first, last, undated)"""
        return self.table.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("ts").isNull()).alias("undated"))


__all__ = ["AmbiguousPattern", "Logs", "MalformedPattern", "Plan", "StatsUnsupported", "UnknownPattern", "micros"]
