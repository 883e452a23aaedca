"""Filter terms to one Column."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.dsl.syntax import DslError, FieldTerm, Query, TextTerm, TimeTerm, Value, WindowTerm
from tributary.functions import scalar
from tributary.model import LEVELS, normal_level
from tributary.plans.schema import Schema


class UnknownLevel(DslError):
    def __init__(self, name: str):
        super().__init__(f"level {name!r} has no rank; ranked are {' < '.join(LEVELS)}")


class UnresolvedTime(DslError):
    def __init__(self):
        super().__init__("the query's time terms have not been resolved")


def number(text: str) -> float | None:
    """A literal that is a number (hexadecimal floats, inf and nan included)."""
    bare = text.strip()
    try:
        return float(bare) if bare == text and not bare.replace("_", "").lower() != bare.lower() else None
    except ValueError:
        try:
            return float.fromhex(bare) if bare.lower().lstrip("+-").startswith("0x") else None
        except ValueError:
            return None


def holds(c: Column) -> Column:
    """Unknown counts as no."""
    return F.coalesce(c, F.lit(False))


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts)


def _level(term: FieldTerm) -> Column:
    level = F.col("level")
    if term.op == "~":
        return any_of([_text(level, v) for v in term.values])
    wanted: list[str] = []
    for v in term.values:
        name = normal_level(v.text) or ""
        if term.op == "=":
            wanted.append(name)
            continue
        if name not in LEVELS:
            raise UnknownLevel(v.text)
        at = LEVELS.index(name)
        wanted += {">": LEVELS[at + 1 :], ">=": LEVELS[at:], "<": LEVELS[:at], "<=": LEVELS[: at + 1]}[term.op]
    return level.isin(list(dict.fromkeys(wanted)))


def _file(v: Value) -> Column:
    name = F.col("file")
    if any(c in v.text for c in "*?["):
        return F.rlike(name, F.lit(scalar.glob_pattern(v.text))) | F.rlike(name, F.lit(scalar.glob_pattern("*/" + v.text)))
    return (name == v.text) | name.endswith("/" + v.text)


def _text(c: Column, v: Value) -> Column:
    return scalar.matches(c, v.text) if v.regex else scalar.contains(c, v.text)


def _equal(c: Column, kind: str, v: Value) -> Column:
    """Text is compared as text; a typed column with the literal read as its type (a misfit matches nothing)."""
    return c == F.lit(v.text) if kind == "string" else c == F.lit(v.text).try_cast(kind)


def _ordered(c: Column, kind: str, op: str, v: Value) -> Column:
    value = number(v.text)
    if kind in ("timestamp_ntz", "timestamp"):
        left, right = c, F.lit(v.text).try_cast(kind)
    elif value is not None:
        left, right = scalar.try_double(c) if kind in ("string", "boolean") else c.cast("double"), F.lit(value)
    else:
        left, right = c.cast("string"), F.lit(v.text)
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def field_predicate(term: FieldTerm, schema: Schema) -> Column:
    """Value lists are alternatives; ``none`` and ``*`` (unquoted, alone) ask for absence and presence."""
    where, name = schema.locate(term.key)
    c, kind = schema.column(term.key), schema.kind(term.key)
    only = term.values[0]
    if term.op == "=" and len(term.values) == 1 and not only.quoted and not only.regex:
        if only.text.lower() == "none":
            return c.isNull()
        if only.text == "*":
            return c.isNotNull()
    if where == "column" and name == "level":
        return _level(term)
    if where == "column" and name == "source" and term.op == "=":
        return c.isin([schema.source(v.text) for v in term.values])
    if where == "column" and name == "file" and term.op == "=":
        return any_of([_file(v) for v in term.values])
    if term.op == "=":
        if kind == "string":
            return c.isin([v.text for v in term.values]) if len(term.values) > 1 else c == F.lit(only.text)
        return any_of([_equal(c, kind, v) for v in term.values])
    if term.op == "~":
        return any_of([_text(c.cast("string"), v) for v in term.values])
    return any_of([_ordered(c, kind, term.op, v) for v in term.values])


def text_predicate(term: TextTerm) -> Column:
    """Anywhere in message, fields or the raw text."""
    places = [F.col("message"), F.coalesce("fields", F.lit("")), F.col("raw")]
    return any_of([holds(scalar.contains(p, term.text)) for p in places])


def within(start: int | None, end: int | None) -> Column:
    ts = F.col("ts")
    parts = ([ts >= scalar.instant(start)] if start is not None else []) + ([ts < scalar.instant(end)] if end is not None else [])
    return reduce(and_, parts) if parts else F.lit(True)


def term_predicate(term, schema: Schema) -> Column | None:
    if isinstance(term, TimeTerm):
        raise UnresolvedTime()
    if isinstance(term, WindowTerm):
        parts = [within(term.start, term.end)] if (term.start, term.end) != (None, None) else []
        parts += [~holds(within(a, b)) for a, b in term.excluded]
        return reduce(and_, parts) if parts else None
    if isinstance(term, TextTerm):
        if not term.text:
            return None
        found = text_predicate(term)
    else:
        found = field_predicate(term, schema)
    return ~holds(found) if term.negated else found


def predicate(query: Query, schema: Schema) -> Column:
    """The whole filter; an empty one is true."""
    parts = [p for p in (term_predicate(t, schema) for t in query.terms) if p is not None]
    return reduce(and_, parts) if parts else F.lit(True)
