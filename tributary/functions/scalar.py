"""Columns that stand for the engine's scalar semantics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.model import LEVEL_ALIASES

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def from_micros(us: Column) -> Column:
    """Zoneless timestamp of microseconds since the epoch."""
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def instant(us: int) -> Column:
    """Literal zoneless timestamp; plain enough to be pushed to the scan."""
    from tributary.dsl.timeexpr import moment

    return F.lit(moment(us).isoformat(sep=" ")).cast("timestamp_ntz")


def try_double(c: Column) -> Column:
    """A text as a number: blanks around and digit-separating underscores are fine, a type suffix is not."""
    text = F.trim(c.cast("string"))
    odd = F.rlike(text, F.lit(r"[dDfF]$")) & ~F.rlike(text, F.lit(r"(?i)^[+-]?inf$"))
    bare = F.when(F.rlike(text, F.lit(r"[0-9]_[0-9]")), F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(text)
    return F.when(~odd, bare.try_cast("double"))


def quote(text: str) -> str:
    """A regular expression for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def has_upper(text: str) -> bool:
    return bool(re.search("[A-Z]", text))


def contains(c: Column, text: str) -> Column:
    """Smart case: an upper-case letter in the text makes it exact."""
    return F.contains(c, F.lit(text)) if has_upper(text) else F.rlike(c, F.lit("(?iu)" + quote(text)))


def matches(c: Column, pattern: str) -> Column:
    """Unanchored regular expression, smart case."""
    return F.rlike(c, F.lit(pattern if has_upper(pattern) else "(?iu)" + pattern))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a shell pattern whose * crosses slashes."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", at + 2)) > 0:
            inner = glob[at + 1 : end]
            negated = inner.startswith("!")
            out += "[" + "^" * negated + re.sub(r"([\\\[&^])", r"\\\1", inner[negated:]) + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return f"(?s)^{out}$"


def normal_level(c: Column) -> Column:
    """The level column of a text: known names to their level, others trimmed and in lower case, empty to null."""
    bare = F.lower(F.trim(F.btrim(F.trim(c), F.lit("[]()<>:.-"))))
    known = F.create_map(*[F.lit(x) for level, names in LEVEL_ALIASES.items() for name in names.split() for x in (name, level)])
    return F.nullif(F.coalesce(F.element_at(known, bare), bare), F.lit(""))


def bins(ts: Column, seconds: int, origin: int) -> Column:
    """Start of the bucket of ``seconds`` that holds ``ts``; buckets start at ``origin`` (microseconds)."""
    width = seconds * 1_000_000
    since = micros(ts) - F.lit(origin)
    return from_micros(F.lit(origin) + (since - F.pmod(since, F.lit(width))))
