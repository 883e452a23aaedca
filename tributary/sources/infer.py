"""Promotion: frequent fields of the bag become typed columns."""

from __future__ import annotations

import re
from collections import defaultdict
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.scalar import try_double
from tributary.model import BUILTINS, LOGS_SCHEMA, Promotion

SAMPLE, LEAST_COVERAGE, MOST_COLUMNS = 10_000, 0.6, 32
_RESERVED = frozenset(BUILTINS) | {"bag", "kinds", "msg", "line"}
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?")


def column_name(field: str) -> str:
    """A name that is plain to write: lower case, separators as one underscore each, a leading digit after ``f_``."""
    kept = "".join(c if c.isalnum() else "_" if c in "_.- /" else "" for c in field.lower()).strip("_")
    return f"f_{kept}" if kept[:1].isdigit() else kept


def looks_like_time(text: Any) -> bool:
    if not isinstance(text, str) or not 10 <= len(text) <= 40 or not _TIME.fullmatch(text):
        return False
    try:
        datetime.fromisoformat(text.replace("Z", "+00:00"))
        return True
    except ValueError:
        return False


def column_kind(kinds: dict[str, int], times: int) -> str | None:
    """Type of a field from how often each JSON type occurs; None for nested values."""
    if kinds.get("object") or kinds.get("array"):
        return None
    seen = {k for k, n in kinds.items() if n and k != "null"}
    if "string" in seen:
        return "timestamp" if seen == {"string"} and times == kinds["string"] else "string"
    if "boolean" in seen:
        return "boolean" if seen == {"boolean"} else "string"
    return "float" if "float" in seen else "integer" if "integer" in seen else "string"


def infer(rows: list[tuple[str, dict[str, str], dict[str, str]]], least: float = LEAST_COVERAGE, most: int = MOST_COLUMNS) -> list[Promotion]:
    """Promotions from (group, bag, kinds) samples: fields that cover enough of at least one group."""
    size: dict[str, int] = defaultdict(int)
    present: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    kinds: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    times: dict[str, int] = defaultdict(int)
    for group, bag, types in rows:
        size[group] += 1
        for key, kind in types.items():
            if kind != "null":
                present[key][group] += 1
            kinds[key][kind] += 1
            times[key] += kind == "string" and looks_like_time(bag.get(key))
    out: list[Promotion] = []
    taken: set[str] = set()
    for key in sorted(present, key=lambda k: (-sum(present[k].values()), k)):
        cover = max(n / size[g] for g, n in present[key].items())
        kind, name = column_kind(kinds[key], times[key]), column_name(key)
        if cover < least or kind is None or not name or name in _RESERVED or name in taken:
            continue
        if len(out) == most:
            break
        taken.add(name)
        out.append(Promotion(key, name, kind, cover))
    return out


def sample(logs: DataFrame, size: int = SAMPLE) -> list[tuple[str, dict, dict]]:
    """The first records with fields of each source and format, ``size`` altogether."""
    with_bag = logs.where("fields IS NOT NULL")
    formats = {r.source: r.n for r in with_bag.groupBy("source").agg(F.count_distinct("format").alias("n")).collect()}
    groups = sum(formats.values())
    if not groups:
        return []
    each = max(1, size // groups)
    head = Window.partitionBy("source", "format").orderBy("seq")
    rows = with_bag.select("source", "format", "seq", "bag", "kinds").withColumn("rn", F.row_number().over(head)).where(F.col("rn") <= each)
    return [(f"{r.source}/{r.format}" if formats[r.source] > 1 else r.source, r.bag or {}, r.kinds or {}) for r in rows.collect()]  # ``size`` rows at most


def promote(logs: DataFrame, promotions: list[Promotion]) -> DataFrame:
    """``logs`` with a typed column for each promotion; values that do not fit are null."""
    made = {}
    for p in promotions:
        text = F.col("bag")[F.lit(p.field)]
        made[p.column] = try_double(text) if p.kind == "float" else text if p.kind == "string" else text.try_cast(p.sql_type)
    return logs.select("*", *[c.alias(n) for n, c in made.items()])


def demote(logs: DataFrame) -> DataFrame:
    """The base columns alone."""
    return logs.select(*LOGS_SCHEMA.names)


def infer_and_promote(logs: DataFrame) -> tuple[DataFrame, tuple[Promotion, ...]]:
    found = infer(sample(logs))
    return promote(logs, found), tuple(found)
