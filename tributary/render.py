"""Collected rows as tables, JSON, lines of JSON, CSV or raw text."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any
from zoneinfo import ZoneInfo

FORMATS = ("table", "json", "ndjson", "csv", "raw")


def localised(value: Any, zone: str) -> Any:
    """Times are kept in UTC and shown in a zone."""
    if isinstance(value, datetime):
        shown = value.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone))
        return shown.isoformat(timespec="microseconds" if shown.microsecond else "seconds").replace("+00:00", "Z")
    return value


def cell(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list)) else str(value)


def rendered(columns: list[str], rows: Iterable, how: str = "table", zone: str = "UTC", width: int = 120) -> str:
    values = [[localised(v, zone) for v in r] for r in rows]
    if how == "json":
        return json.dumps([dict(zip(columns, r)) for r in values], ensure_ascii=False, default=str)
    if how == "ndjson":
        return "\n".join(json.dumps(dict(zip(columns, r)), ensure_ascii=False, default=str) for r in values)
    if how == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        writer.writerows([[cell(v) for v in r] for r in values])
        return out.getvalue().removesuffix("\n")
    if how == "raw":
        at = columns.index("raw") if "raw" in columns else len(columns) - 1
        return "\n".join(cell(r[at]) for r in values)
    if how != "table":
        raise ValueError(f"unknown format {how!r}; one of {', '.join(FORMATS)}")
    text = [[cell(v).replace("\n", "⏎") for v in r] for r in values]
    sizes = [max([len(c), *(len(r[n]) for r in text)]) for n, c in enumerate(columns)]
    line = lambda r: "  ".join(v.ljust(s) for v, s in zip(r, sizes)).rstrip()[:width] if width else "  ".join(v.ljust(s) for v, s in zip(r, sizes)).rstrip()
    return "\n".join(line(r) for r in [columns, *text])
