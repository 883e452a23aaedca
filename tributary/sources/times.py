"""Timestamps of log lines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

EPOCH = datetime(1970, 1, 1)
_MONTHS = {m: n for n, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_SECOND = 10**6
#: Epoch numbers are believed between these seconds.
_EPOCH_RANGE = (10**9, 2 * 10**9)

_CLOCK = r"(?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?"
_ZONE = r"(?P<z>[Zz]|[+-]\d{2}(?::?\d{2})?)"
_SHAPES = tuple(
    re.compile(p, re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}})[Tt]{_CLOCK}{_ZONE}?",
        rf"(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}}) {_CLOCK}(?: ?{_ZONE}| (?P<abbrev>[A-Z]{{2,5}}))?",
        rf"(?P<d>\d{{2}})/(?P<mon>[A-Za-z]{{3}})/(?P<y>\d{{4}}):{_CLOCK}(?: {_ZONE})?",
        rf"(?P<mon>[A-Za-z]{{3}}) (?P<d>[ 0-9]\d) {_CLOCK}",
        rf"(?P<y>\d{{4}})/(?P<mo>\d{{2}})/(?P<d>\d{{2}}) {_CLOCK}",
        rf"[A-Za-z]{{3}}, (?P<d>\d{{2}}) (?P<mon>[A-Za-z]{{3}}) (?P<y>\d{{4}}) {_CLOCK} (?:{_ZONE}|(?P<abbrev>[A-Z]{{2,5}}))",
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?P<z>Z)",
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2}) (?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})",
        rf"(?P<d>\d{{1,2}}) (?P<mon>[A-Za-z]{{3}}) (?P<y>\d{{4}}) {_CLOCK}",
    )
)
#: Abbreviations that are a zone; any other is a name that several zones share.
_UTC_NAMES = ("UTC", "GMT", "Z")


@dataclass(frozen=True)
class Stamp:
    us: int
    zoned: bool
    abbrev: str | None = None


def _offset(text: str) -> int:
    if text in "Zz":
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    minutes = int(digits[:2]) * 60 + int(digits[2:4])
    return (-minutes if text[0] == "-" else minutes) * 60 * _SECOND


def epoch_number(value: float | int) -> Stamp | None:
    """Seconds, milliseconds, microseconds or nanoseconds, by size."""
    for scale in (1, 10**3, 10**6, 10**9):
        if _EPOCH_RANGE[0] <= abs(value) / scale < _EPOCH_RANGE[1]:
            return Stamp(int(value * _SECOND // scale) if isinstance(value, int) else round(value * _SECOND / scale), True)
    return None


def parse_time(text: str, year: int | None = None) -> Stamp | None:
    """Every known shape, then epoch numbers; a date without year gets ``year`` (now's by default)."""
    text = text.strip()
    for shape in _SHAPES:
        if m := shape.fullmatch(text):
            g = m.groupdict()
            month = _MONTHS.get((g.get("mon") or "").lower()) if g.get("mon") else int(g["mo"])
            if month is None:
                return None
            try:
                base = datetime(int(g.get("y") or year or datetime.now().year), month, int(g["d"]), int(g["h"]), int(g["mi"]), int(g["s"]))
            except ValueError:
                return None
            us = (base - EPOCH) // timedelta(microseconds=1) + int(((g.get("f") or "") + "000000")[:6])
            abbrev = g.get("abbrev")
            if g.get("z"):
                return Stamp(us - _offset(g["z"]), True)
            return Stamp(us, abbrev in _UTC_NAMES, None if abbrev in _UTC_NAMES else abbrev)
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return epoch_number(float(text) if "." in text else int(text))
    return None


def leading_time(line: str) -> tuple[Stamp, int] | None:
    """A timestamp that the line begins with, bracketed or not, and where the rest starts."""
    m = re.match(r"\[?(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?: ?(?:Z|[+-]\d{2}:?\d{2})(?![\d:]))?|[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2})\]?(?=\s|$|:)", line)
    if not m or not (stamp := parse_time(m[1])):
        return None
    return stamp, m.end()


def shift_zone(us: int, zone) -> int:
    """A wall-clock time read in ``zone``: its UTC; the earlier of two."""
    naive = EPOCH + timedelta(microseconds=us)
    offset = naive.replace(tzinfo=zone, fold=0).utcoffset()
    return us - (offset // timedelta(microseconds=1) if offset else 0)
