"""Bytes to logical records: lines, continuations, zones, and what could not be read."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO
from zoneinfo import ZoneInfo

from tributary.functions.template import template_id, template_of
from tributary.sources.formats import Format, Record, Unread, choose
from tributary.sources.times import shift_zone

MOST_LINE = 8 << 20
SAMPLE_LINES = 200
#: Reserved key that holds the original bytes, in hexadecimal, of a line that is not UTF-8.
RAW_BYTES_KEY = "_raw_hex"


@dataclass
class ReadStats:
    lines: int = 0
    records: int = 0
    unparsed: int = 0
    no_timestamp: int = 0
    continuation: int = 0
    truncated: int = 0
    blank: int = 0
    zone_assumed: int = 0
    invalid_utf8: int = 0
    zone_abbrevs: Counter = field(default_factory=Counter)


@dataclass
class Entry:
    line_no: int
    record: Record
    raw: str
    parsed: bool
    raw_hex: str | None = None
    offset: int = 0  # of its first byte


def valid_text(data: bytes) -> tuple[str, bool]:
    """Text of a line; each run of bytes that are no UTF-8 becomes one replacement character."""
    try:
        return data.decode("utf-8"), True
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as bad:
            out.append(data[at : at + bad.start].decode("utf-8"))
            if bad.start or not out[:-1] or not out[-2].endswith("�"):
                out.append("�")
            elif out[-1] == "":
                out.pop()
            at += bad.end
    return "".join(out), False


def split_lines(stream: BinaryIO, most: int = MOST_LINE, offset: int = 0) -> Iterator[tuple[bytes, bool, int]]:
    """(line, cut, offset): without line end; what exceeds ``most`` bytes is dropped up to the line end."""
    while True:
        line = stream.readline(most + 1)
        if not line:
            return
        start, size = offset, len(line)
        cut = size > most and not line.endswith(b"\n")
        if cut:
            line = line[:most]
            while rest := stream.readline(1 << 20):
                size += len(rest)
                if rest.endswith(b"\n"):
                    break
        offset += size
        if line.endswith(b"\n"):
            line = line[:-1]
        yield line.removesuffix(b"\r"), cut, start


def read(stream: BinaryIO, fmt: Format | None = None, zone: str = "UTC", stats: ReadStats | None = None, first_line: int = 1, start: int = 0, stop: int | None = None) -> Iterator[Entry]:
    """Logical records of a stream. A line that no format understands is kept raw; none is lost.

    With ``start`` and ``stop`` (offsets of line starts) only the records that begin
    between them: continuation lines at the start belong to the part
    before, and those after the stop to the last record.
    """
    stats = stats if stats is not None else ReadStats()
    tz = ZoneInfo(zone)
    lines = split_lines(stream, offset=start)
    if fmt is None:
        held = []
        for item in lines:
            held.append(item)
            if len(held) >= SAMPLE_LINES:
                break
        fmt = choose([valid_text(x)[0] for x, _, _ in held])
        rest = lines
        lines = (x for part in (held, rest) for x in part)
    open_: Entry | None = None
    for number, (data, cut, offset) in enumerate(lines, first_line):
        beyond = stop is not None and offset >= stop
        if not beyond:
            stats.lines += 1
        if not data.strip():
            stats.blank += not beyond
            continue
        text, valid = valid_text(data)
        if beyond and not (open_ is not None and fmt.continues(text)):
            break
        if start and open_ is None and not stats.records and fmt.continues(text):
            continue
        stats.truncated += cut
        if open_ is not None and fmt.continues(text):
            stats.continuation += 1
            open_.raw += "\n" + text
            open_.record.message += "\n" + text
            if not valid:
                stats.invalid_utf8 += 1
            continue
        if open_ is not None:
            yield _closed(open_, stats, tz)
        try:
            record, parsed = fmt.parse(text), True
            parsed = not record.partial
        except Unread:
            record, parsed = Record(message=text, format=fmt.name), False
        stats.invalid_utf8 += not valid
        open_ = Entry(number, record, text, parsed, None if valid else data.hex(), offset)
    if open_ is not None:
        yield _closed(open_, stats, tz)


def _closed(entry: Entry, stats: ReadStats, tz: ZoneInfo) -> Entry:
    stats.records += 1
    stats.unparsed += not entry.parsed
    stamp = entry.record.stamp
    if stamp is None:
        stats.no_timestamp += 1
    elif not stamp.zoned:
        stats.zone_assumed += 1
        if stamp.abbrev:
            stats.zone_abbrevs[stamp.abbrev] += 1
        entry.record.stamp = type(stamp)(shift_zone(stamp.us, tz), False, stamp.abbrev)
    return entry


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "integer" if value.is_integer() and abs(value) < 2**63 else "float"
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string"


def canonical(value: Any) -> Any:
    """Numbers in one spelling: 1.0 and 1e0 are 1."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        return int(value)
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in value.items()}
    return [canonical(v) for v in value] if isinstance(value, list) else value


def value_text(value: Any) -> str | None:
    value = canonical(value)
    if value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def row(entry: Entry, source: str, path: str) -> dict:
    """A row of the logs table but for its seq."""
    record, fields = entry.record, dict(entry.record.fields)
    if entry.raw_hex:
        fields[RAW_BYTES_KEY] = entry.raw_hex
    pattern = template_of(record.message, entry.raw)
    bag = {k: t for k, v in fields.items() if (t := value_text(v)) is not None}
    return {
        "ts": record.stamp.us if record.stamp else None,
        "ts_zoned": bool(record.stamp and record.stamp.zoned),
        "level": record.level,
        "message": record.message,
        "source": source,
        "file": path,
        "format": record.format,
        "line_no": entry.line_no,
        "parsed": entry.parsed,
        "raw": entry.raw,
        "fields": json.dumps(canonical(fields), ensure_ascii=False, separators=(",", ":"), sort_keys=True) if fields else None,
        "bag": bag,
        "kinds": {k: kind_of(v) for k, v in fields.items()},
        "pattern": pattern,
        "pattern_id": template_id(pattern),
    }
