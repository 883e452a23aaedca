"""Lines that are already a column: the same formats, without files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.template import template_id, template_of
from tributary.sources.formats import FORMATS, MIXED, Record, Unread
from tributary.sources.reader import value_text

PARSED = "ts timestamp_ntz, ts_zoned boolean, level string, message string, format string, parsed boolean, bag map<string,string>, pattern string, pattern_id string"
_KINDS = [pa.timestamp("us"), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def parse_line(text: str, parser: str | None = None) -> tuple[Record, bool]:
    """Record of one line, by a format or by whichever claims it; a line of no format is its own message."""
    fmt = FORMATS[parser] if parser and parser != "mixed" else MIXED
    try:
        record = fmt.parse(text)
        return record, not record.partial
    except Unread:
        return Record(message=text, format=fmt.name), False


def _row(text: str | None, parser: str | None) -> tuple:
    if text is None:
        return (None,) * len(_NAMES)
    record, parsed = parse_line(text, parser)
    pattern = template_of(record.message, text)
    bag = [(k, t) for k, v in record.fields.items() if (t := value_text(v)) is not None]
    stamp = record.stamp
    return stamp.us if stamp else None, bool(stamp and stamp.zoned), record.level, record.message, record.format, parsed, bag, pattern, template_id(pattern)


def parse_column(df: DataFrame, column: str, parser: str | None = None) -> DataFrame:
    """``df`` with the parsed columns in place of a column of single lines; null lines give nulls."""
    keep = [c for c in df.columns if c != column]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes] + [PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(x, parser) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *_NAMES])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`")).mapInArrow(run, schema)
