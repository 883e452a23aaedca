"""The logs table: one row per logical record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Base columns; promoted columns follow them.
LOGS_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType()),  # UTC
        T.StructField("ts_zoned", T.BooleanType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("parsed", T.BooleanType()),
        T.StructField("raw", T.StringType(), False),
        T.StructField("fields", T.StringType()),  # canonical JSON, null when empty
        T.StructField("bag", T.MapType(T.StringType(), T.StringType())),  # the same by key
        T.StructField("kinds", T.MapType(T.StringType(), T.StringType())),  # JSON type of each value
        T.StructField("pattern", T.StringType()),
        T.StructField("pattern_id", T.StringType()),
    ]
)
BUILTINS = tuple(f.name for f in LOGS_SCHEMA.fields if f.name not in ("bag", "kinds"))

#: Level names that are understood, by what they mean.
LEVEL_ALIASES = {
    "trace": "t trc trace finest verbose v",
    "debug": "d dbg debug fine debug1 debug2 debug3 debug4 debug5",
    "info": "i inf info information informational notice note log statement detail hint context query location",
    "warn": "w wrn warn warning",
    "error": "e err error severe eror exception",
    "fatal": "f ftl fatal crit critical alert emerg emergency panic",
}
LEVELS = tuple(LEVEL_ALIASES)
_LEVEL_OF = {alias: level for level, names in LEVEL_ALIASES.items() for alias in names.split()}


def normal_level(text: str | None) -> str | None:
    """Known names become one of LEVELS; others stay as they are, trimmed and in lower case; empty is None."""
    if text is None:
        return None
    bare = text.strip().strip("[]()<>:.-").strip()
    return _LEVEL_OF.get(bare.lower(), bare.lower()) or None


@dataclass(frozen=True)
class Promotion:
    """A frequent field that has a typed column of its own."""

    field: str
    column: str
    kind: str  # string integer float boolean timestamp
    coverage: float

    @property
    def sql_type(self) -> str:
        return {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "timestamp": "timestamp_ntz"}[self.kind]
