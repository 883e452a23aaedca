"""Names that a query may use, and the columns they stand for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.dsl.syntax import DslError
from tributary.model import BUILTINS, Promotion

ALIASES = {"msg": "message", "line": "line_no", "pattern": "pattern_id"}
MOST_SUGGESTIONS = 4


class UnknownField(DslError):
    def __init__(self, name: str, known: list[str]):
        self.suggestions = suggest(name, known)
        hint = f"; did you mean {', '.join(self.suggestions)}?" if self.suggestions else ""
        super().__init__(f"unknown field {name!r}{hint}")


class AmbiguousSource(DslError):
    def __init__(self, name: str, found: list[str]):
        super().__init__(f"source {name!r} could be {', '.join(found)}")


def distance(a: str, b: str) -> int:
    """Edits between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggest(name: str, known: list[str]) -> list[str]:
    """Up to four names that begin with, contain or nearly are the given one."""
    low = name.lower()
    most = 1 if len(low) <= 4 else 2 if len(low) <= 8 else 3

    def rank(other: str) -> tuple | None:
        o = other.lower()
        if o.startswith(low) or low.startswith(o):
            return (0, abs(len(o) - len(low)), other)
        if low in o or o in low:
            return (1, abs(len(o) - len(low)), other)
        return (2, d, other) if (d := distance(low, o)) <= most else None

    ranked = sorted(r for x in dict.fromkeys(known) if (r := rank(x)))
    return [r[2] for r in ranked[:MOST_SUGGESTIONS]]


@dataclass
class Schema:
    """Builtin columns, promoted columns, and the keys of the bag.

    Keys and sources may be functions: they cost a pass over the table and are
    only asked for when a query names a field of the bag, or a source.
    """

    columns: tuple[str, ...]
    promotions: tuple[Promotion, ...] = ()
    own_keys: tuple[str, ...] | Callable[[], tuple[str, ...]] = ()
    own_sources: tuple[str, ...] | Callable[[], tuple[str, ...]] = ()
    types: dict[str, str] = field(default_factory=dict)
    #: Whether the bag has a key just so: ends at the first record that has it.
    has_key: Callable[[str], bool] | None = None

    @cached_property
    def keys(self) -> tuple[str, ...]:
        return self.own_keys() if callable(self.own_keys) else self.own_keys

    @cached_property
    def sources(self) -> tuple[str, ...]:
        return self.own_sources() if callable(self.own_sources) else self.own_sources

    @cached_property
    def asked(self) -> dict[str, bool]:
        return {}

    @property
    def names(self) -> list[str]:
        own = [c for c in BUILTINS if c in self.columns]
        return list(dict.fromkeys([*own, *(p.field for p in self.promotions), *self.keys]))

    def kind(self, name: str) -> str:
        """Spark type of what a name stands for; bag values are text."""
        where, what = self.locate(name)
        return "string" if where == "bag" else self.types.get(what, "string")

    def locate(self, name: str) -> tuple[str, str]:
        """('column' or 'bag', which): builtin, promoted (exact, then any case), bag (exact, then any case)."""
        low = name.lower()
        builtin = ALIASES.get(low, low)
        if builtin in BUILTINS and builtin in self.columns:
            return "column", builtin
        for same in (lambda x: x == name, lambda x: x.lower() == low):
            for p in sorted(self.promotions, key=lambda p: p.field):
                if same(p.field) or same(p.column):
                    return "column", p.column
        if "keys" not in self.__dict__ and self.has_key is not None:
            if name not in self.asked:
                self.asked[name] = self.has_key(name)
            if self.asked[name]:
                return "bag", name
        for same in (lambda x: x == name, lambda x: x.lower() == low):
            for key in sorted(self.keys):
                if same(key):
                    return "bag", key
        raise UnknownField(name, self.names)

    def column(self, name: str) -> Column:
        where, what = self.locate(name)
        return F.col("bag")[F.lit(what)] if where == "bag" else F.col(f"`{what}`")

    def source(self, name: str) -> str:
        """The source meant: exact, else the one that begins so in any case; unknown names stay."""
        if name in self.sources:
            return name
        found = sorted(s for s in self.sources if s.lower().startswith(name.lower()))
        if len(found) > 1 and name.lower() not in {s.lower() for s in found}:
            raise AmbiguousSource(name, found)
        return next((s for s in found if s.lower() == name.lower()), found[0] if found else name)


def bag_keys(logs: DataFrame) -> DataFrame:
    """(key): the keys that occur in the bag."""
    return logs.select(F.explode(F.map_keys("bag")).alias("key")).distinct().orderBy("key")


def read_schema(logs: DataFrame, promotions: tuple[Promotion, ...] = ()) -> Schema:
    """Schema of a logs table; the catalogues of keys and sources are small, and read once if at all."""

    def keys() -> tuple[str, ...]:
        return tuple(r.key for r in bag_keys(logs).collect()) if "bag" in logs.columns else ()

    def sources() -> tuple[str, ...]:
        return tuple(sorted(r.source for r in logs.select("source").distinct().collect() if r.source is not None)) if "source" in logs.columns else ()

    def has_key(name: str) -> bool:
        return "bag" in logs.columns and not logs.where(F.map_contains_key("bag", name)).select("bag").isEmpty()

    types = {f.name: f.dataType.simpleString() for f in logs.schema.fields}
    return Schema(tuple(logs.columns), tuple(promotions), keys, sources, types, has_key)
