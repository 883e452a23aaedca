"""Traces across sources, comparison of two windows, empty results explained, handoff."""

from __future__ import annotations

import hashlib
import json
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.dsl.syntax import DslError, TextTerm, WindowTerm, instant_text, render_term
from tributary.functions import scalar
from tributary.functions.predicates import holds, term_predicate, text_predicate, within
from tributary.functions.scratch import stored
from tributary.operators.breakdown import limited, sources
from tributary.operators.records import ordered
from tributary.plans.schema import UnknownField
from tributary.plans.session import Logs, Plan

#: Names that a trace id goes by.
TRACE_FIELDS = ("trace_id", "traceId", "trace-id", "traceid", "request_id", "requestId", "req_id", "x-request-id", "correlation_id", "correlationId")
DIFF_LIMIT, MOST_VALUES, HANDOFF_LIMIT = 20, 500, 200
HOUR = 3_600_000_000


class NoTraceField(DslError):
    def __init__(self):
        super().__init__("no field looks like a trace id; name one with --field")


# --- trace ----------------------------------------------------------------------


def detect_trace_field(logs: Logs, value: str) -> str:
    """Of the usual names the one that holds the id most often, then the one that most records have. One pass."""
    there = []
    for name in TRACE_FIELDS:
        try:
            logs.schema.locate(name)
            there.append(name)
        except UnknownField:
            continue
    if not there:
        raise NoTraceField()
    parts = [x for n, name in enumerate(there) for x in (F.count_if(logs.schema.column(name).cast("string") == value).alias(f"h{n}"), F.count(logs.schema.column(name)).alias(f"n{n}"))]
    row = logs.table.agg(*parts).first()
    return max(enumerate(there), key=lambda x: (row[f"h{x[0]}"], row[f"n{x[0]}"], -x[0]))[1]


def trace(logs: Logs, plan: Plan, value: str, by: str | None = None) -> DataFrame:
    """Hops of one id in time order (undated ones last): seq, ts, source, level, message, gap_us, text_only.

    A record is a hop if its field is the id, or if only its text holds it
    (``text_only``). The gap is to the hop before, among dated ones.
    """
    column = logs.schema.column(by or detect_trace_field(logs, value)).cast("string")
    fielded = holds(column == value)
    hops = logs.matching(plan).where(fielded | text_predicate(TextTerm(value))).select("seq", "ts", "source", "level", "message", (~fielded).alias("text_only"))
    return ordered(with_gaps(stored(hops, "hops")))


def with_gaps(hops: DataFrame) -> DataFrame:
    """Add gap_us: within an hour by a window, and from the last hop of an earlier hour by a table of one row an hour."""
    us = scalar.micros(F.col("ts"))
    hops = hops.withColumn("hour_no", F.floor(us / F.lit(HOUR)))
    ends = hops.where("ts IS NOT NULL").groupBy("hour_no").agg(F.max(us).alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.orderBy("hour_no")))
    own = Window.partitionBy("hour_no").orderBy("ts", "seq")
    before = F.coalesce(F.lag(us).over(own), F.col("end"))
    dated = hops.where("ts IS NOT NULL").join(F.broadcast(ends), "hour_no").withColumn("gap_us", us - before)  # a century has 900,000 hours
    undated = hops.where("ts IS NULL").withColumn("gap_us", F.lit(None).cast("long"))
    return dated.select(*undated.columns).unionByName(undated).drop("hour_no")


def trace_summary(hops: DataFrame) -> DataFrame:
    """(hops, span_us, undated, text_only, slowest_seq, slowest_gap_us); the first of equally slow hops."""
    us = scalar.micros(F.col("ts"))
    slow = F.max_by("seq", F.when(F.col("gap_us").isNotNull(), F.struct(F.col("gap_us"), -F.col("seq"))))
    return hops.agg(F.count(F.lit(1)).alias("hops"), (F.max(us) - F.min(us)).alias("span_us"), F.count_if(F.col("ts").isNull()).alias("undated"), F.count_if("text_only").alias("text_only"), slow.alias("slowest_seq"), F.max("gap_us").alias("slowest_gap_us"))


def trace_reach(logs: Logs, plan: Plan, value: str, by: str | None = None) -> DataFrame:
    """(source, records, hits, carriers, reach): present, silent (has the field, not the id) or blind (cannot carry it)."""
    column = logs.schema.column(by or detect_trace_field(logs, value)).cast("string")
    hit = holds(column == value) | text_predicate(TextTerm(value))
    out = logs.matching(plan).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(hit).alias("hits"), F.count(column).alias("carriers"))
    reach = F.when(F.col("hits") > 0, "present").when(F.col("carriers") > 0, "silent").otherwise("blind")
    return out.withColumn("reach", reach).orderBy("source")


# --- diff -----------------------------------------------------------------------


def surprise(before: Column, after: Column, n_before: Column, n_after: Column) -> Column:
    """Likelihood ratio of a count split over two windows against their sizes; 0 if either is empty."""

    def part(seen: Column, size: Column) -> Column:
        expected = (before + after) * size / (n_before + n_after)
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    score = F.when((n_before > 0) & (n_after > 0), 2 * (part(before, n_before) + part(after, n_after))).otherwise(0.0)
    return F.round(score, 9)


def diff_items(logs: Logs, before: Plan, after: Plan, names: list[str] | None = None) -> DataFrame:
    """(kind, name, value, before, after): templates, presence of fields, and values of fields in two windows.

    One pass: each record is tagged with the windows that it is in, and goes
    out in long form with its template, its fields and their values. Fields
    with more than MOST_VALUES values, or with one, are compared by presence only.
    """
    in_before, in_after = holds(before.where), holds(after.where)
    rows = logs.table.select("ts", "pattern_id", "level", "source", "bag", in_before.alias("b"), in_after.alias("a")).where("ts IS NOT NULL AND (b OR a)")
    own = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("level", "source")]
    bag = F.transform(F.map_entries(F.coalesce("bag", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    pairs = F.filter(F.concat(F.array(*own), bag), lambda e: e["value"].isNotNull())
    if names is not None:
        pairs = F.filter(pairs, lambda e: e["name"].isin(names))
    template = F.array(F.struct(F.lit("pattern").alias("kind"), F.lit("pattern_id").alias("name"), F.col("pattern_id").alias("value")))
    valued = F.transform(pairs, lambda e: F.struct(F.lit("value").alias("kind"), e["name"].alias("name"), e["value"].alias("value")))
    items = rows.select("b", "a", F.inline(F.concat(template, valued)))
    counts = stored(items.groupBy("kind", "name", "value").agg(F.count_if("b").alias("before"), F.count_if("a").alias("after")), "items")
    per_name = counts.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("values"), F.sum("before").alias("all_before"), F.sum("after").alias("all_after"))
    kept = counts.join(per_name.where(f"kind = 'pattern' OR values BETWEEN 2 AND {MOST_VALUES}").select("kind", "name"), ["kind", "name"], "left_semi")
    presence = per_name.where("kind = 'value'").select(F.lit("field").alias("kind"), "name", F.lit(None).cast("string").alias("value"), F.col("all_before").alias("before"), F.col("all_after").alias("after"))
    return kept.unionByName(presence)


def window_sizes(logs: Logs, before: Plan, after: Plan) -> DataFrame:
    """(n_before, n_after, overlap, undated)"""
    b, a, dated = holds(before.where), holds(after.where), F.col("ts").isNotNull()
    return logs.table.agg(F.count_if(b & dated).alias("n_before"), F.count_if(a & dated).alias("n_after"), F.count_if(b & a & dated).alias("overlap"), F.count_if(~dated).alias("undated"))


def diff(logs: Logs, before: Plan, after: Plan, limit: int = DIFF_LIMIT, names: list[str] | None = None) -> DataFrame:
    """Items by surprise: kind, name, value, before, after, change (appeared, vanished, shifted), surprise, and rates a second."""
    sizes = F.broadcast(window_sizes(logs, before, after).select("n_before", "n_after"))  # one row
    scored = diff_items(logs, before, after, names).crossJoin(sizes)
    b, a = F.col("before"), F.col("after")
    change = F.when(b == 0, "appeared").when(a == 0, "vanished").otherwise("shifted")
    scored = scored.withColumn("surprise", surprise(b, a, F.col("n_before"), F.col("n_after"))).where("surprise > 0")
    (b0, b1), (a0, a1) = before.window, after.window
    if None not in (b0, b1, a0, a1):
        scored = scored.withColumns({"before_rate": b / ((b1 - b0) / 1e6), "after_rate": a / ((a1 - a0) / 1e6)})
    extra = ["before_rate", "after_rate"] if "before_rate" in scored.columns else []
    out = scored.select("kind", "name", "value", "before", "after", change.alias("change"), "surprise", *extra)
    return limited(out.orderBy(F.desc("surprise"), "kind", "name", "value"), limit, DIFF_LIMIT)


# --- explain --------------------------------------------------------------------


def explain(logs: Logs, plan: Plan) -> DataFrame:
    """(term, n) for each term alone, in one pass; ``*`` is the whole table."""
    parts = []
    for term in plan.query.terms:
        p = term_predicate(term, logs.schema)
        if p is not None:
            parts.append((render_term(term), holds(p)))
    row = logs.table.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(p).alias(f"t{n}") for n, (_, p) in enumerate(parts)])
    entries = [F.struct(F.lit("*").alias("term"), F.col("all").alias("n"))] + [F.struct(F.lit(text).alias("term"), F.col(f"t{n}").alias("n")) for n, (text, _) in enumerate(parts)]
    return row.select(F.inline(F.array(*entries)))


def why_empty(logs: Logs, plan: Plan) -> str:
    """One sentence on a filter that matches nothing."""
    first, last, _ = logs.span
    start, end = plan.window
    if first is not None and (start is not None and start > last or end is not None and end <= first):
        return f"the window is outside the data, which runs from {instant_text(first)} to {instant_text(last)}"
    nothing = [r["term"] for r in explain(logs, plan).collect() if r["n"] == 0 and r["term"] != "*"]
    if nothing:
        return f"nothing matches {', '.join(nothing)} on its own"
    return "every term matches something, but no record matches all of them"


# --- handoff --------------------------------------------------------------------


def redacted(value: str) -> str:
    return "redacted:" + hashlib.sha256(value.encode()).hexdigest()[:12]


def redact(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named bag values replaced by a short hash: in the bag, the fields, the message and the raw text."""
    for name in names:
        value = F.nullif(F.col("bag")[F.lit(name)], F.lit(""))
        mark = F.concat(F.lit("redacted:"), F.substring(F.sha2(value.cast("binary"), 256), 1, 12))
        own = {c: F.when(value.isNotNull(), F.replace(F.col(c), value, mark)).otherwise(F.col(c)) for c in ("message", "raw", "fields")}
        bag = F.when(value.isNotNull(), F.transform_values("bag", lambda k, v: F.when(k == name, mark).otherwise(v))).otherwise(F.col("bag"))
        rows = rows.withColumns({**own, "bag": bag})
    return rows


@dataclass
class Handoff:
    """What is passed on to somebody else: the query, its window and notes, where the records come from, and some of them."""

    query: str
    window: tuple[str | None, str | None]
    notes: list[str]
    matched: int
    sources: list[dict]
    records: list[dict]
    hidden: list[str] = field(default_factory=list)

    def markdown(self) -> str:
        lines = [f"# {self.query or 'all records'}", "", f"Window: {self.window[0] or 'start'} to {self.window[1] or 'end'} (UTC). Records: {self.matched}.", ""]
        lines += [f"- {n}" for n in self.notes] + ["", "| source | file | records |", "|---|---|---|"]
        lines += [f"| {s['source']} | {s['file']} | {s['records']} |" for s in self.sources]
        return "\n".join([*lines, "", "```", *(r["raw"] for r in self.records), "```", ""])

    def json(self) -> str:
        return json.dumps(self.__dict__, default=str, ensure_ascii=False)

    def write(self, path: str) -> None:
        """As .md, .json, or a .zip with both and the raw lines."""
        if path.endswith(".zip"):
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("handoff.md", self.markdown())
                z.writestr("handoff.json", self.json())
                z.writestr("raw.log", "".join(r["raw"] + "\n" for r in self.records))
            return
        with open(path, "w") as f:
            f.write(self.json() if path.endswith(".json") else self.markdown())


def handoff(logs: Logs, plan: Plan, redact: tuple[str, ...] = (), limit: int = HANDOFF_LIMIT) -> Handoff:
    """Collects at most ``limit`` records; named fields' values are replaced in the bag, the message and the raw text."""
    matching = logs.matching(plan)
    rows = [r.asDict(recursive=True) for r in ordered(matching).limit(limit).select("ts", "level", "source", "file", "line_no", "message", "raw", "bag").collect()]
    for row in rows:
        for name in redact:
            value = (row["bag"] or {}).get(name)
            if value:
                row["bag"][name] = redacted(value)
                for place in ("message", "raw"):
                    row[place] = (row[place] or "").replace(value, redacted(value))
    found = sources(Logs(matching, logs.promotions, logs.zone, logs.now)).collect()
    window = tuple(instant_text(x) if x is not None else None for x in plan.window)
    return Handoff(plan.text, window, plan.notes, sum(r["records"] for r in found), [r.asDict() for r in found], rows, list(redact))


__all__ = ["WindowTerm", "detect_trace_field", "diff", "explain", "handoff", "trace", "trace_reach", "trace_summary", "why_empty", "within"]
