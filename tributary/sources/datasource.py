"""Log files as a Spark data source: ``spark.read.format("loglines")`` and ``spark.readStream``.

A partition is a file, or a stretch of a large uncompressed one: a stretch begins at a
line, leaves continuation lines at its start to the stretch before and follows
its own last record beyond its end. The format is chosen from the file's
beginning. Rows leave as Arrow batches. ``seq`` and ``line_no`` are dense: parts number
their records and lines from 1, and one small row a part gives each its base.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tributary.functions.scratch import stored
from tributary.model import LOGS_SCHEMA
from tributary.sources.codecs import open_decoded
from tributary.sources.formats import FORMATS, MIXED, Format, choose
from tributary.sources.reader import SAMPLE_LINES, ReadStats, read, row, split_lines, valid_text
from tributary.sources.walk import Found, Listing, logical_source, walk_all

#: Rows of the source: those of the logs table, with the file's place and the record's place in it instead of seq.
ROWS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rec_no", T.LongType()), *LOGS_SCHEMA.fields[1:]])
STATS = "part int, file string, format string, lines long, records long, unparsed long, no_timestamp long, continuation long, truncated long, blank long, zone_assumed long, invalid_utf8 long, zone_abbrevs map<string,int>"
_ARROW = pa.schema(
    [("part", pa.int32()), ("rec_no", pa.int64()), ("ts", pa.timestamp("us")), ("ts_zoned", pa.bool_()), ("level", pa.string()), ("message", pa.string()), ("source", pa.string()), ("file", pa.string()), ("format", pa.string()), ("line_no", pa.int64()), ("parsed", pa.bool_()), ("raw", pa.string()), ("fields", pa.string())]
    + [("bag", pa.map_(pa.string(), pa.string())), ("kinds", pa.map_(pa.string(), pa.string())), ("pattern", pa.string()), ("pattern_id", pa.string())]
)
BATCH = 2000
SPLIT_BYTES = 128 << 20
#: Bytes that a follower takes in at one look.
POLL_BYTES = 64 << 20


def paths_of(options: dict) -> list[str]:
    return json.loads(options["paths"]) if "paths" in options else [options["path"]]


def list_files(options: dict) -> Listing:
    split = lambda name: tuple(x for x in options.get(name, "").split(",") if x)
    extra = {"most_bytes": int(options["maxFileSize"])} if "maxfilesize" in {k.lower() for k in options} else {}
    return walk_all(paths_of(options), include=split("include"), exclude=split("exclude"), **extra)


def format_for(path: str, codec: str | None, override: str | None) -> Format:
    if override:
        return MIXED if override == "mixed" else FORMATS[override]
    with open_decoded(path, codec) as f:
        sample = []
        for data, _, _ in split_lines(f):
            if data.strip():
                sample.append(valid_text(data)[0])
            if len(sample) >= SAMPLE_LINES:
                break
    return choose(sample)


@dataclass
class FilePart(InputPartition):
    order: int
    file: Found
    start: int = 0
    stop: int | None = None  # the whole file


def parts_of(files: list[Found], size: int = SPLIT_BYTES) -> list[FilePart]:
    """Whole files, and stretches of uncompressed files larger than ``size``, in reading order."""
    out: list[FilePart] = []
    for f in files:
        if f.codec is not None or f.size <= size:
            out.append(FilePart(len(out), f))
        else:
            out += [FilePart(len(out) + n, f, at, min(at + size, f.size)) for n, at in enumerate(range(0, f.size, size))]
    return out


def open_part(part: FilePart):
    """The part's stream at its first line start, and the offsets of that and of the first line that is no longer its own."""
    f = open_decoded(part.file.path, part.file.codec)
    start = part.start
    if start:
        f.seek(start - 1)
        start += len(f.readline()) - 1
    return f, start, part.stop


def rows_of(part: FilePart, parser: str | None, zone: str, stats: ReadStats | None = None) -> Iterator[dict]:
    source = logical_source(part.file.path)
    fmt = format_for(part.file.path, part.file.codec, parser)
    f, start, stop = open_part(part)
    with f:
        if stop is not None and start >= stop:
            return
        for n, entry in enumerate(read(f, fmt, zone, stats, start=start, stop=stop), 1):
            yield {"part": part.order, "rec_no": n, **row(entry, source, part.file.path)}


def batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def made() -> pa.RecordBatch:
        columns = []
        for f in _ARROW:
            values = [list(r[f.name].items()) if pa.types.is_map(f.type) else r[f.name] for r in held]
            columns.append(pa.array(values, f.type))
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield made()
            held = []
    if held:
        yield made()


class LogReader(DataSourceReader):
    def __init__(self, options: dict, only_stats: str):
        self.options, self.only_stats = dict(options), only_stats
        self.parser, self.zone = options.get("parser"), options.get("sourceTz", options.get("sourcetz", "UTC"))

    def partitions(self) -> list[FilePart]:
        return parts_of(list_files(self.options).files, int(self.options.get("splitBytes", self.options.get("splitbytes", SPLIT_BYTES))))

    def read(self, partition: FilePart) -> Iterator:
        if not isinstance(partition, FilePart):  # nothing to read
            return
        if self.only_stats != "no":
            yield from self._figures(partition)
        else:
            yield from batches(rows_of(partition, self.parser, self.zone))

    def _figures(self, part: FilePart) -> Iterator[tuple]:
        stats, name = ReadStats(), ""
        if self.only_stats == "lines":
            f, start, stop = open_part(part)
            with f:
                for _, _, offset in split_lines(f, offset=start):
                    if stop is not None and offset >= stop:
                        break
                    stats.lines += 1
        else:
            name = format_for(part.file.path, part.file.codec, self.parser).name
            for _ in rows_of(part, self.parser, self.zone, stats):
                pass
        yield (part.order, part.file.path, name, stats.lines, stats.records, stats.unparsed, stats.no_timestamp, stats.continuation, stats.truncated, stats.blank, stats.zone_assumed, stats.invalid_utf8, dict(stats.zone_abbrevs))


class LogStreamReader(SimpleDataSourceStreamReader):
    """Follows files. The offset says for each file how far whole records were read.

    A file's last record is held back until a further line shows that it is
    complete (or the file has not grown between two polls), so a late
    continuation line never splits it. A file that shrank or whose beginning
    changed is read again from its start.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.parser, self.zone = options.get("parser"), options.get("sourceTz", options.get("sourcetz", "UTC"))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        end, out, left = dict(start), [], int(self.options.get("pollBytes", self.options.get("pollbytes", POLL_BYTES)))
        for n, f in enumerate(list_files(self.options).files):
            if f.codec is not None and f.path in start:
                continue
            if left <= 0:
                break  # the next poll goes on here
            rows, state = poll(f, start.get(f.path), n, self.parser, self.zone, most=left)
            left -= max(0, state["seen"] - start.get(f.path, {"offset": 0})["offset"])
            out += rows
            end[f.path] = state
        return iter([_tuple(r) for r in out]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        out = []
        for n, f in enumerate(list_files(self.options).files):
            if f.path in end and end[f.path] != start.get(f.path):
                rows, _ = poll(f, start.get(f.path), n, self.parser, self.zone, until=end[f.path])
                out += rows
        return iter([_tuple(r) for r in out])

    def commit(self, end: dict) -> None:
        return None


def head_hash(path: str, size: int = 4096) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read(size)).hexdigest()[:32]


def poll(file: Found, state: dict | None, order: int, parser: str | None, zone: str, until: dict | None = None, most: int | None = None) -> tuple[list[dict], dict]:
    """New whole records of a file since ``state``, and the state after them; from ``most`` bytes, if a record is no longer."""
    import io

    fresh = {"head": "", "head_size": 0, "offset": 0, "line": 1, "rec": 0, "size": -1, "format": ""}
    state = dict(state or fresh)
    if state["head_size"] and (file.size < state["offset"] or head_hash(file.path, state["head_size"]) != state["head"]):
        state = fresh
    fixed = FORMATS.get(state["format"]) or (MIXED if state["format"] == "mixed" else None)
    size = file.size if most is None else min(file.size, state["offset"] + most)
    while True:
        if file.codec is not None:
            with open_decoded(file.path, file.codec) as f:
                data = f.read()
        else:
            with open(file.path, "rb") as f:
                f.seek(state["offset"])
                data = f.read((until["seen"] if until else size) - state["offset"])
        seen = state["offset"] + len(data)
        still = until["still"] if until else (seen == state.get("seen") and size == file.size or file.codec is not None)
        complete = data if still else data[: data.rfind(b"\n") + 1]
        fmt = fixed
        if fmt is None:
            fmt = FORMATS.get(parser) if parser and parser != "mixed" else choose([valid_text(x)[0] for x in complete.split(b"\n")[:SAMPLE_LINES]])
        entries = list(read(io.BytesIO(complete), fmt, zone, first_line=state["line"]))
        if until or size >= file.size or len(entries) > 1:
            break
        size = min(file.size, 2 * size - state["offset"])  # a record is longer than that
    held = entries[-1:] if entries and not still else []
    done = entries[: len(entries) - len(held)]
    rows = [{"part": order, "rec_no": state["rec"] + n, **row(e, logical_source(file.path), file.path)} for n, e in enumerate(done, 1)]
    used = held[0].offset if held else len(complete)
    head = min(4096, seen)
    after = {"head": head_hash(file.path, head) if file.codec is None and head else "", "head_size": head if file.codec is None else 0, "offset": state["offset"] + used, "line": state["line"] + complete[:used].count(b"\n"), "rec": state["rec"] + len(done), "seen": seen, "still": still, "format": fmt.name if entries else ""}
    return rows, after


def _tuple(r: dict) -> tuple:
    from tributary.dsl.timeexpr import moment

    return tuple(moment(r["ts"]) if f.name == "ts" and r["ts"] is not None else r[f.name] for f in ROWS.fields)


class LogLines(DataSource):
    """Options: path or paths (a JSON list), parser, sourceTz, include, exclude, maxFileSize; ``stats`` for figures a file."""

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self):
        return ROWS if self.options.get("stats", "no") == "no" else STATS

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options, self.options.get("stats", "no"))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogLines)


def _options(paths: list[str], **options) -> dict[str, str]:
    return {"paths": json.dumps([os.path.abspath(p) for p in paths]), **{k: str(v) for k, v in options.items() if v is not None}}


def read_stats(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Per file: what was read, and what could not be."""
    register(spark)
    parts = spark.read.format("loglines").options(**_options(paths, **options), stats="all").load()
    figures = [F.sum(c).alias(c) for c, t in parts.dtypes if t == "bigint"]
    whole = parts.groupBy("file", "format").agg(*figures)
    named = parts.select("file", F.explode("zone_abbrevs").alias("name", "n")).groupBy("file", "name").agg(F.sum("n").cast("int").alias("n"))
    named = named.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("zone_abbrevs"))
    return whole.join(named, "file", "left").orderBy("file")


def with_seq(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Dense ``seq`` and ``line_no``: the parts' bases are one small row a part and are joined back."""
    from pyspark.sql.window import Window

    counts = rows.groupBy("part").agg(F.max("rec_no").alias("n"))
    counts = lines.select("part", F.col("file").alias("of"), "lines").join(counts, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("lines").over(of_file), F.lit(0)).alias("line_base"))
    numbered = rows.join(bases, "part").withColumns({"seq": (F.col("base") + F.col("rec_no")).cast("long"), "line_no": F.col("line_no") + F.col("line_base")})
    return numbered.select(*LOGS_SCHEMA.names)


def read_logs(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Files below ``paths`` as a logs table.

    Numbering needs the parts' record counts before the first row leaves, so the
    parsed rows are stored once as Parquet, and both come from there.
    """
    register(spark)
    own = _options(paths, **options)
    lines = spark.read.format("loglines").options(**own, stats="lines").load()
    rows = stored(spark.read.format("loglines").options(**own).load(), "logs")
    return with_seq(rows, lines)


def follow_logs(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The same as a stream; ``seq`` is left out, as records of several files come in together."""
    register(spark)
    return spark.readStream.format("loglines").options(**_options(paths, **options)).load()


def read_stdin(spark: SparkSession, parser: str | None = None, zone: str = "UTC", stream=None) -> DataFrame:
    """Standard input up to its end, as a logs table."""
    entries = read(stream or sys.stdin.buffer, FORMATS.get(parser) if parser else None, zone)
    rows = [{"seq": n, **row(e, "stdin", "-")} for n, e in enumerate(entries, 1)]
    from tributary.dsl.timeexpr import moment

    values = [tuple(moment(r["ts"]) if f.name == "ts" and r["ts"] is not None else r[f.name] for f in LOGS_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(values, LOGS_SCHEMA)


def read_files_and_stdin(spark: SparkSession, paths: list[str], stream=None, parser: str | None = None, sourceTz: str = "UTC", **options) -> DataFrame:
    """Files and standard input (``-``) in one table. The files come first, wherever the stream is named: it may go on for long."""
    files = [p for p in paths if p != "-"]
    if "-" not in paths:
        return read_logs(spark, files, parser=parser, sourceTz=sourceTz, **options)
    piped = read_stdin(spark, parser, sourceTz, stream)
    if not files:
        return piped
    read_ = read_logs(spark, files, parser=parser, sourceTz=sourceTz, **options)
    base = read_.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("base"))  # one row
    after = piped.crossJoin(F.broadcast(base)).withColumn("seq", F.col("seq") + F.col("base")).select(*read_.columns)
    return read_.unionByName(after)
