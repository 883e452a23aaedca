"""Following log files: new records through a filter, as they come."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.dsl.syntax import DslError, TimeTerm, parse
from tributary.dsl.timeexpr import TimeContext, micros, resolve
from tributary.functions.predicates import predicate
from tributary.model import LOGS_SCHEMA, Promotion
from tributary.plans.schema import Schema, UnknownField
from tributary.sources.datasource import follow_logs
from tributary.sources.infer import promote

POLL = "400 milliseconds"
HELD = 32


def stream_schema(promotions: tuple[Promotion, ...], keys: tuple[str, ...], sources: tuple[str, ...] = ()) -> Schema:
    """Schema of a stream: nothing can be counted ahead, so the keys are those seen so far."""
    types = {f.name: f.dataType.simpleString() for f in LOGS_SCHEMA.fields} | {p.column: p.sql_type for p in promotions}
    return Schema((*LOGS_SCHEMA.names, *(p.column for p in promotions)), promotions, keys, sources, types)


def compiled(text: str, schema: Schema, zone: str = "UTC", now: int | None = None):
    """Filter of a stream; ``last:`` is anchored at the wall clock unless told otherwise."""
    from datetime import datetime, timezone

    query = parse(text)
    if query.stats:
        raise DslError("a stream lists records; a stats clause does not belong there")
    if any(isinstance(t, TimeTerm) for t in query.terms):
        anchor = now if now is not None else micros(datetime.now(timezone.utc))
        query = resolve(query, TimeContext(anchor, anchor, zone, anchor))
    return predicate(query, schema)


@dataclass
class First:
    """A stream's filter, resolved against the records of the first batch that has any."""

    text: str
    promotions: tuple[Promotion, ...] = ()
    keys: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    where: Column | None = None

    def filter(self, batch: Callable[[], DataFrame]) -> Column | None:
        """None as long as there are no records."""
        if self.where is None:
            found = batch()
            if found.isEmpty():
                return None
            own = [r.key for r in found.select(F.explode(F.map_keys("bag")).alias("key")).distinct().collect()]
            self.where = self.resolved(tuple(dict.fromkeys((*self.keys, *own))))
        return self.where

    def resolved(self, keys: tuple[str, ...]) -> Column:
        try:
            return compiled(self.text, stream_schema(self.promotions, keys, self.sources))
        except UnknownField as problem:
            raise DslError(f"{problem} (a stream's filter is resolved against the records that have arrived so far)") from None


@dataclass
class Follower:
    """New records of files, with frozen promotions, to a function a batch.

    The source's offsets are checkpointed, so after a restart no record is shown
    again and none is lost; a record is only emitted once it is whole.
    """

    spark: SparkSession
    paths: list[str]
    promotions: tuple[Promotion, ...] = ()
    options: dict = field(default_factory=dict)

    def stream(self) -> DataFrame:
        return promote(follow_logs(self.spark, self.paths, **self.options), list(self.promotions))

    def start(self, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = self.stream().writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL)).start()

    def records(self, text: str, checkpoint: str, emit: Callable[[list], None], available_now: bool = False, keys: tuple[str, ...] = ()) -> StreamingQuery:
        """Matching records in order of time, a batch at a time.

        The filter is resolved once, against ``keys`` and those of the first batch with records. A name
        that is unknown then ends the query with an error.
        """
        first = First(text, self.promotions, keys)

        def each(batch: DataFrame, _: int) -> None:
            where = first.filter(lambda: batch)
            if where is None:
                return
            rows = batch.where(where).orderBy(F.col("ts").asc_nulls_last(), "part", "rec_no").collect()
            if rows:
                emit(rows)

        return self.start(each, checkpoint, available_now)


@dataclass
class Subscriber:
    """Rows for one listener; a full buffer drops the oldest and counts them."""

    text: str
    events: queue.Queue = field(default_factory=lambda: queue.Queue(HELD))
    lag: int = 0

    def put(self, event: tuple) -> None:
        while True:
            try:
                self.events.put_nowait(event)
                return
            except queue.Full:
                try:
                    dropped = self.events.get_nowait()
                    self.lag += len(dropped[1]) if dropped[0] == "records" else 0
                except queue.Empty:
                    pass


class Hub:
    """One follower for many listeners, each with a filter of its own; a batch is read once."""

    def __init__(self, follower: Follower, checkpoint: str):
        self.follower, self.checkpoint = follower, checkpoint
        self.subscribers: list[Subscriber] = []
        self.lock = threading.Lock()
        self.query: StreamingQuery | None = None

    def subscribe(self, text: str) -> Subscriber:
        parse(text)
        one = Subscriber(text)
        with self.lock:
            self.subscribers.append(one)
        return one

    def unsubscribe(self, one: Subscriber) -> None:
        with self.lock:
            self.subscribers.remove(one)

    def start(self, available_now: bool = False) -> StreamingQuery:
        self.query = self.follower.start(self._each, self.checkpoint, available_now)
        return self.query

    def _each(self, batch: DataFrame, _: int) -> None:
        with self.lock:
            listeners = list(self.subscribers)
        if not listeners:
            return
        held = batch.persist()
        try:
            keys = tuple(r.key for r in held.select(F.explode(F.map_keys("bag")).alias("key")).distinct().collect())
            schema = stream_schema(self.follower.promotions, keys)
            for one in listeners:
                try:
                    rows = held.where(compiled(one.text, schema)).orderBy(F.col("ts").asc_nulls_last(), "part", "rec_no").collect()
                except DslError as problem:
                    one.put(("notice", str(problem)))
                    continue
                if rows:
                    one.put(("records", rows))
                if one.lag:
                    lost, one.lag = one.lag, 0
                    one.put(("lag", lost))
        finally:
            held.unpersist()


def stream_pipe(spark: SparkSession, stream, text: str, emit: Callable[[list], None], parser: str | None = None, zone: str = "UTC", rows: int = 500, seconds: float = 0.2) -> int:
    """Records of a live pipe through a filter, a batch at a time; how many there were.

    A batch is closed after ``rows`` records or ``seconds``. The filter is resolved against
    the first batch; a field that is unknown then, or at the end of an empty pipe, is an error.
    """
    import time

    from tributary.dsl.timeexpr import moment
    from tributary.sources.formats import FORMATS
    from tributary.sources.reader import read, row

    held, seen, first, began = [], 0, First(text, sources=("stdin",)), time.monotonic()

    def flush() -> None:
        if not held:
            return
        values = [tuple(moment(r["ts"]) if f.name == "ts" and r["ts"] is not None else r[f.name] for f in LOGS_SCHEMA.fields) for r in held]
        batch = spark.createDataFrame(values, LOGS_SCHEMA)
        held.clear()
        found = batch.where(first.filter(lambda: batch)).orderBy("seq").collect()
        if found:
            emit(found)

    for entry in read(stream, FORMATS.get(parser) if parser else None, zone):
        seen += 1
        held.append({"seq": seen, **row(entry, "stdin", "-")})
        if len(held) >= rows or time.monotonic() - began >= seconds:
            flush()
            began = time.monotonic()
    flush()
    if not seen:
        first.resolved(())
    return seen
