"""WARC archives with revisit records, and an index merged from sorted runs.

``write_archives`` stores captures as WARC/1.1 records, each a gzip member of its
own, through Spark's text writer, so any Hadoop file system serves; an empty member is the
line separator. A file holds ``FILE_BYTES`` of records at most, or one record, and is a
capture run sorted by URL key and timestamp. ``read_archives`` walks the members and
gives the index entries of each run, with which a record can be fetched
from its compressed file.

``merge_runs`` is an external merge. Runs are cut into key ranges, and a range's rows
come in as one stream, in blocks of ``BLOCK`` rows of a run, in the order in
which a k-way merge needs them: a block is due once the last key of the one before it in its
run has been passed (forecasting). A loser tree over the runs' heads puts them in
order by URL key and timestamp, while a task holds one block a run. The ranges together
are one globally ordered capture history.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, materialize, scratch

#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 1000
#: Bytes of records in one archive file, which bounds what a reading task holds; records are parted by size for it.
FILE_BYTES = 1 << 27
SIZES = (1 << 15, 1 << 20, 1 << 25, 1 << 31)
#: Rows of a run that are handed to the merge at once, and rows of a key range.
BLOCK, RANGE_ROWS = 32, 500_000
CRLF = "\r\n"
#: A gzip member of nothing, between the members of the records.
EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0]) + bytes(8)

ENTRY = "page_id long, url string, urlkey string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]
_KEY = "urlkey string, captured string, page_id long, archive string, offset long"
_KEY_KIND = pa.struct([("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def surt(url: str | None) -> str:
    """Sortable URL key: host labels reversed and joined by commas, then ``)`` and the rest, A-Z lower-cased; no fragment."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host = re.split(r"[/?]", rest, maxsplit=1)[0]
    tail = rest[len(host) :] or "/"
    name = host.rsplit("@", 1)[-1].split(":", 1)[0]
    return (",".join(reversed(name.split("."))) + ")" + tail).translate(str.maketrans(_UPPER, _LOWER))


def _surt(url: Column) -> Column:
    """The same as a column."""
    rest = F.substring_index(F.regexp_replace(url, r"(?s)\A.*?://", ""), "#", 1)
    host = F.regexp_extract(rest, r"\A[^/?]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    name = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail))
    return F.when(F.length(url) > 0, F.translate(key, _UPPER, _LOWER)).otherwise("")


def _header_url(url: Column) -> Column:
    out = url
    for raw, safe in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def capture_date(page_id: Column) -> Column:
    """A capture time for pages that have none: one second a page_id from the start of 2024."""
    since = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**8)).cast("int")
    return F.date_format(since + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payloads(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))


def shared_payloads(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, keeper): of equal payloads of at least ``least`` bytes the largest page_id, if one has any."""
    found = payloads(pages).where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return materialize(found.where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "shared")


def records(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """(urlkey, captured, page_id, record): the WARC record of each page.

    Of the payloads in ``shared``, that of the keeper is a response and the others,
    those without a page_id included, are revisits of it.
    """
    placed = looked_up(payloads(pages), shared, "digest", "page_id")
    target = F.when((F.col("page_id").isNull()) | (F.col("page_id") != F.col("keeper")), F.col("keeper"))
    placed = placed.select("page_id", "url", "body", "digest", "bytes", target.alias("target"))
    kept = F.when(F.col("target").isNull(), F.col("body")).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(kept).cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(F.col("target").isNull(), "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f">{CRLF}"),
        _line("WARC-Date", capture_date(F.col("page_id"))),
        _line("WARC-Target-URI", _header_url(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Full-Payload-Length", F.col("bytes").cast("string")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("target").cast("string"), F.lit(">"))),
        F.when(F.col("target").isNull(), "").otherwise(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.octet_length(kept)).cast("string"),
        F.lit(CRLF * 2),
    )
    key = _surt(_header_url(F.col("url")))
    return placed.select(key.alias("urlkey"), capture_date(F.col("page_id")).alias("captured"), "page_id", F.concat(head, http, kept, F.lit(CRLF * 2)).alias("record"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for record in batch.column(0):  # one at a time: a batch may be as large as its records allow
            yield pa.RecordBatch.from_arrays([pa.array([pack(record.as_py().encode())], pa.binary())], names=["member"])


def pack(record: bytes) -> bytes:
    """The record as a gzip member."""
    worker = zlib.compressobj(wbits=31)
    return worker.compress(record) + worker.flush()


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under ``path``; null html is an empty payload."""
    shared = shared_payloads(pages, least)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    kind = F.when(size < SIZES[0], 0)
    for n, end in enumerate(SIZES[1:], 1):
        kind = kind.when(size < end, n)
    kinds = sorted(r[0] for r in pages.select(kind.alias("kind")).distinct().collect())  # at most one row a size class
    for n in kinds or [0]:
        part = pages.where((size >= (SIZES[n - 1] if n else 0)) & (size < SIZES[n]))
        ordered = records(part, shared).sortWithinPartitions("urlkey", "captured", "page_id").select("record")
        packed = ordered.mapInArrow(_pack, "member binary").select(F.col("member").cast("string").alias("value"))
        # The empty member is written as it is, byte by byte.
        out = packed.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1")
        out.option("maxRecordsPerFile", max(1, file_bytes // SIZES[n])).text(f"{path}/size={n}")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of an uncompressed record."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode("utf-8").split(CRLF)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    if data[start + size :] != b"\r\n\r\n":
        raise ValueError("the record does not end where it says")
    block = data[start : start + size]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def members(packed: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members that are not empty, one at a time."""
    at, view = 0, memoryview(packed)
    while at < len(packed):
        worker, content, end = zlib.decompressobj(wbits=31), [], at
        while not worker.eof and end < len(packed):
            content.append(worker.decompress(view[end : end + (1 << 16)]))
            end += 1 << 16
        if not worker.eof:
            raise ValueError(f"the member at byte {at} is cut off")
        end = min(end, len(packed)) - len(worker.unused_data)
        if any(content):
            yield at, end - at, b"".join(content)
        at = end


def _number(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def entries_of(archive: str, packed: bytes) -> list[tuple]:
    """Sorted index entries of one archive; payloads are checked against their digests."""
    out = []
    for offset, length, record in members(packed):
        fields, payload = parse_record(record)
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        size = int(fields["WARC-Full-Payload-Length"])
        if kind == "response":
            found = hashlib.sha1(payload).hexdigest()
            if found != digest or size != len(payload):
                raise ValueError(f"{archive}, byte {offset}: the payload is not the one that was stored")
        url = fields.get("WARC-Target-URI")
        out.append((_number(fields["WARC-Record-ID"]), url, surt(url), fields["WARC-Date"], kind, _number(fields.get("WARC-Refers-To")), size, digest, archive, offset, length))
    return sorted(out, key=sort_key)  # in order already, if written here


def sort_key(entry: tuple) -> tuple:
    return entry[2], entry[3], entry[0] if entry[0] is not None else -1, entry[8], entry[9]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def blocks(entries: list[tuple]) -> Iterator[tuple]:
    """Entries of a sorted run, with their places and the last key of the block before theirs."""
    due = None
    for n, entry in enumerate(entries):
        if n and n % BLOCK == 0:
            due = dict(zip(_KEY_KIND.names, sort_key(entries[n - 1])))
        yield entry + (n, due)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name = "/".join(path.as_py().rsplit("/", 2)[-2:])
            yield from _batches(blocks(entries_of(name, content.as_py())), [*_NAMES, "place", "due"], [*_KINDS, pa.int64(), _KEY_KIND])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under ``path``; those of one archive are sorted, at ``place``, in blocks that are ``due``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_read, f"{ENTRY}, place long, due struct<{_KEY.replace(' ', ':').replace(',:', ',')}>")


class LoserTree:
    """k-way merge: inner nodes hold the losers, so a step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator[Any]], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list[Any] = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, node: int) -> int:
        """Winner below a node; leaves are nodes k to 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[Any]:
        while self.keys[self.winner] is not None:
            at = self.winner
            yield self.heads[at]
            self.heads[at] = next(self.runs[at], None)
            self.keys[at] = None if self.heads[at] is None else self.key(self.heads[at])
            node, win = (at + self.k) // 2, at
            while node:
                if self._beats(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.winner = win


class Forecast:
    """Runs of one stream in which every block comes before it is due: reading a run reads the stream no further than that."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.held = rows, {}
        self.next = next(rows, None)
        self.most = self.now = 0  # rows held
        first: dict[str, int] = {}
        while self.next is not None and first.setdefault(self.next[8], self.next[11] // BLOCK) == self.next[11] // BLOCK:
            self._take()

    def _take(self) -> None:
        self.held.setdefault(self.next[8], deque()).append(self.next[:11])
        self.now += 1
        self.most = max(self.most, self.now)
        self.next = next(self.rows, None)

    def run(self, archive: str) -> Iterator[tuple]:
        mine = self.held[archive]
        while mine:
            self.now -= 1
            entry = mine.popleft()
            yield entry
            if not mine:  # the merge has passed the entry's key
                key = sort_key(entry)
                while self.next is not None and (self.next[12] is None or tuple(self.next[12].values()) <= key):
                    self._take()

    def runs(self) -> list[Iterator[tuple]]:
        return [self.run(archive) for archive in sorted(self.held)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    tree = LoserTree(Forecast(rows).runs(), sort_key)
    yield from _batches((row + (n,) for n, row in enumerate(tree)), [*_NAMES, "ordinal"], [*_KINDS, pa.int64()])


def merge_runs(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered index: partitions are consecutive key ranges, ``ordinal`` counts within one.

    Ranges are cut on the whole key, so the captures of one hot URL may take
    several of them. A task holds a block of each run in its range.
    """
    runs = materialize(entries, "runs")
    order = ["urlkey", "captured", F.coalesce("page_id", F.lit(-1)), "archive", "offset"]
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs.count() / range_rows))
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions(F.asc_nulls_first("due"), "archive", "place")
    return dealt.mapInArrow(_merge, f"{ENTRY}, ordinal long")


def archived_history(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged capture history.

    Null html is an empty payload; a null url has an empty URL key and sorts
    first; repeated rows are each archived (rows that repeat the largest
    page_id of a payload are all responses). Extra columns are not archived. An empty
    table gives an empty history.
    """
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return merge_runs(read_archives(pages.sparkSession, path))
