"""Quality rules with cross-document line frequency.

Base rules look at one text alone. The method hashes normalised lines, counts
the distinct documents of a host that hold each, removes the lines above the
limit and rejects documents that are depleted by it. Exact copies of a text
within a host count as one document, so a line is boilerplate only if
different documents share it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialize, raw_texts

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A line in more distinct documents of a host than this, and than one in LINE_SHARE of them, is removed.
LINE_LIMIT, LINE_SHARE = 10, 2000
#: A document with less than this per cent of its words left is depleted.
LEAST_LEFT = 30

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_MIX = np.random.default_rng(20).integers(1 << 62, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
_DIGITS = re.compile(rb"[0-9]+")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    mixed = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        mixed += codes[k : n - window + 1 + k] * _MIX[k % WINDOW]
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - window + 1, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = raw.split()
    points = len(raw.decode("utf-8", "replace")) - sum(raw.count(c) for c in (_SPACES[i : i + 1] for i in range(6)))
    symbols = sum(raw.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS)))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and line.split(None, 1):
            seen.add(line)
    repeat = repeated_words(words)
    n = len(words)
    return n, points, symbols, dup, repeat, n < LEAST_WORDS or 100 * repeat > MOST_REPEATED * n


def normalise(line: bytes) -> bytes:
    """Words lower-cased and joined by one space, digits as 0; empty for a line without words."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, text_hash long, lines array<struct<line:long,words:long>>"
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), _LINES]
_NAMES = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "text_hash", "lines"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_weights(raw: bytes) -> list[tuple[int, int]]:
    """Hash of each distinct normalised line and the words that all its occurrences in the text hold."""
    found: dict[bytes, int] = {}
    for line in map(normalise, raw.split(b"\n")):
        if line:
            found[line] = found.get(line, 0) + line.count(b" ") + 1
    return [(_signed(xxhash.xxh64_intdigest(line)), words) for line, words in found.items()]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*base_counts(raw), _signed(xxhash.xxh64_intdigest(raw)), [{"line": a, "words": b} for a, b in line_weights(raw)]) for raw in raw_texts(batch.column(2))]
        columns = list(zip(*rows)) or [()] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=_NAMES)


def measured(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Per document the base counts, a hash of the text, and hash and words of each distinct normalised line."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(_measure, f"doc_id {kind}, host string, {_BASE}")


def host_lines(base: DataFrame) -> DataFrame:
    """(host, line, text_hash, words): each line once for each distinct text of a host."""
    lines = base.select("host", "text_hash", F.inline("lines"))
    return lines.groupBy("host", "line", "text_hash").agg(F.max("words").alias("words"))


def judge(docs: DataFrame, limit: int = LINE_LIMIT, share: int = LINE_SHARE, least_left: int = LEAST_LEFT, host: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, n_words_removed.

    kept is false for a document that fails the base rules or of whose words
    less than ``least_left`` per cent remain once the lines in more than
    ``limit`` distinct documents of its host, and more than one in ``share`` of them, are removed.

    Null text is empty, and so fails the base rules; null and empty hosts form
    one host. Rows that repeat a doc_id are judged each by its own text. Extra
    columns are not carried. An empty table gives an empty table.
    """
    base = materialize(measured(docs, host, text), "measured")
    lines = materialize(host_lines(base), "lines")
    common = materialize(lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > limit), "frequent")
    texts = base.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.sum("one").alias("texts"))
    common = looked_up(common, materialize(texts, "hosts"), "host", "line").where(F.col("documents") * share > F.col("texts"))
    gone = lines.join(materialize(common.select("host", "line"), "common"), ["host", "line"], "left_semi")
    gone = materialize(gone.groupBy("host", "text_hash").agg(F.sum("words").alias("n_words_removed")), "gone")
    out = base.drop("lines").join(gone, ["host", "text_hash"], "left")
    removed = F.coalesce("n_words_removed", F.lit(0)).cast("long")
    left = 100 * (F.col("n_words") - removed) >= least_left * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & left).alias("kept"), removed.alias("n_words_removed"))
