"""Line dedup with a log-template tree.

A line's tokens that hold a digit are variable and masked. The parse tree has
a fixed depth: the number of tokens, then the first ``LEADING`` masked tokens; a
path ends in a leaf. Two kinds of template come out of a leaf:

* the masked line itself, if it recurs. Where masking leaves no letter (numbers
  in a table), the line as it is; lines without letters and digits have no template;
* its generalised templates. A token is a constant of the leaf if
  ``least`` documents have it in that position; the other positions are variable fields. Lines
  with the same constants are one template, if ``SIMILAR`` of the positions are constant,
  of all and of those behind the leading ones. Lines that are left over are tried once more
  with the tokens that nearly all of them share (``CONSTANT``).

A template recurs if ``LEAST_DOCUMENTS`` texts with words of their own hold it, and these are
a tenth of all texts that do. Exact
copies are one text. A text has words of its own if, of its words outside candidate templates
(those in that many texts of any kind), at least half are in lines that no other text shares. A line is
shared if one of its sketches, the least or greatest of the hashes of five words from each word start in it, is in
another text: so a copy's edited lines are shared, and a group of copies is no
evidence against its own lines, however large it is, while pages
that consist of the same lines but for one of their own are.

A template of ``LONG_TOKENS`` tokens or more also recurs if two unlike texts hold it:
of the least hashes, in ``MARKS`` classes, of the words outside it, under ``ALIKE`` agree.

Lines of recurring templates are dropped from every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, fresh, looked_up, materialize, raw_texts, salted_join

LEADING, LEAST_DOCUMENTS = 3, 10
LONG_TOKENS, MARKS = 50, 32
#: Two texts are unlike below this share of equal marks. Of the texts that hold a template, this share must speak for it.
ALIKE, SPREAD = 0.3, 0.1
#: Share of the lines left over that a constant token is in, and of positions that must be constant.
CONSTANT, SIMILAR = 0.8, 0.6
#: Of the words outside candidate templates, this share is the text's own.
OWN = 0.5
#: Hashes of dropped templates that are broadcast at most; more are joined to the texts.
MOST_TEMPLATES = 4_000_000
#: Bits of the maps that narrow later passes to texts and leaves of interest.
MAP_BITS = 26
#: Bytes from a word start that are hashed: some five words.
WINDOW = 32
#: Texts that a worker remembers, to parse copies once.
SEEN = 200_000

_DIGIT = re.compile(rb"[0-9]")
_LETTER = re.compile(rb"[a-z\x80-\xff]")
_VARIABLE = re.compile(rb"\S*[0-9]\S*")
_MASK = b"<*>"
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masked_tokens(line: bytes) -> list[bytes]:
    """Tokens of a line (ASCII white space, A-Z in lower case), those with a digit masked; none without a letter or digit."""
    low = line.lower()
    digit = _DIGIT.search(low)
    masked = _VARIABLE.sub(_MASK, low) if digit else low
    if _LETTER.search(masked):
        return masked.split()
    return low.split() if digit else []


def codes(line: bytes) -> tuple[int, int, list[bytes]] | None:
    """(leaf, template, tokens); None for a line that has no template."""
    words = masked_tokens(line)
    if not words:
        return None
    digest = xxhash.xxh3_64_intdigest
    leaf = digest(b"%d " % len(words) + b" ".join(words[:LEADING]))
    return _signed(leaf), _signed(digest(b" ".join(words))), words


def word_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each word start in a text, the number of its line and the hash of the ``WINDOW`` bytes from it."""
    data = np.frombuffer(raw + b" " * WINDOW, np.uint8)
    n = len(raw)
    space = data[: n - 1] <= 0x20
    at = np.r_[0, np.flatnonzero(space & (data[1:n] > 0x20)) + 1]
    windows = np.ndarray((n + WINDOW - 7,), "<u8", data, 0, (1,))
    mixed = sum(windows[at + 8 * k] * _WEIGHTS[k] for k in range(WINDOW // 8))
    mixed ^= mixed >> np.uint64(32)
    mixed *= _WEIGHTS[0]
    return np.searchsorted(np.flatnonzero(data[:n] == 0x0A), at), (mixed ^ mixed >> np.uint64(29)) >> np.uint64(1)


def line_sketches(line: np.ndarray, hashes: np.ndarray, lines: int) -> list[tuple[int, int, int]]:
    """SKETCHES of each line: the least and the greatest hash of its word starts, and the least by another function."""
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    out = np.zeros((lines, 3), np.int64)
    for k, reduced in enumerate((np.minimum, np.maximum, np.minimum)):
        out[line[starts], k] = reduced.reduceat(hashes * _WEIGHTS[1] >> np.uint64(1) if k == 2 else hashes, starts)
    return list(map(tuple, out.tolist()))


def text_marks(templates: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """For each of MARKS classes of hashes the least one, its template, and the least one of another template; -1 where there is none."""
    kind, value = hashes % np.uint64(MARKS), (hashes // np.uint64(MARKS) & np.uint64(0x7FFFFFFF)).astype(np.int64)
    order = np.lexsort((value, kind))
    kind, value, held = kind[order].astype(np.int64), value[order], templates[order]
    least, by, second = np.full(MARKS, -1), np.zeros(MARKS, np.int64), np.full(MARKS, -1)
    first = np.unique(kind, return_index=True)[1]
    least[kind[first]], by[kind[first]] = value[first], held[first]
    others = held != by[kind]
    first = np.unique(kind[others], return_index=True)[1]
    second[kind[others][first]] = value[others][first]
    return least.tolist(), by.tolist(), second.tolist()


SKETCHES = ("low", "high", "other")
_LINE = "text long, leaf long, template long, tokens int, words int, low long, high long, other long"
_MARKED = "text long, marks struct<least:array<int>,by:array<long>,second:array<int>>"
_MARKS = pa.struct([("least", pa.list_(pa.int32())), ("by", pa.list_(pa.int64())), ("second", pa.list_(pa.int32()))])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text and template."""
    seen: set[int] = set()
    for batch in batches:
        rows = []
        for text, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
            if text in seen:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(text)
            found = [codes(line) for line in raw.split(b"\n")]
            line, hashes = word_windows(raw)
            own: dict[int, list] = {}
            for code, sketches in zip(found, line_sketches(line, hashes, len(found))):
                if code:
                    leaf, template, tokens = code
                    if row := own.get(template):
                        row[4] += len(tokens)
                        row[5:8] = min(row[5], sketches[0]), max(row[6], sketches[1]), min(row[7], sketches[2])
                    else:
                        own[template] = [text, leaf, template, len(tokens), len(tokens), *sketches]
            rows.extend(own.values())
        columns = list(zip(*rows)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text", "leaf", "template", "tokens", "words", "low", "high", "other"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("text") > 0).select(F.xxhash64("text").alias("id"), "text")


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each distinct text (its hash) and template in it."""
    every = _texts(docs).mapInArrow(_lines, _LINE).groupBy("template", "text")
    return materialize(every.agg(*(F.min(c).alias(c) for c in ("leaf", "tokens", "words", *SKETCHES))), "lines")


def _bits(rows: DataFrame, key: str) -> np.ndarray:
    """A map of 8 MB of the keys, whatever their number."""
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    slot = F.col(key).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    set_ = rows.groupBy(F.shiftright(slot, 3).cast("int").alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast({key} & 7 AS int))")).alias("bits")).toArrow()
    bits[set_.column("byte").to_numpy()] = set_.column("bits").to_numpy()
    return bits


def _has(bits: np.ndarray, keys):
    return bits[(keys & (len(bits) * 8 - 1)) >> 3] >> (keys & 7) & 1


def _among(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[list[tuple[int, bytes]]]:
    """Of each batch, the texts whose bit is set (that may be more than were asked for), copies only now and then."""
    seen: set[int] = set()
    for batch in batches:
        held = batch.filter(pa.array(_has(bits, batch.column(0).to_numpy()).astype(bool)))
        if len(seen) > SEEN:
            seen.clear()
        own = dict(zip(held.column(0).to_pylist(), raw_texts(held.column(1))))
        yield [(text, raw) for text, raw in own.items() if text not in seen]
        seen.update(own)


def _marked(shared):
    """Marks of the texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _among(batches, shared.value):
            marks = []
            for _, raw in own:
                found = [codes(line) for line in raw.split(b"\n")]
                line, hashes = word_windows(raw)
                templates = np.array([code[1] if code else 0 for code in found])
                marks.append(dict(zip(("least", "by", "second"), text_marks(templates[line], hashes))))
            yield pa.RecordBatch.from_arrays([pa.array([text for text, _ in own], pa.int64()), pa.array(marks, _MARKS)], names=["text", "marks"])

    return run


def _evidence(lines: DataFrame, least: int) -> DataFrame:
    """Texts and their templates, with 1 for the texts that have words of their own."""
    texts = lines.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min("tokens").alias("tokens"))
    long = (F.col("tokens") >= LONG_TOKENS) & (F.col("texts") >= 2)
    candidates = materialize(texts.where((F.col("texts") >= least) | long).select("template"), "candidates")
    sketches = lines.select("text", F.explode(F.array(*SKETCHES)).alias("sketch"))
    shared = sketches.groupBy("sketch").agg(F.min("text").alias("first"), F.max("text").alias("last")).where("first < last")
    shared = materialize(shared.select("sketch"), "shared")
    rest = flagged(lines, candidates, "template", "candidate", "text").where(~F.col("candidate")).select("text", "words", *SKETCHES)
    for kind in SKETCHES:
        rest = flagged(rest, shared.withColumnRenamed("sketch", kind), kind, f"{kind}_shared", "text")
    rest = rest.withColumn("shared", F.greatest(*(f"{kind}_shared" for kind in SKETCHES)))
    words = rest.groupBy("text").agg(F.sum("words").alias("all"), F.sum(F.when(~F.col("shared"), F.col("words")).otherwise(0)).alias("own"))
    own = words.where((F.col("own") > 0) & (F.col("own") >= OWN * F.col("all"))).select("text", F.lit(1).alias("evidence"))
    held = lines.select("text", "leaf", "template").join(own, "text", "left")
    return materialize(held.withColumn("evidence", F.coalesce("evidence", F.lit(0))), "evidence")


def _spread(least: int):
    return (F.col("documents") >= least) & (F.col("documents") >= SPREAD * F.col("texts"))


def _long_recurring(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Long templates in texts of which ``SPREAD`` are unlike one of them (the one with the least hash), but for that line."""
    long = lines.where(F.col("tokens") >= LONG_TOKENS).select("template", "text")
    several = materialize(long.groupBy("template").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("template"), "long")
    held = materialize(flagged(long, several, "template", "several", "text").where("several").select("template", "text"), "long-held")
    bits = _bits(held, "text")
    if not bits.any():
        return held.select("template")
    marked = _texts(docs).mapInArrow(_marked(docs.sparkSession.sparkContext.broadcast(bits)), _MARKED).groupBy("text").agg(F.min("marks").alias("marks"))
    rest = F.transform("marks.least", lambda x, n: F.when(F.col("marks.by")[n] == F.col("template"), F.col("marks.second")[n]).otherwise(x))
    held = materialize(held.join(marked, "text").select("template", "text", rest.alias("rest")).where(F.exists("rest", lambda x: x >= 0)), "long-lines")
    first = materialize(held.groupBy("template").agg(F.min(F.struct("text", "rest"))["rest"].alias("first")), "first")
    both = lambda agree: F.aggregate(F.zip_with("rest", "first", lambda x, y: agree(x, y).cast("int")), F.lit(0), lambda n, x: n + x)
    apart = both(lambda x, y: (x == y) & (x >= 0)) < ALIKE * both(lambda x, y: (x >= 0) | (y >= 0))
    unlike = looked_up(held, first, "template", "text").groupBy("template").agg(F.sum(apart.cast("int")).alias("n"), F.count(F.lit(1)).alias("texts"))
    return unlike.where((F.col("n") > 0) & (F.col("n") >= SPREAD * F.col("texts"))).select("template")


def _leaf_lines(shared):
    """Tokens of the lines in leaves whose bit is set, of texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, leaves = shared.value
        seen: set[int] = set()
        for held in _among(batches, texts):
            own: dict[int, tuple] = {}
            for _, raw in held:
                for line in raw.split(b"\n"):
                    if line and (found := codes(line)) and _has(leaves, found[0]) and found[1] not in seen:
                        own[found[1]] = (found[0], found[1], [_signed(xxhash.xxh3_64_intdigest(w)) for w in found[2]])
                        seen.add(found[1])
            if len(seen) > SEEN:
                seen.clear()
            columns = list(zip(*own.values())) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["leaf", "template", "line"])

    return run


def _alike(lines: DataFrame, least: int, constant: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(template, group) of the lines whose constants make a template, and the lines that are left over."""
    key = F.xxhash64("leaf", "at", "token").alias("key")
    tokens = lines.select("leaf", "template", "documents", F.posexplode("line").alias("at", "token"))
    frequent = materialize(constant(tokens.groupBy("leaf", "at", "token").agg(F.sum("documents").alias("n"))).select(key), "constants")
    marked = flagged(tokens.select("leaf", "template", "documents", "at", "token", key), frequent, "key", "constant", "template")
    entry = F.when(F.col("constant"), F.struct("at", "token"))
    shapes = marked.groupBy("leaf", "template").agg(F.first("documents").alias("documents"), F.count(F.lit(1)).alias("length"), F.sort_array(F.collect_list(entry)).alias("kept"))  # one entry a token of a line
    free, kept = F.col("length") - LEADING, F.size("kept")
    whole = (kept >= SIMILAR * F.col("length")) & (kept - LEADING >= SIMILAR * free)
    shapes = materialize(shapes.where(whole).select("template", "documents", F.xxhash64("leaf", "kept").alias("group")), "shapes")
    groups = shapes.groupBy("group").agg(F.sum("documents").alias("n")).where(F.col("n") >= least)
    found = materialize(shapes.join(groups, "group", "left_semi").select("template", "group"), "alike")
    return found, lines.join(found, "template", "left_anti")


def _generalised(docs: DataFrame, held: DataFrame, support: DataFrame, least: int) -> DataFrame | None:
    """Templates (the masked lines) that agree with a generalised template of ``least`` texts in their leaf.

    Works on distinct masked lines, each read from one of its texts and weighed by all. Tokens are
    counted by (leaf, position, token), so a large leaf is dealt out too.
    """
    several = support.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("documents").alias("n")).where(f"kinds > 1 AND n >= {least}")
    several = materialize(several.select("leaf"), "several")
    once = flagged(held.where("evidence = 1").select("leaf", "text"), several, "leaf", "several", "text").where("several").groupBy("leaf", "text").agg(F.lit(1).alias("one"))
    leaves = materialize(once.groupBy("leaf").agg(F.sum("one").alias("n")).where(F.col("n") >= least).select("leaf"), "leaves")
    if leaves.isEmpty():
        return None
    wanted = flagged(support.select("leaf", "text"), leaves, "leaf", "wanted", "text").where("wanted")
    shared = docs.sparkSession.sparkContext.broadcast((_bits(wanted, "text"), _bits(leaves, "leaf")))
    found = _texts(docs).mapInArrow(_leaf_lines(shared), "leaf long, template long, line array<long>")
    lines = found.groupBy("leaf", "template").agg(F.first("line").alias("line")).join(leaves, "leaf", "left_semi")
    lines = materialize(lines.join(support.select("template", "documents"), "template"), "leaf-lines")
    first, left = _alike(lines, least, lambda n: n.where(F.col("n") >= least))
    left = materialize(left, "left-over")
    total = left.groupBy("leaf").agg(F.sum("documents").alias("of"))
    second, _ = _alike(left, least, lambda n: n.join(total, "leaf").where(F.col("n") >= CONSTANT * F.col("of")))
    found = materialize(first.unionByName(second), "generalised")
    once = looked_up(held, found, "template", "text").where(F.col("group").isNotNull()).groupBy("group", "text").agg(F.max("evidence").alias("evidence"))
    groups = once.groupBy("group").agg(F.sum("evidence").alias("documents"), F.count(F.lit(1)).alias("texts")).where(_spread(least))
    return found.join(groups, "group", "left_semi").select("template")


def _recurring(docs: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    held = _evidence(lines, least)
    support = held.groupBy("template").agg(F.sum("evidence").alias("documents"), F.count(F.lit(1)).alias("texts"), F.min("leaf").alias("leaf"), F.min("text").alias("text"))
    support = materialize(support.where("documents > 0"), "support")
    exact = support.where(_spread(least)).select("template").unionByName(_long_recurring(docs, lines))
    more = _generalised(docs, held, support, least)
    return materialize((exact if more is None else exact.unionByName(more)).distinct(), "recurring")


def recurring_templates(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(template): hashes of the masked lines that are dropped."""
    return _recurring(docs, line_table(docs), least)


def _clean(raw: bytes | None, gone: Callable[[list[int]], list[bool]]) -> tuple[bytes | None, int, int]:
    """The text without its lines of templates that are gone, and the lines and words dropped."""
    lines = (raw or b"").split(b"\n")
    found = [codes(x) if x else None for x in lines]
    drop = gone([f[1] if f else 0 for f in found])
    drop = [d and f is not None for d, f in zip(drop, found)]
    if not any(drop):
        return raw, 0, 0
    return b"\n".join(x for x, d in zip(lines, drop) if not d), sum(drop), sum(len(f[2]) for f, d in zip(found, drop) if d)


def _apply(at: int, report: tuple[int, int] | None, shared=None, listed: int | None = None):
    """Clean the texts in column ``at``; templates come sorted with ``shared`` or, for each row, in column ``listed``."""

    def among(templates: np.ndarray) -> Callable[[list[int]], list[bool]]:
        def gone(keys: list[int]) -> list[bool]:
            found = np.array(keys, np.int64)
            return (templates[np.minimum(np.searchsorted(templates, found), len(templates) - 1)] == found).tolist() if len(templates) else [False] * len(keys)

        return gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = among(shared.value) if shared is not None else None
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            if common is not None:
                done = [_clean(raw, common) for raw in texts]
            else:
                lists = batch.column(listed).to_pylist()
                done = [_clean(raw, among(np.sort(np.array(own or [], np.int64)))) for raw, own in zip(texts, lists)]
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at] = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
            for place, n in zip(report or (), (1, 2)):
                columns[place] = pa.array([d[n] for d in done], pa.int64())
            if listed is not None:
                del columns[listed], names[listed]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def drop_templates(docs: DataFrame, templates: DataFrame, lines: DataFrame | None = None, report: bool = False, most: int = MOST_TEMPLATES) -> DataFrame:
    """``docs`` without the lines of these templates, and with lines_dropped and words_dropped for a report.

    Up to ``most`` templates are broadcast. Beyond that each text is joined with the list of its own ones.
    """
    at, report_at = docs.columns.index("text"), None
    if report:
        docs = docs.withColumns({"lines_dropped": F.lit(0).cast("long"), "words_dropped": F.lit(0).cast("long")})
        report_at = (docs.columns.index("lines_dropped"), docs.columns.index("words_dropped"))
    templates = materialize(templates, "dropped")
    if templates.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(templates.toArrow().column("template").to_numpy()))
        return docs.mapInArrow(_apply(at, report_at, shared=shared), docs.schema)
    lines = line_table(docs) if lines is None else lines
    held = flagged(lines.select("text", "template"), templates, "template", "gone", "text").where("gone")
    id_, gone, salt = (fresh(docs.columns, x) for x in ("text_id", "gone", "salt"))
    held = held.groupBy(F.col("text").alias(id_)).agg(F.collect_list("template").alias(gone))  # no more than a text's lines
    rows = docs.withColumns({id_: F.xxhash64("text"), salt: F.monotonically_increasing_id()})
    joined = salted_join(rows, materialize(held, "held"), id_, salt).select(*(F.col(f"`{c}`") for c in docs.columns), gone)
    return joined.mapInArrow(_apply(at, report_at, listed=len(docs.columns)), docs.schema)


def drop_recurring_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs`` with their recurring lines gone, and n_chars (if there) counted anew where text is not null.

    All rows and columns stay; a text can become empty. Null texts stay null.
    """
    lines = line_table(docs)
    out = drop_templates(docs, _recurring(docs, lines, least), lines)
    if "n_chars" in docs.columns:
        length = F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", length)
    return out


def _crc(values: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in values:
        crc = pa.array([zlib.crc32(x) for x in raw_texts(batch.column(1))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), crc], names=["doc_id", "lines_dropped", "words_dropped", "text_crc32"])


def report(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, lines_dropped, words_dropped, text_crc32 of what stays.

    Null and empty texts have no lines. Rows that repeat a doc_id are each
    reported. Extra columns are not carried; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", "text")
    lines = line_table(rows)
    cleaned = drop_templates(rows, _recurring(rows, lines, least), lines, report=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cleaned.mapInArrow(_crc, f"doc_id {kind}, lines_dropped long, words_dropped long, text_crc32 long")
