"""Packing documents into sequences of a fixed token length by linear grouping and best fit.

Only the histogram of piece lengths (one count a length, so at most
``capacity`` numbers whatever the corpus) reaches the driver. There the plan is
made:

1. Lengths over ``capacity / SMALL`` are large. Sorted, they are cut into groups of
   equal cardinality and rounded up to the longest of their group.
2. The few rounded sizes make a cutting-stock problem, solved by column
   generation; configurations are used as often as the whole part of the solution.
3. The groups' actual lengths take the places, longest first.
4. What remains, and the small lengths, go best fit, longest first, into the
   space that is left, then into new sequences.

The plan says for each length which ranks go to which run of sequences at which
offset. Pieces get their rank within their length from a window over
(length, hash bucket) and per-bucket offsets, so that not even the one hot
length of full pieces gathers in a task, and look their place up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, tokenizer_path

CAPACITY, END_ID = 2048, 0
#: Large pieces are those over capacity / SMALL; with 400 groups the plan stays within 0.1 % of best fit decreasing.
GROUPS, SMALL = 400, 2.5
#: Buckets that the ranks of a length are counted in, at least, and pieces of all lengths in one.
BUCKETS, BUCKET_PIECES = 512, 50_000
VOCABULARY = "word_bpe_49k.json"
#: Chunks that are no plain words whose ids a worker remembers; words that are encoded in one call.
CACHE_CHUNKS, WORDS_AT_ONCE = 50_000, 20_000
#: Words are added to those that a worker remembers until there are so many.
KNOWN_WORDS = 150_000
#: Bytes of text that are split into words at once, and chunks of them whose ids are put together at once.
BATCH_TEXT, PART_CHUNKS = 8 << 20, 1 << 17

#: Lower-case letters that neither lower-casing nor composition changes, and marks that may end a word.
_LETTERS, _MARKS = "a-zß-öø-ÿœ", ".,;:!?)"
_WORD, _WORD_MARK, _MARK_END = f"^[{_LETTERS}]+$", f"^[{_LETTERS}]+[{_MARKS}]$", f"[{_MARKS}]$"


class WordIds:
    """Token ids of texts, by the distinct white-space separated chunks of a batch.

    The vocabulary's normalizer and pre-tokenizer never look across white space,
    so a text's ids are those of its chunks in a row. A-Z are lower-cased
    first, as the normalizer would, except next to ``<|``, where a special
    token may be spelled.

    A chunk of Latin lower-case letters is one word to the pre-tokenizer and is left alone by
    the normalizer; a mark that ends it is a token of its own. Such words are encoded
    together, joined by spaces, and told apart by the ids that end a
    word. Other chunks go through the whole tokenizer, and are remembered.
    Everything else is done in Arrow and numpy, without an object a chunk.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.bare = (Tokenizer(self.tokenizer.model) for _ in range(2))  # all three share the one model in memory
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # for ASCII, which the byte mapping leaves as it is
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = pa.array(list(_MARKS))
        self.mark_ids = np.array([self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in _MARKS], "<u4")
        self.others: dict[str, np.ndarray] = {}
        self.known, self.known_ids, self.known_sizes = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has. The words of a worker's first batches are remembered: the frequent ones are among them."""
        place = pc.index_in(words, self.known)
        fresh = pc.is_null(place)
        ids, sizes = self._encoded(words.filter(fresh))
        flat, every = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes])
        entries = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        entries[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(sizes))
        if len(self.known) < KNOWN_WORDS:
            self.known = pa.concat_arrays([self.known, words.filter(fresh)])
            self.known_ids, self.known_sizes = flat, every
        return _gathered(flat, every, entries), every[entries]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        ids, sizes = [], np.zeros(len(words), np.int64)
        ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        placed = []
        for model, at in ((self.plain, np.flatnonzero(ascii_)), (self.bare, np.flatnonzero(~ascii_))):
            for low in range(0, len(at), WORDS_AT_ONCE):
                part = at[low : low + WORDS_AT_ONCE]
                text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], words.take(pa.array(part))), " ")[0].as_py()
                found = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[found]) + 1
                if len(stops) != len(part):
                    raise ValueError("the vocabulary's words do not end with </w>")
                sizes[part] = np.diff(np.r_[0, stops])
                ids.append(found)
                placed.append(part)
        if not placed:
            return np.empty(0, "<u4"), sizes
        order = np.concatenate(placed)
        return _gathered(np.concatenate(ids), sizes[order], np.argsort(order)), sizes

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and how many each has."""
        marked = pc.match_substring_regex(chunks, _WORD_MARK)
        word = pc.or_(marked, pc.match_substring_regex(chunks, _WORD)).to_numpy(zero_copy_only=False)
        marked = marked.to_numpy(zero_copy_only=False)
        own = chunks.filter(pa.array(word))
        bases = pc.replace_substring_regex(own, _MARK_END, "").dictionary_encode()
        ids, sizes = self._words(bases.dictionary)
        index = bases.indices.to_numpy(zero_copy_only=False)
        rest = chunks.filter(pa.array(~word)).to_pylist()
        if len(self.others) > CACHE_CHUNKS:
            self.others.clear()
        fresh = [x for x in rest if x not in self.others]
        self.others.update((x, np.array(e.ids, "<u4")) for x, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)))
        found = [self.others[x] for x in rest]
        # word ids first, then a mark's, then those of the other chunks: all as entries that are gathered in the chunks' order
        mark = pc.index_in(pc.utf8_slice_codeunits(chunks.filter(pa.array(marked)), -1), self.marks).to_numpy(zero_copy_only=False)
        flat = np.concatenate([ids, self.mark_ids, *found])
        entry_sizes = np.concatenate([sizes, np.ones(len(self.mark_ids), np.int64), np.fromiter(map(len, found), np.int64, len(found))])
        count = 1 + marked.astype(np.int64)
        place = np.cumsum(count) - count
        entries = np.empty(int(count.sum()), np.int64)
        entries[place[word]] = index
        entries[place[marked] + 1] = len(sizes) + mark
        entries[place[~word]] = len(sizes) + len(self.mark_ids) + np.arange(len(rest))
        total = entry_sizes[entries]
        chunk_sizes = np.add.reduceat(total, place) if len(place) else total
        return _gathered(flat, entry_sizes, entries), chunk_sizes

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of consecutive texts, PART_CHUNKS chunks or one text at a time: the number of the first, their ids in a row, each closed by END_ID, and where each text starts (and the last ends).

        The distinct chunks are those of all the texts; the ids, which take many times a text's
        space while they are put together, are held for one part only.
        """
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        del lists
        index = encoded.indices.to_numpy(zero_copy_only=False)
        flat, sizes = self._chunks(encoded.dictionary)
        del encoded
        flat, sizes = np.r_[flat, np.array([END_ID], "<u4")], np.r_[sizes, 1]
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PART_CHUNKS, side="right")) - 1)
            ends = bounds[first + 1 : last + 1] - bounds[first]
            at = np.insert(index[bounds[first] : bounds[last]], ends, len(sizes) - 1)
            yield first, _gathered(flat, sizes, at), np.r_[0, np.cumsum(sizes[at])[ends + np.arange(last - first)]]
            first = last

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by END_ID, and where each text starts (and the last ends)."""
        parts = list(self.parts(texts))
        ids = np.concatenate([np.empty(0, "<u4"), *(found for _, found, _ in parts)])
        return ids, np.r_[0, np.cumsum(np.concatenate([np.empty(0, np.int64), *(np.diff(bounds) for *_, bounds in parts)]))]


def _gathered(flat: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The runs of ``flat``, which lie one after the other with these sizes, in the order of ``entries``."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[entries]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat((starts[entries] - (ends - own)).astype(np.int32), own) + np.arange(total, dtype=np.int32)]


_worker: dict[str, WordIds] = {}

def _portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts, BATCH_TEXT bytes or one text at a time, and the number of the first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = int(sizes[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + BATCH_TEXT, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


PIECE = "piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _worker:
            _worker[path] = WordIds(path)
        for batch in batches:
            owner, piece, length, crc, ids = [], [], [], [], []
            parts = ((before + n, found, bounds) for before, texts in _portions(batch.column(1)) for n, found, bounds in _worker[path].parts(texts))
            for first, found, bounds in parts:
                for row, (low, high) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()), first):
                    for n, at in enumerate(range(low, high, capacity)):
                        part = found[at : min(at + capacity, high)]
                        owner.append(row)
                        piece.append(n)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part.astype(np.int32))
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array([n * capacity for n in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and a closing id 0, cut at ``capacity``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _cut(vocabulary or tokenizer_path(VOCABULARY), capacity, with_ids)
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {PIECE}" + ", ids array<int>" * with_ids)


# --- the plan -----------------------------------------------------------------


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best-valued configuration: how often each size, in ``capacity`` altogether."""
    best = np.zeros((len(sizes) + 1, capacity + 1))
    for i, (size, value) in enumerate(zip(sizes, values)):
        now = best[i].copy()
        if value > 0:
            for _ in range(capacity // size):
                np.maximum(now[size:], now[:-size].copy() + value, out=now[size:])
        best[i + 1] = now
    take, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        while best[i + 1][room] > best[i][room] + 1e-12 and room >= sizes[i]:
            take[i] += 1
            room -= sizes[i]
            if abs(best[i + 1][room] - best[i][room]) <= 1e-12:
                break
    return float(values @ take), take


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Fractional cutting stock by column generation: (configuration, how often)."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        amount = np.linalg.solve(basis, demand)
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-6:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.full(len(sizes), np.inf)
        np.divide(np.maximum(amount, 0), step, out=ratio, where=step > 1e-9)
        basis[:, int(np.argmin(ratio))] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, k].round().astype(np.int64), float(amount[k])) for k in range(len(sizes)) if amount[k] >= 1]


@dataclass
class Plan:
    """Row n: pieces of length[n] with rank in [low[n], high[n]) go to sequence[n] + rank - low[n] at offset[n]."""

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 48) + self.low, length * (1 << 48) + rank, side="right") - 1
        return self.sequence[at] + rank - self.low[at], self.offset[at]


class _Builder:
    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.rank = np.zeros(len(counts), np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
        self.rooms: list[int] = []

    def put(self, length: int, first: int, many: int, offset: int) -> None:
        low = int(self.rank[length])
        self.rows.append((length, low, low + many, first, offset))
        self.rank[length] += many
        self.left[length] -= many

    def leave(self, room: int, first: int, many: int) -> None:
        if many and room:
            if room not in self.open:
                bisect.insort(self.rooms, room)
                self.open[room] = []
            self.open[room].append((first, many))

    def fill(self, first: int, many: int, room: int, length: int, each: int) -> None:
        for k in range(each):
            self.put(length, first, many, self.capacity - room + k * length)
        self.leave(room - each * length, first, many)

    def best_fit(self, length: int) -> None:
        """All that is left of a length: fullest sequences first, new ones last."""
        while (need := int(self.left[length])) > 0:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, many = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    self.rooms.pop(at)
            else:
                room = self.capacity
                first, many = self.sequences, -(-need // (room // length))
                self.sequences += many
            each = room // length
            whole = min(many, need // each)
            if whole:
                self.fill(first, whole, room, length, each)
            if whole < many:
                rest = min(need - whole * each, each)
                if rest and int(self.left[length]) > 0:
                    self.fill(first + whole, 1, room, length, rest)
                    whole += 1
                self.leave(room, first + whole, many - whole)

    def plan(self) -> Plan:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return Plan(*rows.T, sequences=self.sequences)


def _groups(counts: np.ndarray, least: int, groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality over the lengths above ``least``, longest first: [length, count] lists."""
    lengths = [int(x) for x in range(len(counts) - 2, least, -1) if counts[x]]
    total = int(sum(counts[x] for x in lengths))
    if not total:
        return []
    size = -(-total // min(groups, total))
    out: list[list[list[int]]] = [[]]
    room = size
    for x in lengths:
        left = int(counts[x])
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append([x, take])
            left -= take
            room -= take
    return out


def grouped_plan(counts: np.ndarray, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """The plan of the module's steps 1 to 4; counts[n] pieces have length n (n >= 1)."""
    build = _Builder(counts)
    capacity = build.capacity
    build.best_fit(capacity)  # full pieces are sequences of their own
    parts = _groups(counts, int(capacity / small), groups)
    by_size: dict[int, list[list[int]]] = {}
    for part in parts:  # groups that round to the same size are one
        by_size.setdefault(part[0][0], []).extend(part)
    sizes = np.array(list(by_size), np.int64)
    stock = [list(reversed(by_size[int(s)])) for s in sizes]  # the longest last, to pop
    if len(sizes):
        demand = np.array([sum(n for _, n in part) for part in stock], float)
        for column, amount in configurations(sizes, demand, capacity):
            many = int(amount + 1e-9)
            slots = [i for i, n in enumerate(column) for _ in range(n)]
            runs = [(build.sequences, many, 0)]  # first, how many, used
            build.sequences += many
            for i in slots:
                after = []
                for first, count, used in runs:
                    while count and stock[i]:
                        length, there = stock[i][-1]
                        take = min(count, there)
                        build.put(length, first, take, used)
                        after.append((first, take, used + length))
                        stock[i][-1][1] -= take
                        if there == take:
                            stock[i].pop()
                        first, count = first + take, count - take
                    if count:
                        after.append((first, count, used))
                runs = after
            for first, count, used in runs:
                build.leave(capacity - used, first, count)
    for length in range(capacity - 1, 0, -1):
        build.best_fit(length)
    return build.plan()


# --- placing ------------------------------------------------------------------


def _ranked(cut: DataFrame, pieces: int) -> DataFrame:
    """Rank of each piece within its length, from 0 and without gaps.

    Most pieces may have one length, so the buckets that ranks are counted in grow with the pieces.
    """
    buckets = max(BUCKETS, pieces // BUCKET_PIECES)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    counted = materialize(cut.select("length", bucket.alias("bucket")).groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(own) - 1)
    return numbered.join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            sequence, offset = plan.value.place(length, batch.column("rank").to_numpy(zero_copy_only=False))
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Null text is empty: such a document is the single id 0. Rows that repeat a
    doc_id are packed each. Pieces that are equal in every column may swap
    places. Extra columns are not carried; an empty table gives an empty table.
    """
    cut = materialize(pieces(docs, capacity, vocabulary, with_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(grouped_plan(counts))
    order = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = cut.select(*order).schema.add("sequence_id", "long").add("offset", "long")
    return _ranked(cut, int(counts.sum())).select(*order, "rank").mapInArrow(_place(plan), schema)
