"""Context-tree weighting over bytes, and an add-one word baseline.

A text is its words in lower case (A-Z only), joined by single spaces, and an
end mark: the same tokens that the baseline scores. Each byte is eight binary
decisions. For each decision node (the bits of the byte so far) there is a
tree over the preceding 0 to ``DEPTH`` bytes, whose nodes hold how often the
training texts went either way. Krichevsky-Trofimov estimates of all depths are
mixed by their context-tree weights: a node's block probability is
half that of its own estimate plus half the product of its children's, and the
share of the first half says how far the node stops there.

A decision never seen below some depth is mixed over the depths where it was
seen, so every byte's probabilities sum to one.

Counting: workers count byte n-grams and words of the whole training texts and
merge them before the shuffle, so what is gathered grows with the corpus. The
tree keeps every n-gram. It is dealt into blocks of whole contexts of ``SPLIT``
bytes, in the order of their codes, of at most ``MOST_GRAMS`` n-grams (or one
context); the driver needs some 250 bytes an n-gram of a block, a worker some 50. A first round over the blocks
yields the block probabilities of the contexts of ``SPLIT`` bytes, from which the
shorter contexts are weighted; a second one broadcasts a block at a time, and
each scores the decisions in its contexts. Scores do not depend on the blocks. Words:
counts of the ``TOP_WORDS`` most frequent are broadcast, the others are joined, so every count is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw_texts, tokens

DEPTH = 5
MOST_GRAMS = 4_000_000
#: Bytes of context that are never parted: a block of the tree holds all that extends them.
SPLIT = 2
TOP_WORDS = 200_000
#: Bytes of text that a worker handles at once; words that it counts before it passes them on.
CHUNK_BYTES, PENDING_WORDS, PENDING_GRAMS = 2 << 20, 500_000, 3_000_000
#: Symbols that are looked up in the tree at once.
PIECE = 1 << 17
PAD, END = 0xFE, 0xFF
FOLDS, HELD_FOLD = 7, 2

GRAM, WORD, TEXTS = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text (null: empty) leaves 2 modulo 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def framed(words: list[bytes], depth: int) -> bytes:
    return bytes([PAD]) * depth + b" ".join(words) + bytes([END])


def symbol_codes(data: bytes, depth: int) -> np.ndarray:
    """Code of each symbol with its ``depth`` bytes of context; pads are no symbols."""
    if len(data) <= depth:
        return np.empty(0, np.uint64)
    held = np.frombuffer(b"\0" * (7 - depth) + data, np.uint8)
    out = np.ndarray((len(data) - depth,), ">u8", held, 0, (1,)).astype(np.uint64)
    out &= np.uint64((1 << 8 * (depth + 1)) - 1)
    return out[held[7:] != PAD]


def gram_codes(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the symbols, and the symbols' places."""
    return symbol_codes(data, depth), np.flatnonzero(np.frombuffer(data, np.uint8)[depth:] != PAD) + depth


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def word_hash(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >= 1 << 63 else x


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and how often each is there; sorts ``codes`` in place."""
    codes.sort()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[starts], np.diff(starts, append=len(codes))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    n = np.concatenate(counts)[order]
    return key[starts], np.add.reduceat(n, starts) if len(key) else n


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 200_000):
                k = keys[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[at : at + 200_000])], names=["kind", "key", "n"])

        words: dict[bytes, int] = {}
        keys, counts, pending, texts = [], [], 0, 0

        def spill_words() -> Iterator[pa.RecordBatch]:
            yield from rows(WORD, np.fromiter(map(word_hash, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for batch in batches:
            for chunk in chunks(raw_texts(batch.column(0))):
                texts += len(chunk)
                data = b"".join(framed(w, depth) for w in chunk)
                for own in chunk:
                    for w in own:
                        words[w] = words.get(w, 0) + 1
                found, n = _tally(symbol_codes(data, depth))
                keys.append(_signed(found))
                counts.append(n)
                pending += len(found)
                if pending > PENDING_GRAMS:
                    key, n = _merge(keys, counts)
                    if len(key) > PENDING_GRAMS // 2:
                        yield from rows(GRAM, key, n)
                        keys, counts, pending = [], [], 0
                    else:
                        keys, counts, pending = [key], [n], len(key)
                if len(words) > PENDING_WORDS:
                    yield from spill_words()
        if keys:
            yield from rows(GRAM, *_merge(keys, counts))
        if texts:
            yield from spill_words()
            yield from rows(TEXTS, np.zeros(1, np.int64), np.array([texts], np.int64))

    return run


def chunks(raws: list[bytes]) -> Iterator[list[list[bytes]]]:
    """Words of texts, so many texts at a time that they hold CHUNK_BYTES or are one."""
    held, size = [], 0
    for raw in raws:
        if held and size + len(raw) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(tokens(raw))
        size += len(raw)
    if held:
        yield held


# --- the tree -----------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series eight above, and back down."""
    x = np.asarray(x, np.float64)
    y = x + 8
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass
class Tree:
    """grams[d], sums[d]: sorted codes of d context bytes and a symbol, and the counts before each.

    Every worker holds one, so it keeps each code once: what belongs to a node is
    found by the place of its first code, what belongs to a code by the code's place.
    """

    depth: int
    grams: list[np.ndarray]
    sums: list[np.ndarray]
    stops: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # (bit, depth): stopping shares, at the nodes' first codes
    slots: np.ndarray | None = None  # hash table of places in the deepest codes, _FREE where there is none
    values: np.ndarray | None = None

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of each code's symbol after its context."""
        out = np.empty(len(codes), np.float32)
        if self.slots is None or not len(codes):
            return self._long_way(codes) if len(codes) else out
        at, going, top = _slot(codes, len(self.slots)), np.arange(len(codes)), self.grams[self.depth]
        while len(going):
            found = self.slots[at]
            none = found == _FREE
            hit = (top[found] == codes[going]) & ~none
            out[going[hit]] = self.values[found[hit]]
            if none.any():
                lost, where = np.unique(codes[going[none]], return_inverse=True)
                out[going[none]] = self._long_way(lost)[where]
            on = ~(hit | none)
            going, at = going[on], (at[on] + 1) % len(self.slots)
        return out

    def _long_way(self, codes: np.ndarray) -> np.ndarray:
        """The same from the counts, for codes that training has not seen."""
        total = np.zeros(len(codes))
        for bit in range(8):
            one = (codes >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            shares, seen, stops = [], [], []
            for d in range(self.depth + 1):
                code = codes & _mask(8 * (d + 1))
                node = code >> np.uint64(8 - bit)
                low = node << np.uint64(8 - bit)
                first, half, end = (np.searchsorted(self.grams[d], low + np.uint64(x)) for x in (0, 1 << 7 - bit, 1 << 8 - bit))
                a, m, z = (self.sums[d][x] for x in (first, half, end))
                ones, both = z - m, z - a
                shares.append((np.where(one, ones, both - ones) + 0.5) / (both + 1.0))
                seen.append(both > 0)
                if d < self.depth:
                    share = self.stops.get((bit, d), _NONE)
                    stops.append(np.where(seen[d], share[np.minimum(first, len(share) - 1)], 1.0) if len(share) else np.ones(len(codes)))
            q = shares[self.depth]
            for d in range(self.depth - 1, -1, -1):
                q = np.where(seen[d + 1], stops[d] * shares[d] + (1 - stops[d]) * q, shares[d])
            total += np.log2(q)
        return total.astype(np.float32)


_FREE, _NONE = -1, np.empty(0, np.float32)


def _slot(codes: np.ndarray, size: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - int(size).bit_length() + 1)).astype(np.int64)


def _hash_table(codes: np.ndarray) -> np.ndarray:
    """Places of distinct codes, by their hashes."""
    size = 1 << max(4, int(2 * len(codes)).bit_length())
    slots = np.full(size, _FREE, np.int32 if len(codes) < 1 << 31 else np.int64)
    left, at = np.arange(len(codes)), _slot(codes, size)
    while len(left):
        free = np.flatnonzero(slots[at] == _FREE)
        _, first = np.unique(at[free], return_index=True)
        put = free[first]
        slots[at[put]] = left[put]
        on = np.ones(len(left), bool)
        on[put] = False
        left, at = left[on], (at[on] + 1) % size
    return slots


def _sums(counts: np.ndarray) -> np.ndarray:
    """Counts before each code, and all; four bytes each where that holds them."""
    out = np.r_[0, np.cumsum(counts)]
    return out.astype(np.uint32) if out[-1] < 1 << 32 else out


def _nodes(codes: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one depth's nodes, where each starts in the codes, and how often they went to zero and to one."""
    key = codes >> np.uint64(8 - bit)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    both = np.add.reduceat(counts, starts) if len(key) else counts
    one = np.add.reduceat(counts * (codes >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64), starts) if len(key) else counts
    return key[starts], starts, both - one, one


def _parents(above: np.ndarray, keys: np.ndarray, d: int, bit: int) -> np.ndarray:
    """Places of the nodes at depth ``d`` in the keys of the depth above."""
    return np.searchsorted(above, keys & _mask(8 * (d - 1) + bit)).astype(np.int32)


def _weighed(own: np.ndarray, parents: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log block probabilities and stopping shares of nodes, from their own estimates and their children's block probabilities."""
    below = np.bincount(parents, weighted, len(own))
    extended = np.bincount(parents, minlength=len(own)) > 0
    mixed = np.where(extended, np.logaddexp(own, below) - math.log(2), own)
    return mixed, np.where(extended, np.exp(own - math.log(2) - mixed), 1.0).clip(0, 1)


Joints = list[tuple[np.ndarray, np.ndarray]]  # for each bit: keys of the nodes at a depth, their log block probabilities


def joints_of(levels: list[tuple[np.ndarray, np.ndarray]], split: int) -> Joints:
    """The nodes at depth ``split`` of a block that holds whole contexts of so many bytes."""
    out = []
    for bit in range(8):
        keys, _, zeros, ones = _nodes(*levels[-1], bit)
        weighted = log_kt(zeros, ones)
        for d in range(len(levels) - 2, split - 1, -1):
            above, _, zeros, ones = _nodes(*levels[d], bit)
            weighted, _ = _weighed(log_kt(zeros, ones), _parents(above, keys, d + 1, bit), weighted)
            keys = above
        out.append((keys, weighted))
    return out


def build_tree(levels: list[tuple[np.ndarray, np.ndarray]], split: int = 0, joints: Joints | None = None) -> Tree:
    """Tree from (sorted codes, counts) for 0 to depth context bytes.

    With ``joints``, those of all blocks, the levels from ``split`` down are one
    block's, and those above it are the whole tree's.
    """
    depth = len(levels) - 1
    tree = Tree(depth, [c for c, _ in levels], [_sums(n) for _, n in levels])
    top = levels[depth][0]
    if not len(levels[0][0]):
        return tree
    total = np.zeros(len(top))
    for bit in range(8):
        keys, owner, zeros, ones, firsts = [], None, [], [], []
        for codes, counts in levels:
            key, starts, zero, one = _nodes(codes, counts, bit)
            keys.append(key)
            zeros.append(zero)
            ones.append(one)
            firsts.append(starts)
            owner = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(codes)]))  # the last is of the deepest
        parents = [None] + [_parents(keys[d - 1], keys[d], d, bit) for d in range(1, depth + 1)]
        weighted = log_kt(zeros[depth], ones[depth])
        stops: list = [None] * depth
        for d in range(depth - 1, -1, -1):
            children = parents[d + 1]
            if joints is not None and d == split - 1:
                children, weighted = _parents(keys[d], joints[bit][0], split, bit), joints[bit][1]
            weighted, stops[d] = _weighed(log_kt(zeros[d], ones[d]), children, weighted)
            tree.stops[bit, d] = np.zeros(len(tree.grams[d]), np.float32)
            tree.stops[bit, d][firsts[d]] = stops[d]
        one = (top >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        node = owner
        share = lambda d, node: (np.where(one, ones[d][node], zeros[d][node]) + 0.5) / (zeros[d][node] + ones[d][node] + 1.0)  # noqa: B023, E731
        q = share(depth, node)
        for d in range(depth - 1, -1, -1):
            node = parents[d + 1][node]
            q = stops[d][node] * share(d, node) + (1 - stops[d][node]) * q
        total += np.log2(q)
    if len(top):
        tree.slots, tree.values = _hash_table(top), total.astype(np.float32)
    return tree


# --- the corpus ---------------------------------------------------------------


@dataclass
class Counts:
    table: DataFrame  # kind, key, n
    tokens: int
    vocabulary: int
    texts: int


def _counted(train: DataFrame, depth: int) -> DataFrame:
    """Workers have merged their own counts, so these are dealt out as they are and added up only behind the shuffle."""
    parts = train.select("text").mapInArrow(_count(depth), "kind int, key long, n long")
    return parts.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def count_corpus(train: DataFrame, depth: int = DEPTH) -> Counts:
    """N-gram and word counts over all texts of ``train`` (column text)."""
    table = materialize(_counted(train, depth), "counts")
    by = {r["kind"]: r for r in table.groupBy("kind").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n")).collect()}
    texts = by[TEXTS]["n"] if TEXTS in by else 0
    words = (by[WORD]["n"], by[WORD]["distinct"]) if WORD in by else (0, 0)
    return Counts(table, words[0] + texts, words[1] + (texts > 0), texts)


def _sorted(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = grams.select("key", "n").toArrow()
    codes = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return codes[order], found.column("n").to_numpy()[order]


def _levels(codes: np.ndarray, n: np.ndarray, depth: int, first: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted codes, counts) for ``first`` to ``depth`` context bytes, from those of the deepest."""
    out = [(codes, n)]
    for d in range(depth - 1, first - 1, -1):
        key, count = _merge([out[0][0] & _mask(8 * (d + 1))], [out[0][1]])
        out.insert(0, (key, count))
    return out


@dataclass
class Block:
    """Part ``number`` of ``of``: the decisions whose ``split`` bytes of context are from ``first`` on, below ``end``."""

    tree: Tree
    number: int = 0
    of: int = 1
    split: int = 0
    first: int = 0
    end: int = 0

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of each code's symbol after its context; 0 outside the block."""
        if self.of == 1:
            return self.tree.log2(codes)
        context = codes >> np.uint64(8) & _mask(8 * self.split)
        at = np.flatnonzero((context >= np.uint64(self.first)) & (context < np.uint64(self.end)))
        out = np.zeros(len(codes), np.float32)
        out[at] = self.tree.log2(codes[at])
        return out


def trees_of(counts: Counts, depth: int = DEPTH, most: int = MOST_GRAMS) -> Iterator[Block]:
    """The weighted tree over all n-grams, block by block."""
    grams = counts.table.where(F.col("kind") == GRAM).select("key", "n")
    split = min(SPLIT, depth)
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * split) - 1))
    sizes = sorted(tuple(r) for r in grams.groupBy(context.alias("context")).agg(F.count(F.lit(1)).alias("codes")).collect())  # at most 65536 rows
    edges, held = [0], 0
    for value, codes in sizes:
        if held and held + codes > most:
            edges.append(value)
            held = 0
        held += codes
    if len(edges) == 1:
        yield Block(build_tree(_levels(*_sorted(grams), depth)))
        return
    edges.append(1 << 8 * split)
    top = _levels(*_sorted(grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * split) - 1)).alias("key")).agg(F.sum("n").alias("n"))), split - 1)
    block = lambda n: _levels(*_sorted(grams.where((context >= edges[n]) & (context < edges[n + 1]))), depth, split)
    parts = [joints_of([*top, *block(n)], split) for n in range(len(edges) - 1)]
    joints = [tuple(np.concatenate([part[bit][x] for part in parts]) for x in (0, 1)) for bit in range(8)]
    for n in range(len(edges) - 1):
        yield Block(build_tree([*top, *block(n)], split, joints), n, len(edges) - 1, split, edges[n], edges[n + 1])


@dataclass
class Shared:
    block: Block
    words: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    texts: int
    denominator: float


_SCORED = "held_out boolean, n_tokens long, n_known long, n_bytes long, base_part double, score double, rare array<struct<word:long,times:int>>, frame binary"
_RARE = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int32())]))


def _frame_scores(block: Block, data: list[bytes]) -> list[float]:
    """log10 of the probability of each frame's decisions in the block."""
    depth, joined = block.tree.depth, b"".join(data)
    bits = np.concatenate([block.log2(symbol_codes(joined[at : at + depth + PIECE], depth)) for at in range(0, len(joined) - depth, PIECE)])
    ends = np.cumsum([len(x) - depth for x in data])
    return (np.add.reduceat(bits, np.r_[0, ends[:-1]], dtype=np.float64) * math.log10(2)).tolist()


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Shared = shared.value
        known = dict(zip(model.words.tolist(), np.log10(model.counts + 1.0).tolist()))
        frequent: dict[bytes, float] = {}
        end_log = math.log10(model.texts + 1.0)
        depth = model.block.tree.depth
        for batch in batches:
            rows = []
            for chunk in chunks(raw_texts(batch.column(2))):
                data = [framed(w, depth) for w in chunk]
                for own, frame, score in zip(chunk, data, _frame_scores(model.block, data)):
                    base, hits, rare = end_log, int(model.texts > 0), {}
                    for w in own:
                        if (x := frequent.get(w)) is None:
                            h = word_hash(w)
                            if h not in known:
                                rare[h] = rare.get(h, 0) + 1
                                continue
                            x = frequent[w] = known[h]
                        base += x
                        hits += 1
                    listed = [{"word": h, "times": n} for h, n in rare.items()]
                    rows.append((len(own) + 1, hits, len(frame) - depth, base - (len(own) + 1) * model.denominator, score, listed, frame if model.block.of > 1 else None))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), _RARE, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_part", "score", "rare", "frame"])

    return run


def _score_frames(shared):
    """Scores of the decisions in one block, for texts that are framed already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, held, size = [], [], 0
            for frame in batch.column(1).to_pylist():
                if held and size + len(frame) > CHUNK_BYTES:
                    scores += _frame_scores(shared.value, held)
                    held, size = [], 0
                held.append(frame)
                size += len(frame)
            if held:
                scores += _frame_scores(shared.value, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score_texts(docs: DataFrame, depth: int = DEPTH, most: int = MOST_GRAMS, top_words: int = TOP_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the documents outside the held-out fold. Scores are log10
    probabilities of the whole text; bits_per_byte is the code length of its
    normalised bytes and end mark. Null text is empty, and an empty text is its end mark
    alone. Rows that repeat a doc_id are each scored (and learnt from). Extra
    columns are not carried; an empty table gives an empty table; without a
    training text every binary decision has probability a half.
    """
    counts = count_corpus(docs.where(~held_out(F.col("doc_id"))), depth)
    words = counts.table.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    top = words.orderBy(F.desc("n"), "word").limit(top_words).toArrow().sort_by("word")
    denominator = math.log10(counts.tokens + counts.vocabulary + 1) if counts.texts else 0.0
    kind = docs.schema["doc_id"].dataType.simpleString()
    context, parts = docs.sparkSession.sparkContext, []
    for block in trees_of(counts, depth, most):
        if not block.number:
            shared = context.broadcast(Shared(block, top.column("word").to_numpy(), top.column("n").to_numpy(), counts.texts, denominator))
            rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(shared), f"doc_id {kind}, {_SCORED}")
            rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
            parts.append(rows.select("row", "score"))
        else:
            shared = context.broadcast(block)
            parts.append(materialize(rows.select("row", "frame").mapInArrow(_score_frames(shared), "row long, score double"), "scored-block"))
        shared.destroy()
    if len(parts) > 1:
        rows = rows.drop("frame", "score").join(materialize(reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("score").alias("score")), "scores"), "row")
    rare = rows.select("row", F.inline("rare"))
    joined = rare.join(words, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    added = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("base_more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_more"))
    out = rows.drop("rare").join(materialize(added, "added"), "row", "left")
    known = (F.col("n_known") + F.coalesce("known_more", F.lit(0))).cast("long")
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base_part") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
