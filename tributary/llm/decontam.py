"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, by factors of two. For the
partition of up to B shingles a document is read in windows of 2B shingles that
start every B, so each stretch that can hold an item lies whole in a window. An
item of q > B/2 shingles of which a share t or more is in a window has a
Jaccard similarity with it of at least

    J(t) = t q / (2B + (1 - t) q)  >=  t / (4 + 1 - t),

0.19 for t = 0.8. Bands are single MinHash values, so a pair collides in one of
the H bands with probability 1 - (1 - J)^H: over 0.999998 with H = 64. The minima of
windows come from those of their two halves. Pairs that collide are verified by
the exact containment of the item's shingles in the whole document.

Items shorter than a shingle are one shingle of their own length, for which a
window is one shingle too, and J is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, tokens

WIDTH, CONTAINMENT, HASHES = 5, 0.8, 64
#: Items, and bytes of their texts, of one broadcast index; more are searched block by block, each a pass over the texts.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Bytes of text that are searched at once: their shingles stay in a processor's cache.
PORTION = 1 << 20

_MULTIPLIERS = np.random.default_rng(64).integers(1 << 63, size=HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the shingles of ``width`` words, repeats included."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, digest = (ends - lengths)[:n].tolist(), xxhash.xxh3_64_intdigest
    return np.array([digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (H rows) of the blocks of ``hashes`` that begin at ``starts``."""
    out = np.empty((HASHES, len(starts)), np.uint64)
    for k in range(HASHES):
        np.minimum.reduceat(hashes * _MULTIPLIERS[k], starts, out=out[k])
    return out


@dataclass
class Partition:
    """Items of (size/2, size] shingles of ``width`` words: for each band a sorted list of values and whose they are."""

    width: int
    size: int
    values: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)
    maps: list[np.ndarray] = field(default_factory=list)

    def index(self, signatures: np.ndarray, items: np.ndarray) -> None:
        for row in signatures:
            order = np.argsort(row, kind="stable")
            self.values.append(row[order])
            self.owners.append(items[order])
            seen = np.zeros(1 << 16, bool)  # by the low bits of a value, to pass over most windows at once
            seen[(row & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.maps.append(seen)

    def collide(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of ``signatures`` and the items that they share a band with."""
        columns, items = [], []
        for row, values, owners, seen in zip(signatures, self.values, self.owners, self.maps):
            at = np.flatnonzero(seen[(row & np.uint64(0xFFFF)).astype(np.int64)])
            if len(at):
                low, high = np.searchsorted(values, row[at], "left"), np.searchsorted(values, row[at], "right")
                for k in np.flatnonzero(high > low):
                    items.append(owners[low[k] : high[k]])
                    columns.append(np.full(high[k] - low[k], at[k]))
        none = np.empty(0, np.int64)
        return np.concatenate(columns or [none]), np.concatenate(items or [none])


def _starts(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of ``step`` start in runs of these lengths that follow each other, and the blocks of each run."""
    blocks = -(-counts // step)
    first = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    return np.repeat(np.cumsum(counts) - counts, blocks) + within * step, blocks


@dataclass
class Index:
    partitions: list[Partition]
    exact: list[np.ndarray]  # distinct shingles of each item
    ids: list

    def _candidates(self, hashes: list[np.ndarray], width: int) -> set[tuple[int, int]]:
        """(text, item) pairs that collide. Blocks of a partition are pairs of those of the next smaller one."""
        found: set[tuple[int, int]] = set()
        parts = {p.size: p for p in self.partitions if p.width == width}
        runs = [k for k, h in enumerate(hashes) if len(h)]
        if not parts or not runs:
            return found
        owner, flat = np.array(runs), np.concatenate([hashes[k] for k in runs])
        size = min(parts)
        starts, blocks = _starts(np.array([len(hashes[k]) for k in runs]), size)
        values = minima(flat, starts)
        while True:
            if size in parts:
                text = np.repeat(owner, blocks)
                if size > 1:  # a window is a block and the next of its text
                    values_, alone = np.minimum(values[:, :-1], values[:, 1:]), np.repeat(blocks == 1, blocks)
                    inner = text[:-1] == text[1:]
                    signatures = np.concatenate([values_[:, inner], values[:, alone]], axis=1)
                    text = np.r_[text[:-1][inner], text[alone]]
                else:
                    signatures = values
                columns, items = parts[size].collide(signatures)
                found.update(zip(text[columns].tolist(), items.tolist()))
            if size >= max(parts):
                return found
            pairs, after = _starts(blocks, 2)
            values, blocks, size = np.minimum.reduceat(values, pairs, axis=1), after, 2 * size

    def search(self, texts: list[list[bytes]], least: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, matched shingles, item shingles) of the items contained in a text to a share of ``least`` or more."""
        for width in sorted({p.width for p in self.partitions}):
            hashes = [shingles(words, width) for words in texts]
            own, last = None, -1
            for text, item in sorted(self._candidates(hashes, width)):
                if text != last:
                    own, last = np.unique(hashes[text]), text
                want = self.exact[item]
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                hits = int(np.count_nonzero(own[at] == want))
                if hits >= least * len(want):
                    yield text, item, hits, len(want)


def build_index(rows: list[tuple]) -> Index:
    """Index of (item id, text) rows; items without words can be in no document and are left out."""
    index, groups = Index([], [], []), {}
    for item, text in rows:
        words = tokens((text or "").encode())
        if not words:
            continue
        width = min(WIDTH, len(words))
        own = np.unique(shingles(words, width))
        size = 1 << int(len(own) - 1).bit_length()
        groups.setdefault((width, size), []).append(len(index.ids))
        index.ids.append(item)
        index.exact.append(own)
    for (width, size), items in sorted(groups.items()):
        part = Partition(width, size)
        part.index(np.concatenate([minima(index.exact[i], np.zeros(1, np.int64)) for i in items], axis=1), np.array(items))
        index.partitions.append(part)
    return index


def _portions(raws: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of consecutive texts, PORTION bytes or one text at a time, and the number of the first."""
    held, first, size = [], 0, 0
    for n, raw in enumerate(raws):
        if held and size + len(raw) > PORTION:
            yield first, held
            held, first, size = [], n, 0
        held.append(tokens(raw))
        size += len(raw)
    if held:
        yield first, held


def _search(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            owner, item, hits, sizes = [], [], [], []
            for first, texts in _portions(raw_texts(batch.column(1))):
                for text, found, matched, size in index.search(texts, least):
                    owner.append(first + text)
                    item.append(index.ids[found])
                    hits.append(matched)
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(item, pa.int64()), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "item_id", "matched", "shingles"])

    return run


def _blocks(benchmark: DataFrame, size: int, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded items and bytes (or one item), streamed through the driver."""
    held, held_bytes = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        length = len((row["text"] or "").encode())
        if held and (len(held) == size or held_bytes + length > most_bytes):
            yield held
            held, held_bytes = [], 0
        held.append((row["item_id"], row["text"]))
        held_bytes += length
    if held:
        yield held


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, matched, shingles.

    Words are split at ASCII white space and A-Z lower-cased; an item is
    contained if at least ``least`` of its distinct shingles are in the document.
    Null and empty texts contain nothing and are contained nowhere. Rows that
    repeat a doc_id or item_id give rows of their own. Extra columns are not
    carried; empty tables give an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, matched long, shingles long"
    parts = []
    for rows in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(rows))
        parts.append(docs.select("doc_id", "text").mapInArrow(_search(shared, least), schema))
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _clean(shared, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, texts in _portions(raw_texts(batch.column(at))):
                keep[[first + text for text, *_ in shared.value.search(texts, least)]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the documents that contain an item; the columns stay as they are."""
    for rows in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(rows))
        docs = docs.mapInArrow(_clean(shared, least, docs.columns.index("text")), docs.schema)
    return docs
