"""SimHash near-duplicate groups by anchor-point covering.

A fingerprint is the bitwise majority over the XXH64 values of a text's
shingles. Two fingerprints are linked if at most ``threshold`` bits differ.

Candidates meet at anchors. The 64 bits hold two segments of 31 bits; a pair
that differs in at most 4 bits differs in at most 2 on one of them. On a
segment the anchors are the codewords of the [31, 26] Hamming code, whose
covering radius R is 1: any 31-bit word lies within 1 of a codeword. A pair at
distance 2 has a word in the middle, at distance 1 from both, and the anchor
that covers the middle is within R + 1 = 2 of both ends. So replicating each
fingerprint to all anchors within R + ceil(threshold / 2) lets every such pair
meet. That is 1 or 16 anchors a segment; the same argument with the full
threshold on one side would need up to 156. There are 2**26 anchors a segment, so
the replicas, at most 32 for a distinct fingerprint, grow linearly.

Equal fingerprints are merged first, so a group of exact copies is one row.
Per anchor, replicas are compared with XOR and a bit count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, raw_texts, tokens
from .components import connected_components

SEED, WIDTH, THRESHOLD = 42, 4, 4
SEGMENT_BITS = 31
SEGMENT_SHIFTS = (0, 31)
#: A run of one anchor above this is cut further by exact blocks of bits.
LARGE_RUN = 1024

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles, repeats included; fewer words give one shingle, none give none."""
    words = tokens(raw)
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """Bits set in over half the shingle hashes; zero for a text without words."""
    hashes = shingle_hashes(raw, width)
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint as a signed 64-bit column ``name``; ``keep`` names the columns to carry (all by default)."""
    keep = docs.columns if keep is None else keep
    carried = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x) for x in raw_texts(batch.column(batch.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.int64())], names=[*batch.schema.names[:-1], name])

    return carried.mapInArrow(run, schema)


def _masks() -> list[np.ndarray]:
    """For each syndrome, the XOR masks that lead to all codewords within distance 2."""
    single = {s: np.uint64(1 << (s - 1)) for s in range(1, SEGMENT_BITS + 1)}  # column s of the parity check is s itself
    out = [np.array([0], np.uint64)]
    for s in range(1, SEGMENT_BITS + 1):
        pairs = [single[a] | single[a ^ s] for a in single if a < (a ^ s) and (a ^ s) in single]
        out.append(np.array([single[s], *pairs], np.uint64))
    return out


_MASKS = _masks()
_CHECKS = [np.uint64(sum(1 << (s - 1) for s in range(1, SEGMENT_BITS + 1) if s >> k & 1)) for k in range(5)]


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys and the indices of the uint64 ``values`` that are replicated to them."""
    keys, owners = [], []
    for n, shift in enumerate(SEGMENT_SHIFTS):
        part = values >> np.uint64(shift) & np.uint64((1 << SEGMENT_BITS) - 1)
        syndrome = np.zeros(len(part), np.int64)
        for k, check in enumerate(_CHECKS):
            syndrome |= (np.bitwise_count(part & check) & 1).astype(np.int64) << k
        for s in np.unique(syndrome):
            at = np.flatnonzero(syndrome == s)
            found = part[at][:, None] ^ _MASKS[s][None, :] | np.uint64(n << SEGMENT_BITS)
            keys.append(found.ravel())
            owners.append(np.repeat(at, found.shape[1]))
    return np.concatenate(keys), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if len(values):
            keys, owners = anchors(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values[owners].view(np.int64))], names=["anchor", "fp"])


def _links_within(values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between distinct values of one anchor."""
    n = len(values)
    label = np.arange(n)
    left, right = [], []

    def compare(index: np.ndarray) -> None:
        for at in range(0, len(index), 512):
            rows = index[at : at + 512]
            near = np.bitwise_count(values[rows][:, None] ^ values[index[at:]][None, :]) <= threshold
            a, b = np.nonzero(near)
            a, b = rows[a], index[at:][b]
            left.append(a[a != b])
            right.append(b[a != b])

    if n <= LARGE_RUN:
        compare(label)
    else:  # threshold + 1 blocks of bits: a linked pair agrees on one of them
        cuts = np.linspace(0, 64, threshold + 2).astype(int)
        for low, high in zip(cuts, cuts[1:]):
            block = values >> np.uint64(low) & np.uint64((1 << int(high - low)) - 1)
            order = np.argsort(block, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(run) > 1:
                    compare(run)
    a, b = np.concatenate(left or [label[:0]]), np.concatenate(right or [label[:0]])
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(low, label[a]) and np.array_equal(low, label[b]):
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def links_of_run(keys: np.ndarray, values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked value pairs among rows that are sorted by ``keys``; whole runs only."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    small = np.repeat(sizes <= 16, sizes)
    k, v = keys[small], values[small]
    for step in range(1, 16):
        if len(k) <= step:
            break
        hit = (k[step:] == k[:-step]) & (np.bitwise_count(v[step:] ^ v[:-step]) <= threshold)
        left.append(v[:-step][hit])
        right.append(v[step:][hit])
    for at, size in zip(starts[sizes > 16], sizes[sizes > 16]):
        run = values[at : at + size]
        a, b = _links_within(run, threshold)
        left.append(run[a])
        right.append(run[b])
    none = values[:0]
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = links_of_run(keys, values, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        kept_keys, kept_values = [], []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if cut:
                yield linked(np.concatenate([*kept_keys, keys[:cut]]), np.concatenate([*kept_values, values[:cut]]))
                kept_keys, kept_values = [], []
            elif kept_keys and kept_keys[-1][-1] != keys[0]:
                yield linked(np.concatenate(kept_keys), np.concatenate(kept_values))
                kept_keys, kept_values = [], []
            kept_keys.append(keys[cut:])
            kept_values.append(values[cut:])
        if kept_keys:
            yield linked(np.concatenate(kept_keys), np.concatenate(kept_values))

    return run


def links(fingerprints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp), enough of them to connect all that are linked."""
    if threshold > 5:
        raise ValueError("two segments with one midpoint step cover at most 5 differing bits")
    replicas = fingerprints.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    met = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_compare(threshold), "u long, v long")


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, component_id, component) for every distinct fingerprint of ``docs`` (columns doc_id, fp).

    component_id is the smallest doc_id reachable through links, itself
    included; null only if no doc_id there is known.
    """
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(links(distinct, threshold)).withColumnRenamed("node", "fp")
    placed = materialize(distinct.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialize(placed.join(least, "component").select("fp", "component_id", "component"), "groups")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null text counts as empty and has fingerprint zero, like a text without
    words; such documents are linked to each other like any others. Rows that
    share a doc_id are each kept. A null doc_id never names a component unless
    no other is there. Extra columns are not carried. An empty table gives an
    empty table.
    """
    marked = materialize(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    found = groups(marked, threshold)
    return marked.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row left of each group: that of the smallest doc_id (of rows that repeat it, the first stored).

    Rows are numbered as they are stored with their fingerprints, so what
    decides is narrow and the texts are shuffled once.
    """
    columns = docs.columns
    fp, row = fresh(columns, "fingerprint"), fresh(columns, "row_no")
    marked = materialize(with_fingerprint(docs, name=fp).withColumn(row, F.monotonically_increasing_id()), "marked")
    narrow = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    placed = narrow.join(groups(narrow, threshold), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers = materialize(placed.groupBy("component").agg(F.min("row").alias(row)).select(row), "keepers")
    return marked.join(keepers, row, "left_semi").select(*(F.col(f"`{c}`") for c in columns))
