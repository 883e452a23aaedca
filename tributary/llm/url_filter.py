"""URL verdicts from host and path rules, and a Bloom filter cascade for listed hosts.

The cascade answers exactly whether a key of a known universe is listed,
without a join. Level 1 holds the listed keys; level 2 the keys that are not
listed but pass level 1; level 3 the listed keys that pass level 2; and so on
until nothing passes by mistake. A key's answer is the parity of the first
level that it misses.

Keys are split by hash into shards, each with a cascade of its own. A block of
shards is built and probed at a time, and only as many as fit ``block_bytes``
are ever sent to the executors, whatever the list's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits for a key at level 1 and at the deeper levels; probes for a key.
FIRST_BITS, NEXT_BITS, PROBES = 10, 6, 4
BLOCK_BYTES = 64 << 20
WORD = 63  # bits of a bitmap word: the sign bit stays free

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host + path as text, else null) and its verdict.

    A rule fits its host and all subdomains if the path starts with the
    rule's. The longest is that of the longest host, then of the longest path.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):  # later ones win
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _positions(hashes: np.ndarray, level: int, bits: np.ndarray | int) -> list[np.ndarray]:
    """Bit positions of each key at a level, by double hashing of one 64-bit hash."""
    mixed = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    a, b = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    return [(a + np.uint64(i) * b) % bits for i in range(PROBES)]


def key_hashes(keys: list[str | None], bits: int = 64, seed: int = 7) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k or "", seed) for k in keys), np.uint64, len(keys)) & np.uint64((1 << bits) - 1)


@dataclass
class Cascade:
    """Levels of bitmaps for the shards of one block; level n of shard s holds ``bits[n][s]`` bits from ``starts[n][s]``."""

    shards: int
    first: int
    bits: list[np.ndarray]
    starts: list[np.ndarray]
    words: list[np.ndarray]
    #: Hashes that a listed and an unlisted key share, and second hashes of the listed ones: told apart by an exact table.
    shared: frozenset = frozenset()
    exact: frozenset = frozenset()

    def places(self, hashes: np.ndarray, level: int) -> list[np.ndarray]:
        shard = ((hashes >> np.uint64(40)) % np.uint64(self.shards)).astype(np.int64) - self.first
        base = self.starts[level][shard]
        return [base + p for p in _positions(hashes, level, self.bits[level][shard])]

    def passes(self, hashes: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes, level):
            word, bit = place // np.uint64(WORD), place % np.uint64(WORD)
            out &= (self.words[level][word.astype(np.int64)] >> bit & np.uint64(1)).astype(bool)
        return out

    def answer(self, keys: list[str | None], hashes: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe."""
        out = self.listed(hashes)
        if self.shared:
            for n in np.flatnonzero([h in self.shared for h in hashes.tolist()]):
                out[n] = (int(hashes[n]), int(key_hashes([keys[n]], seed=8)[0])) in self.exact
        return out

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """The first level that a key misses tells."""
        out = np.zeros(len(hashes), bool)
        going = np.arange(len(hashes))
        for level in range(len(self.bits)):
            passed = self.passes(hashes[going], level)
            out[going[~passed]] = level % 2 == 1
            going = going[passed]
        out[going] = len(self.bits) % 2 == 1
        return out


def _bit_words(cascade: Cascade, level: int):
    """Keys that belong to a level, as (word, bits) of its bitmap, merged within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            places = np.concatenate(cascade.places(hashes, level))
            word = (places // np.uint64(WORD)).astype(np.int64)
            bits = np.left_shift(np.uint64(1), places % np.uint64(WORD))
            if not len(word):
                continue
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0])
            yield pa.RecordBatch.from_arrays([pa.array(word[order][starts]), pa.array(np.bitwise_or.reduceat(bits[order], starts).view(np.int64))], names=["word", "bits"])

    return run


def _surviving(cascade: Cascade, level: int):
    """Hashes that pass a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[cascade.passes(hashes, level)].view(np.int64))], names=["h"])

    return run


def build_block(listed: DataFrame, other: DataFrame, shards: int, first: int, last: int, most_levels: int = 64) -> Cascade:
    """Cascade for shards first..last-1 over hashed keys (column h, with its shard) that are listed or not."""
    inside = F.col("shard").between(first, last - 1)
    sides = [listed.where(inside).select("h", "shard"), other.where(inside).select("h", "shard")]
    cascade = Cascade(shards, first, [], [], [])
    for level in range(most_levels):
        own = sides[level % 2]
        counts = {r["shard"]: r["n"] for r in own.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
        if not counts:
            return cascade
        per_key = FIRST_BITS if level == 0 else NEXT_BITS
        bits = np.array([max(64, counts.get(s, 0) * per_key) for s in range(first, last)], np.uint64)
        ends = np.cumsum(bits)
        cascade.bits.append(bits)
        cascade.starts.append(ends - bits)
        words = np.zeros(int(ends[-1]) // WORD + 1, np.uint64)
        found = own.select("h").mapInArrow(_bit_words(cascade, level), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        cascade.words.append(words)
        passed = sides[(level + 1) % 2].select("h").mapInArrow(_surviving(cascade, level), "h long")
        sides[(level + 1) % 2] = materialize(passed.withColumn("shard", _shard(F.col("h"), shards)), "passed")
    raise RuntimeError("the cascade did not settle: the same hash is listed and not listed")


def _shard(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(shards)).cast("int")


def _hash_keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            hashes = [pa.array(x.view(np.int64)) for x in (key_hashes(keys, bits), key_hashes(keys, seed=8))]
            yield pa.RecordBatch.from_arrays([*hashes, *batch.columns[1:]], names=["h", "second", *batch.schema.names[1:]])

    return run


def membership(keys: DataFrame, listed: Column, block_bytes: int = BLOCK_BYTES, bits: int = 64) -> tuple[list[Cascade], int]:
    """Cascades, one a block of shards, over the universe ``keys`` (distinct, column key) of which ``listed`` says which are listed.

    A column expression marks the list here; a list in a table is marked by a
    semi-join while the filter is built, never while it is probed. The few hashes that
    listed and other keys share (a pair among 2^32 keys) are told apart by second hashes.
    """
    hashed = keys.select("key", F.coalesce(listed, F.lit(False)).alias("listed")).mapInArrow(_hash_keys(bits), "h long, second long, listed boolean")
    universe = materialize(hashed, "keys")
    shared = materialize(universe.groupBy("h").agg(F.min("listed").alias("all"), F.max("listed").alias("any")).where("all <> any").select("h"), "shared-hashes")
    apart = [(r["h"] % (1 << 64), r["second"] % (1 << 64), r["listed"]) for r in universe.join(F.broadcast(shared), "h").collect()]  # pairs that share 64 bits
    if apart:
        universe = materialize(universe.join(F.broadcast(shared), "h", "left_anti"), "keys")
    count = universe.where("listed").count()
    need = count * FIRST_BITS // 8 * 2 + 4096  # deeper levels hold less than as much again
    blocks = max(1, -(-need // block_bytes))
    shards = blocks * 16
    universe = universe.withColumn("shard", _shard(F.col("h"), shards))
    sides = universe.where("listed"), universe.where("NOT coalesce(listed, false)")
    cascades = [build_block(*sides, shards, b * 16, b * 16 + 16) for b in range(blocks)]
    for cascade in cascades:
        cascade.shared, cascade.exact = frozenset(h for h, _, _ in apart), frozenset((h, second) for h, second, is_listed in apart if is_listed)
    return cascades, shards


def probe(rows: DataFrame, key: str, cascades: list[Cascade], shards: int, name: str = "listed", bits: int = 64) -> DataFrame:
    """Add boolean ``name``: whether the row's key is listed. One pass a block; a pass leaves the keys of other blocks alone."""
    for at, cascade in enumerate(cascades):
        first, last = cascade.first, cascade.first + 16

        @F.pandas_udf("boolean")
        def answer(values, before, c=None):
            keys = values.tolist()
            hashes = key_hashes(keys, bits)
            shard = ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            mine = (shard >= first) & (shard < last)
            out = before.to_numpy(bool, copy=True)
            out[mine] = shared.value.answer([k for k, m in zip(keys, mine) if m], hashes[mine])
            import pandas as pd

            return pd.Series(out)

        shared = rows.sparkSession.sparkContext.broadcast(cascade)
        rows = rows.withColumn(name, answer(F.col(key), F.col(name) if at else F.lit(False)))
    return rows


def stand_in_list(host: Column) -> Column:
    """Listed hosts of the registered query, in place of an external block list: those whose MD5 starts with 0 to 3."""
    return (host != "") & F.substring(F.md5(host.cast("binary")), 1, 1).isin("0", "1", "2", "3")


def judge(pages: DataFrame, rules: tuple = RULES, listed=stand_in_list) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The longest rule decides; where none fits, a host of the block list is
    blocked and any other allowed. Null urls and urls without ``://`` have an
    empty host and path, fit no rule and are not listed, so they are allowed.
    Repeated rows are each judged; extra columns are not carried; an empty
    table gives an empty table.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    cascades, shards = membership(hosts, listed(F.col("key")))
    marked = probe(rows, "host", cascades, shards)
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
