import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm import packing
from tributary.llm.common import tokenizer_path


def check_plan(counts, plan):
    used = {}
    for length in np.flatnonzero(counts):
        places = plan.place(np.full(counts[length], length), np.arange(counts[length]))
        for sequence, offset in zip(*(x.tolist() for x in places)):
            used.setdefault(sequence, []).append((offset, int(length)))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at < len(counts)
    return len(used)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 30), st.sampled_from([2, 2.5, 6]))
def test_any_plan_is_gapless_and_places_all(lengths, groups, small):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    check_plan(counts, packing.grouped_plan(counts, groups, small))


def test_plan_is_close_to_the_volume_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.4, 1.1, 20000).astype(int) + 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    volume = int(np.arange(2049) @ counts) / 2048
    full = int(counts[1025:].sum())  # no two of them share a sequence
    assert check_plan(counts, packing.grouped_plan(counts)) <= 1.002 * max(volume, full) + 2


TEXTS = [
    None, "", " \n\t", "Hello, WORLD!! it's don't 'S x's.", "<|endoftext|> a<|ENDOFTEXT|>b", "über Éa naïve ﬁn İstanbul ΣΑΣ. ß", "12,345.67% a1b2 ...!?", "é ̈x a b c \x1cq\x85r \x0b\x0c",
    "日本語テキスト。中文 한국어", "\x00 \x07bell � 😀😀 👩‍👩‍👧", "word " * 3000, "Thing. " * 1500 + "end", "a.b.c., ;; x:) (y)", "<|startoftext|> I İ ı K ſ ǅ ꟲ ª º ²x ½ Ⅷ ⅷ é ö", "Été. ÉTÉ, ΣΑΣ. ας» dé», é.. é́. x́, é. Ω!! ﬀ. İ. 𐐀x.", "n't we're THEY'LL 'dx x's't ''s",
]


def test_ids_and_places(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    rows = [(i, t, "e", 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "e", 5), (None, "no id", "e", 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string, length int"), with_ids=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, list(r.ids))) for r in out)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_forgetful_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 2)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 4)
    path = tokenizer_path(packing.VOCABULARY)
    tokenizer, ids = Tokenizer.from_file(path), packing.WordIds(path)
    for text in [t for t in TEXTS if t] * 2:
        found, bounds = ids.batch(pa.array([text, None, text]))
        want = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert found.tolist() == [*want, 0, *want] and bounds.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def test_parts_of_any_size_give_the_same_ids(monkeypatch):
    path = tokenizer_path(packing.VOCABULARY)
    tokenizer, ids = Tokenizer.from_file(path), packing.WordIds(path)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in TEXTS]
    for most in (1, 7, 4000):
        monkeypatch.setattr(packing, "PART_CHUNKS", most)
        got = [(first + n, found[low:high].tolist()) for first, found, bounds in ids.parts(pa.array(TEXTS)) for n, (low, high) in enumerate(zip(bounds, bounds[1:]))]
        assert got == list(enumerate(want))
        assert ids.batch(pa.array(TEXTS))[0].tolist() == sum(want, [])
    assert ids.batch(pa.array([], pa.string()))[1].tolist() == [0]


def test_a_full_portion_takes_little_more_space_than_its_text():
    words = ["lorem", "ipsum", "dolor", "sit", "amet,", "a1"]
    text = " ".join(words[i * i % 11 % 6] for i in range(1300))
    texts = pa.array([text] * (packing.BATCH_TEXT // len(text)))
    cut = packing._cut(tokenizer_path(packing.VOCABULARY), 2048, False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["doc_id", "text"])
    list(cut(iter([batch.slice(0, 1)])))  # the tokenizer is there
    tracemalloc.start()
    rows = sum(out.num_rows for out in cut(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= len(texts) and peak < 4 * packing.BATCH_TEXT


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(1, "a b")][:n], "doc_id long, text string")
    assert packing.pack(df).count() == n


def test_buckets_grow_with_the_pieces(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS piece", "cast(5 + id % 2 AS long) AS length", "id * 7 AS ids_crc32")
    monkeypatch.setattr(packing, "BUCKETS", 2)
    monkeypatch.setattr(packing, "BUCKET_PIECES", 10)
    ranks = {}
    for r in packing._ranked(rows, 300).collect():
        ranks.setdefault(r.length, []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {5: list(range(150)), 6: list(range(150))}
