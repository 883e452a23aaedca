import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import ctw


def plain_tree(texts, depth):
    """Straight from the definition: dictionaries of counts, and the recursion."""
    counts = defaultdict(lambda: [0, 0])
    for words in texts:
        data = ctw.framed(words, depth)
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[data[i - d : i], data[i] | 256 if bit == 8 else (data[i] >> (8 - bit)) | 1 << bit][data[i] >> (7 - bit) & 1] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append(context)
    weighted = {}
    for context, node in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(counts[context, node])
        if len(context) < depth:
            below = sum(weighted[c, node] for c in children[context, node])
            own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
        weighted[context, node] = own

    def probability(context, symbol):
        out = 1.0
        for bit in range(8):
            node, way = symbol >> (8 - bit) | 1 << bit, symbol >> (7 - bit) & 1
            seen = [d for d in range(depth + 1) if (context[depth - d :], node) in counts]
            q = 0.5
            for d in reversed(seen):
                n = counts[context[depth - d :], node]
                own = (n[way] + 0.5) / (sum(n) + 1)
                if d == seen[-1]:
                    q = own
                else:
                    stop = math.exp(math.log(0.5) + kt(n) - weighted[context[depth - d :], node])
                    q = stop * own + (1 - stop) * q
            out *= q
        return out

    return probability


def texts(rng, n):
    return [[w.encode() for w in rng.choices(["the", "then", "thorn", "é", "a", "of", "often"], k=rng.randint(0, 12))] for _ in range(n)]


def levels_of(train, depth):
    codes = ctw.gram_codes(b"".join(ctw.framed(w, depth) for w in train), depth)[0]
    out = []
    for d in range(depth + 1):
        key, n = np.unique(codes & ctw._mask(8 * (d + 1)), return_counts=True)
        out.append((key, n.astype(np.int64)))
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_tree_against_the_definition(depth):
    rng = random.Random(depth)
    train = texts(rng, 25)
    tree, plain = ctw.build_tree(levels_of(train, depth)), plain_tree(train, depth)
    for words in texts(rng, 5) + [[b"xylophone", b"the"], []]:
        data = ctw.framed(words, depth)
        codes, places = ctw.gram_codes(data, depth)
        assert places.tolist() == list(range(depth, len(data)))
        want = [math.log2(plain(data[i - depth : i], data[i])) for i in range(depth, len(data))]
        assert np.allclose(tree.log2(codes), want, atol=1e-4)


def test_probabilities_sum_to_one():
    depth, rng = 3, random.Random(2)
    tree = ctw.build_tree(levels_of(texts(rng, 30), depth))
    for context in (b"the", b"zzz", b"n \xc3", bytes([ctw.PAD]) * 3):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs(np.exp2(tree.log2(codes).astype(float)).sum() - 1) < 1e-4


def fixture(n=140):
    rng = random.Random(4)
    words = ["The", "of", "and", "re", "tion", "ÉTÉ", "été", "x1"] + [f"rare{i}" for i in range(200)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (7, rows[7][1]), (None, "the of nothing")]


def test_scores_against_a_plain_model(spark):
    rows = fixture()
    df = spark.createDataFrame([(a, b, 0.5, 3) for a, b in rows], "doc_id long, text string, score double, n int")
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    train = [split(t) for d, t in rows if not fold(d)]
    counts = Counter(w for t in train for w in t)
    counts[None] = len(train)
    total, size = sum(counts.values()), len(counts)
    plain = plain_tree(train, 2)

    def want(d, t):
        own = [*split(t), None]
        data = ctw.framed(own[:-1], 2)
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in own)
        score = sum(math.log10(plain(data[i - 2 : i], data[i])) for i in range(2, len(data)))
        return (str(d), fold(d), len(own), sum(counts[w] > 0 for w in own), total), (base, score, -score / math.log10(2) / (len(data) - 2))

    for top in (3, 1000):
        found = sorted((((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens), (r.base_score, r.score, r.bits_per_byte)) for r in ctw.score_texts(df, depth=2, top_words=top).collect()))
        expected = sorted(want(d, t) for d, t in rows)
        assert [a for a, _ in found] == [a for a, _ in expected]
        assert np.allclose([b for _, b in found], [b for _, b in expected], rtol=1e-4, atol=1e-6)


def test_a_pruned_tree_still_scores(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string")
    whole = {(r.doc_id, r.n_tokens): r for r in ctw.score_texts(df, depth=3).collect()}
    pruned = {(r.doc_id, r.n_tokens): r for r in ctw.score_texts(df, depth=3, most=300).collect()}
    assert whole.keys() == pruned.keys()
    assert all(math.isfinite(r.score) and r.score < 0 for r in pruned.values())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score_texts(df, depth=2).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ctw.score_texts(spark.createDataFrame([(held, "ab")], "doc_id long, text string"), depth=2).first()
    assert row.held_out and row.n_tokens == 2 and row.n_known == 0 and abs(row.score - 3 * 8 * math.log10(0.5)) < 1e-4


def test_blocks_give_the_scores_of_the_whole_tree(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string")
    for depth, most in ((1, 60), (3, 300)):
        counts = ctw.count_corpus(df.where(~ctw.held_out(df.doc_id)), depth)
        assert len(list(ctw.trees_of(counts, depth, most))) > 2
        read = lambda most: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in ctw.score_texts(df, depth=depth, most=most).collect())  # noqa: B023, E731
        whole, parts = read(ctw.MOST_GRAMS), read(most)
        assert [r[:3] for r in whole] == [r[:3] for r in parts]
        assert np.allclose([r[3:] for r in whole], [r[3:] for r in parts], rtol=1e-5)


def long_text(n):
    return [bytes(w) for w in np.random.default_rng(1).integers(97, 105, (n, 5), np.uint8)]


def test_a_worker_holds_each_code_once_and_scores_in_small_pieces():
    words = long_text(350_000)
    tree = ctw.build_tree(levels_of([words[:100_000]], 5))
    assert len(pickle.dumps(tree, 5)) < 60 * len(tree.grams[5])
    frames = [ctw.framed(words[i : i + 500], 5) for i in range(0, len(words), 500)]
    tracemalloc.start()
    found = ctw._frame_scores(ctw.Block(tree), frames)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, frames))
    for i in (0, 300, 699):
        bits = tree.log2(ctw.gram_codes(frames[i], 5)[0]).astype(float)
        assert math.isclose(found[i], bits.sum() * math.log10(2), rel_tol=1e-9)
    assert math.isclose(ctw._frame_scores(ctw.Block(tree), [ctw.framed(words, 5)])[0], sum(found), rel_tol=0.01)  # one text of several pieces


def test_counts_that_end_with_a_full_buffer(monkeypatch):
    monkeypatch.setattr(ctw, "PENDING_GRAMS", 5)
    rows = [r for batch in ctw._count(2)(iter([pa.record_batch([pa.array(["abcdefghij abc"])], names=["text"])])) for r in batch.to_pylist()]
    codes = ctw.gram_codes(ctw.framed([b"abcdefghij", b"abc"], 2), 2)[0]
    assert Counter({r["key"]: r["n"] for r in rows if r["kind"] == ctw.GRAM}) == Counter(codes.tolist())
    assert sum(r["n"] for r in rows if r["kind"] == ctw.WORD) == 2


def test_counts_are_not_added_up_twice_before_the_shuffle(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string")
    plan = ctw._counted(df, 2)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan[plan.index("Exchange") :] and "Exchange" not in plan[: plan.index("Exchange")]
