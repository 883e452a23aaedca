import numpy as np
import xxhash
from pyspark.sql import types as T

from tributary.llm import simhash
from tributary.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, extra int"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                part[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)


def test_random_texts_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(30):
        words = [f"w{x}" for x in rng.integers(0, 300, 400)]
        for copy in range(4):
            changed = list(words)
            for at in rng.integers(0, 400, copy * 3):
                changed[at] = f"z{rng.integers(0, 99)}"
            rows.append((base * 10 + copy, " ".join(changed)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (None, "one two"), (None, "lonely row here indeed yes"), (905, "é É x y z")]
    rows += [rows[0], rows[0]]
    assert run(spark, rows) == brute(rows)


def test_anchor_covering_loses_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        for bit in rng.choice(64, 4, replace=False):
            y ^= 1 << int(bit)
        keys, owners = simhash.anchors(np.array([x, y], np.uint64))
        assert set(keys[owners == 0]) & set(keys[owners == 1])


def test_large_runs_link_as_small_ones(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 9), dtype=np.uint64)
    values = np.unique(np.concatenate([base[:, None] ^ flips, base[:, None]], axis=1))
    def parts(pair):
        label = {int(v): int(v) for v in values}
        for _ in range(len(values)):
            for a, b in zip(*pair):
                low = min(label[int(a)], label[int(b)])
                label[int(a)] = label[int(b)] = low
        return label
    keys = np.zeros(len(values), np.int64)
    whole = parts(simhash.links_of_run(keys, values, 4))
    monkeypatch.setattr(simhash, "LARGE_RUN", 20)
    assert parts(simhash.links_of_run(keys, values, 4)) == whole


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_drop_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e", "k", 1), (3, "a b c d e", "k", 2), (3, "a b c d e", "k", 2), (9, None, None, 3), (8, "", "q", 4), (1, "quite another text here", "z", 5)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.schema == T.StructType(spark.createDataFrame([], SCHEMA).schema.fields)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]
