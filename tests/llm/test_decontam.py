import random

import numpy as np

from tributary.llm import decontam


def plain(docs, items, least=0.8):
    def parts(text, width):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    out = []
    for item, text in items:
        n = len((text or "").encode().split())
        if n:
            want = parts(text, min(5, n))
            for doc, body in docs:
                hits = len(want & parts(body, min(5, n)))
                if hits and hits >= least * len(want):
                    out.append((doc, item, hits, len(want)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.choice([5, 6, 9, 12, 30, 59, 64, 65, 200]))) for i in range(60)]
    items += [(100, "One"), (101, "two WORDS"), (102, "a b c d"), (103, ""), (104, None), (105, "x " * 50), (5, items[5][1]), (None, items[6][1])]
    docs = []
    for i in range(80):
        own = text(rng.choice([3, 40, 3000])).split()
        for _, item in rng.choices(items[:60], k=rng.randint(0, 2)):
            piece = item.split()
            if rng.random() < 0.5:  # a changed word costs up to five shingles
                piece[rng.randrange(len(piece))] = "CHANGED"
            at = rng.randint(0, len(own))
            own[at:at] = piece
        docs.append((i, (" \t" if i % 2 else "\n").join(own).upper()))
    docs += [(200, None), (201, ""), (202, "one"), (203, "z two\twords z"), (204, "A B  C\nD"), (205, "x " * 5), (7, docs[7][1]), (None, docs[8][1])]
    return docs, items


def test_against_plain_containment(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, "t") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    assert len(want) > 40
    assert sorted((tuple(r) for r in decontam.contained_items(d, b).collect()), key=repr) == want
    assert sorted((tuple(r) for r in decontam.contained_items(d, b, block=7).collect()), key=repr) == want
    dirty = {repr((docs[i][0], docs[i][1])) for i in range(len(docs)) if plain([docs[i]], items)}
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(x) for x in docs if repr(x) not in dirty)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(d, b).count() == 0 and decontam.drop_contaminated(d, b).count() == 1
    assert decontam.contained_items(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_band_settings():
    least = 0.8 / 4.2
    assert 1 - (1 - least) ** decontam.HASHES > 0.999998
    assert len(set(decontam._MULTIPLIERS.tolist())) == decontam.HASHES and np.all(decontam._MULTIPLIERS % 2 == 1)


def test_blocks_are_bounded_in_bytes(spark):
    rows = [(i, "x" * n) for i, n in enumerate([10, 10, 50, 5, 5, 5, 5])] + [(9, None)]
    found = [[x[0] for x in part] for part in decontam._blocks(spark.createDataFrame(rows, "item_id long, text string").coalesce(1), 3, 30)]
    assert found == [[0, 1], [2], [3, 4, 5], [6, 9]]


def test_a_very_long_text_with_a_hit(spark):
    words = [f"w{i % 977}x{i}" for i in range(80_000)]
    items = [(1, " ".join(words[40_000:40_030])), (2, " ".join(words[79_990:])), (3, " ".join(words[5:300:2]))]
    docs = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    found = decontam.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id, r.matched) for r in found) == [(1, 26), (2, 6)]
