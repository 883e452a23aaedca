import random
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import toxicity as tx


def distance(a, b):
    """Edits with swaps of neighbours (each letter edited once)."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


ENTRIES = [tx.Entry("moron", "word"), tx.Entry("scum", "word"), tx.Entry("loweis", "stem"), tx.Entry("disgusting", "word"), tx.Entry("morons", "word"), tx.Entry("vejuaivejuai", "stem"), tx.Entry("lowe", "stem")]


def plain(word):
    out = {}
    for n, e in enumerate(ENTRIES):
        found = min((distance(word[:k], e.text) for k in range(len(word) + 1))) if e.kind == "stem" else distance(word, e.text)
        if found <= e.edits:
            out[n] = found
    return tuple(sorted(out.items()))


AUTOMATON = tx.Automaton(ENTRIES)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([e.text for e in ENTRIES]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("dist"), st.sampled_from("aeimnorsvz")), max_size=3), st.text("aeo", max_size=3))
def test_automaton_is_the_edit_distance(word, edits, tail):
    for at, kind, c in edits:
        at = min(at, max(0, len(word) - 1))
        word = {"d": word[:at] + word[at + 1 :], "i": word[:at] + c + word[at:], "s": word[:at] + c + word[at + 1 :], "t": word[:at] + word[at : at + 2][::-1] + word[at + 2 :]}[kind]
    assert AUTOMATON.match(word + tail) == plain(word + tail)


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.choice([5, 60, 300]))
        toxic = i % 6 == 0
        if toxic:
            text.insert(rng.randint(0, len(text)), rng.choice(["moron", "Moron!", "trash", "scumbag", "scumlike", "scumish"]))
        docs.append((i, " ".join(text)))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "a mroon here"), (5003, "some traash there"), (5004, "he said \"moron\" and quoted it"), (5005, "scumxyz"), (5000, None), (None, "moron")]
    return docs, labels


def test_learns_scores_and_holds_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(a, b, "q") for a, b in docs], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([(a, 1, b) for a, b in labels] + [(None, 1, 1), (3, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = tx.fit(d, lab)
    assert {e.text for e in model.entries} == {"moron", "trash", "scum"}
    rows = tx.score(d, model).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for i in range(900):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].predicted == int(by[i].score >= 0.7) == int(i % 6 == 0)
    assert by[5000].score == by[5001].score == tx.BASE_SCORE or by[5000].score < 0.02
    assert by[5002].predicted == by[5003].predicted == by[5005].predicted == by[None].predicted == 1
    assert by[5004].score < by[5002].score
    kept = tx.drop_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == len(docs) - sum(r.predicted for r in rows)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(a, 1 - b if zlib.crc32(str(a).encode()) % 3 == 1 else b) for a, b in labels]
    models = [tx.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(d, none)
    assert model.entries == [] and [r.predicted for r in tx.score(d, model).collect()] == [0, 0]
    assert tx.score(d.limit(0), model).count() == 0


def test_the_model_is_the_same_for_any_partitions(spark):
    docs, labels = corpus()
    rng = random.Random(4)
    docs += [(6000 + i, docs[i % 40][1] + " " + "".join(rng.choices("abcdef", k=8))) for i in range(200)]  # near copies
    labels += [(6000 + i, int(i % 40 % 6 == 0)) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    models = [tx.fit(d.repartition(n).sortWithinPartitions("text"), lab.repartition(n)) for n in (1, 5, 9)]
    assert models[0] == models[1] == models[2] and models[0].belief


def test_score_against_its_definition(spark):
    """Each word counts for its nearest entry; the beliefs of words combine as independent chances."""
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = tx.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {(r.doc_id): r.score for r in tx.score(d, model).collect()}
    texts = {i: t for i, t in docs if i is not None and t and '"' not in t and i % 7 == 0 or i in (5002, 5003, 5005)}
    for i, text in texts.items():
        clean = 0.99
        for word in {w.strip("!") for w in text.lower().split()}:
            near = []
            for n, e in enumerate(model.entries):
                edits = min(distance(word[:k], e.text) for k in range(len(word) + 1)) if e.kind == "stem" else distance(word, e.text)
                if edits <= e.edits:
                    near.append((edits, -len(e.text), n))
            if near:
                edits, _, n = min(near)
                belief = model.belief.get((n, edits, False), (0.95, 0.75, 0.6)[edits])
                clean *= 1 - belief if belief >= 0.5 else 1
        assert abs(rows[i] - (1 - clean)) < 1e-12, i


def test_one_word_counts_once(spark):
    model = tx.Model([tx.Entry("abcdefgh", "word"), tx.Entry("abcdefgx", "word"), tx.Entry("abcdefgy", "word")], {(n, 1, False): 0.6 for n in range(3)})
    d = spark.createDataFrame([(1, "an abcdefgz here, abcdefgz there", 0.5)], "doc_id long, text string, toxic_score double")
    assert abs(tx.score(d, model).first().score - (1 - 0.99 * 0.4)) < 1e-12
    assert tx.drop_toxic(d, model).columns == d.columns and tx.drop_toxic(d, model).count() == 1


def test_a_worker_remembers_few_letters():
    """Long words, and letters that no entry has, take no memory beyond their text; hits stay the same."""
    model = tx.Model([tx.Entry("moron", "word"), tx.Entry("vejuai", "stem")])
    matcher = tx.Matcher(model)
    long = "vejuai" + "x" * 5000
    for i in range(300):
        hits = matcher.hits(f"{'q' * 3000}{i} {long}{i} moron {chr(0x4E00 + i)}on mo{chr(0x4E00 + i)}on")
        assert {h[:3] for h in hits} == {(f"{long}{i}", 1, 0), ("moron", 0, 0), (f"mo{chr(0x4E00 + i)}on", 0, 1)}
    assert sum(map(len, matcher.clean)) + sum(map(len, matcher.hit)) < 5000
    assert sum(map(len, matcher.automaton.moves)) < 300


def test_features_are_counted_in_bounded_parts(monkeypatch):
    """Counts of many parts add up to those of one."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(80)) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 3 == 0 for i in range(120)]).cast(pa.int32()), pa.array(texts)], names=["toxic", "text"])
    most = max(len(tx.features(t)) for t in texts)
    monkeypatch.setattr(tx, "TALLY", 2000, raising=False)
    parts = list(tx._tally(iter([batch])))
    assert len(parts) > 1 and max(p.num_rows for p in parts) < 2000 + most
    summed, plain = {}, {}
    for part in parts:
        for feature, *n in zip(*(c.to_pylist() for c in part.columns)):
            summed[feature] = [a + b for a, b in zip(summed.get(feature, (0, 0)), n)]
    for i, text in enumerate(texts):
        for feature in tx.features(text):
            plain.setdefault(feature, [0, 0])[i % 3 != 0] += 1
    assert summed == plain
