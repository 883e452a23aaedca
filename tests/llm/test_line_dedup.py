import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import line_dedup as ld


def shape(line):
    """Tokens of a line in lower case, those with a digit as one; the line itself if that leaves no letter."""
    words = re.findall(r"[^\x20\x09-\x0d]+", line)
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    masked = ["#" if re.search("[0-9]", w) else w for w in words]
    letters = lambda x: re.search("[a-z\x80-\U0010ffff]", " ".join(x))
    return tuple(masked if letters(masked) else words if "#" in masked else ())


def windows(text):
    """For each line, the five words from each of its words."""
    words = [(n, w) for n, line in enumerate(text.split("\n")) for w in line.split()]
    out = defaultdict(set)
    for i, (n, _) in enumerate(words):
        out[n].add(tuple(w for _, w in words[i : i + 5]))
    return out


def plain(rows, least):
    """The rules over dictionaries, with whole sets of windows in place of sketches."""
    texts = sorted({t for _, t in rows if t})
    lines = {t: [shape(x) for x in t.split("\n")] for t in texts}
    grams = {t: windows(t) for t in texts}
    holders, gram_in = defaultdict(set), defaultdict(set)
    for t in texts:
        for x in lines[t]:
            if x:
                holders[x].add(t)
        for found in grams[t].values():
            for g in found:
                gram_in[g].add(t)
    candidates = {x for x, held in holders.items() if len(held) >= least or len(held) > 1 and len(x) >= 50}

    def own(t):
        rest = [(n, x) for n, x in enumerate(lines[t]) if x and x not in candidates]
        shared = lambda n: sum(len(gram_in[g]) > 1 for g in grams[t][n]) >= len(grams[t][n]) / 2
        words = sum(len(x) for _, x in rest)
        mine = sum(len(x) for n, x in rest if not shared(n))
        return mine > 0 and mine >= words / 2

    evidence = {t for t in texts if own(t)}
    weight = {x: held & evidence for x, held in holders.items() if held & evidence}
    enough = lambda own, held: len(own) >= least and len(own) >= 0.1 * len(held)
    gone = {x for x, own in weight.items() if enough(own, holders[x])}

    def unlike(a, b, x):
        a, b = (set().union(*(g for n, g in grams[t].items() if lines[t][n] != x)) for t in (a, b))
        return a and b and len(a & b) < 0.3 * len(a | b)

    gone |= {x for x, held in holders.items() if len(x) >= 50 and any(unlike(a, b, x) for a in held for b in held)}
    leaves = defaultdict(list)
    for x in weight:
        leaves[len(x), x[:3]].append(x)
    for (size, _), kinds in leaves.items():
        if len(kinds) < 2 or len(set().union(*(weight[x] for x in kinds))) < least:
            continue
        left = kinds
        for share in (None, 0.8):
            times = Counter((at, w) for x in left for at, w in enumerate(x) for _ in weight[x])
            total = sum(len(weight[x]) for x in left)
            constant = {k for k, n in times.items() if (n >= least if share is None else n >= share * total)}
            groups = defaultdict(list)
            for x in left:
                kept = tuple((at, w) for at, w in enumerate(x) if (at, w) in constant)
                if len(kept) >= 0.6 * size and len(kept) - 3 >= 0.6 * (size - 3):
                    groups[kept].append(x)
            found = [g for g in groups.values() if sum(len(weight[x]) for x in g) >= least]
            for g in found:
                if enough(set().union(*(weight[x] for x in g)), set().union(*(holders[x] for x in g))):
                    gone |= set(g)
            left = [x for x in left if not any(x in g for g in found)]
    out = []
    for doc, text in rows:
        own_lines = (text or "").split("\n")
        drop = [shape(x) in gone for x in own_lines]
        out.append((doc, sum(drop), sum(len(x.split()) for x, d in zip(own_lines, drop) if d), zlib.crc32("\n".join(x for x, d in zip(own_lines, drop) if not d).encode())))
    return sorted(out, key=repr)


def sort(found):
    return sorted((tuple(r) for r in found), key=repr)


def test_marks():
    templates, hashes = np.array([5, 5, 6, 7, 6]), np.array([33, 65, 97, 64, 34], np.uint64)
    least, by, second = ld.text_marks(templates, hashes)
    assert ld.MARKS == 32 and (least[0], by[0], second[0]) == (2, 7, -1)
    assert (least[1], by[1], second[1]) == (1, 5, 3) and (least[2], by[2], second[2]) == (1, 6, -1) and least[3] == -1


RNG = random.Random(9)


def word(n=6):
    return "".join(RNG.choices("abcdefghij", k=n))


def line(n):
    return " ".join(word() for _ in range(n))


def edited(text, times):
    words = text.split(" ")
    for at in RNG.sample(range(len(words)), times):
        if "\n" not in words[at]:
            words[at] = word()
    return " ".join(words)


def fixture():
    rows = []
    for i in range(70):
        lines = [line(RNG.randint(2, 12)) for _ in range(RNG.randint(3, 8))]
        if i < 30:
            lines.insert(RNG.randint(0, 3), f"Copyright {1990 + i} all rights reserved page {i} of 99")
        if i % 2:
            lines.insert(RNG.randint(0, 3), f"Posted by the user {word()} in the general talk forum today")
        if i % 5 == 0:
            lines[0:0] = ["Read MORE about this\there", "All rights reserved.", "Page 3", f"{i} 17", "4 2 2", "---", "4 2 2"]
        rows.append((i, "\n".join(lines)))
    group = "\n".join(line(15) for _ in range(12))
    rows += [(200 + i, edited(group, 6)) for i in range(40)]  # near copies
    rows += [(300 + i, rows[1][1]) for i in range(20)]  # exact copies
    return rows + [(400, None), (401, ""), (402, "\n\n"), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("least", [10, 13])
def test_against_plain_rules(spark, least):
    rows = fixture()
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, leaf int, template int").repartition(3)
    want = plain(rows, least)
    assert sort(ld.report(df, least).collect()) == want
    dropped = {r[0]: r[1] for r in want if r[0] is not None}
    assert sum(dropped[i] for i in range(30)) > 30 and all(dropped[200 + i] == 0 for i in range(40))


@pytest.mark.parametrize("shared, own", [(3, 300), (10, 150), (25, 30), (25, 5), (100, 20)])
def test_pages_of_boilerplate(spark, shared, own):
    """10 to 98 % of each page is the same; each line of that goes, wherever the page's own words are."""
    common = [line(12) for _ in range(shared)]
    rows = []
    for i in range(60):
        at = RNG.randint(0, shared)
        rows.append((i, "\n".join([*common[:at], line(own), *common[at:]])))
    out = ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sort(out) == plain(rows, 10) and all(r.lines_dropped == shared and r.words_dropped == 12 * shared for r in out)


@pytest.mark.parametrize("copies, edits", [(2, 5), (9, 8), (60, 3), (400, 8)])
def test_groups_of_copies_stay_whole(spark, copies, edits):
    """Lines of 10 to 60 words; every copy has words of its own in some of them."""
    text = "\n".join(line(n) for n in (10, 30, 60, 60, 20, 14, 55, 12, 70, 10))
    rows = [(i, edited(text, edits)) for i in range(copies)] + [(1000 + i, text) for i in range(30)] + [(2000 + i, line(100)) for i in range(20)]
    out = ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(r.lines_dropped == 0 for r in out)


def test_a_copied_page_of_boilerplate(spark):
    """The boilerplate of many pages goes, the page's own lines stay in all its copies."""
    common, page = [line(12) for _ in range(5)], [line(20) for _ in range(6)]
    rows = [(i, "\n".join([*common, line(30)])) for i in range(20)]
    rows += [(100 + i, "\n".join([*common, *page[:-1], edited(page[-1], 1)])) for i in range(30)]
    out = ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sort(out) == plain(rows, 10) and all(r.lines_dropped == 5 for r in out)


def test_stage_keeps_columns_and_the_join_agrees(spark):
    rows = fixture()
    df = spark.createDataFrame([(a, b, "en", "s", 7) for a, b in rows], "doc_id long, text string, TEXT_ID string, gone string, n_chars long")
    out = ld.drop_recurring_lines(df)
    assert out.columns == df.columns
    found = sort((r.doc_id, zlib.crc32((r.text or "").encode())) for r in out.collect())
    assert found == sort((a, d) for a, _, _, d in plain(rows, 10))
    assert all(r.n_chars == (7 if r.text is None else len(r.text)) for r in out.collect())
    again = ld.drop_templates(df, ld.recurring_templates(df), most=1)
    assert again.columns == df.columns
    assert sort((r.doc_id, zlib.crc32((r.text or "").encode())) for r in again.collect()) == found


def test_salted_joins_agree(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(ld, "flagged", lambda *a: FLAGGED(*a, most=0))
        m.setattr(ld, "looked_up", lambda *a: LOOKED_UP(*a, most=0))
        assert sort(ld.report(df).collect()) == plain(rows, 10)


FLAGGED, LOOKED_UP = ld.flagged, ld.looked_up


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.report(df).count() == 0 and ld.drop_recurring_lines(df).count() == 0


def test_two_templates_and_prose_in_one_leaf(spark):
    shared = [lambda: f"thank you for reading this post {word()}", lambda: f"thank you for visiting our website {word()}", lambda: f"thank you for {line(4)}"]
    rows = [(i, line(12) + "\n" + shared[i % 3]() + "\n" + line(15)) for i in range(120)]
    out = ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sort(out) == plain(rows, 10) and all(r.lines_dropped == (r.doc_id % 3 < 2) for r in out)


def test_a_template_of_one_text_is_none(spark):
    rows = [(0, "\n".join(f"the item of name {word()} is in the list of things now" for _ in range(40))), *((i, line(50)) for i in range(1, 30))]
    assert all(r.lines_dropped == 0 for r in ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_long_passages_of_few_unlike_texts(spark):
    passages = {k: line(n) for k, n in ((2, 60), (9, 55), (5, 49))}
    rows = [(100 * k + i, line(60) + "\n" + line(40) + "\n" + line(30) + "\n" + passage + "\n" + line(20) + "\n" + line(50)) for k, passage in passages.items() for i in range(k)]
    rows += [(5000, edited(rows[0][1], 4))]  # a copy of the first
    out = {r.doc_id: r.lines_dropped for r in ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: n for k, n in out.items() if k < 5000} == {i: int(200 <= i < 1000 and not 500 <= i < 600) for i, _ in rows if i < 5000}


class Held:
    def __init__(self, value):
        self.value = value


def map_of(keys):
    bits = np.zeros((1 << 26) // 8, np.uint8)
    for key in keys:
        bits[(key & (1 << 26) - 1) >> 3] |= 1 << (key & 7)
    return bits


def test_later_passes_parse_only_the_texts_they_need(monkeypatch):
    texts = {7: "one two three\nfour five six", -9: "seven eight nine\nten", 1 << 40: "one two three\nten", 12: "four five six"}
    parsed, codes = [], ld.codes
    monkeypatch.setattr(ld, "codes", lambda line: parsed.append(line) or codes(line))
    leaf, template, _ = codes(b"one two three")
    batch = pa.record_batch([pa.array([*texts, 7], pa.int64()), pa.array([*texts.values(), texts[7]])], names=["id", "text"])
    rows = [r for out in ld._leaf_lines(Held((map_of([7, -9]), map_of([leaf]))))(iter([batch, batch])) for r in out.to_pylist()]
    assert [(r["leaf"], r["template"], len(r["line"])) for r in rows] == [(leaf, template, 3)]
    assert parsed == [line.encode() for text in (7, -9) for line in texts[text].split("\n")]
    parsed.clear()
    rows = [r for out in ld._marked(Held(map_of([12])))(iter([batch])) for r in out.to_pylist()]
    assert [r["text"] for r in rows] == [12] and parsed == [b"four five six"]


def test_the_lines_are_plain_numbers(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + "\nsecond line"), (2, None)], "doc_id long, text string")
    lines = ld.line_table(df)
    assert {kind for _, kind in lines.dtypes} <= {"bigint", "int"} and sorted(r.tokens for r in lines.collect()) == [2, 60]
