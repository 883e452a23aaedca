import random

from tributary.llm import license_scan as ls


def plain(docs):
    best = {}
    bodies = [(licence, set(ls._parts(body))) for _, licence, body in ls.TEMPLATES]
    for doc, text in docs:
        words = ls.words_of(text or "")
        for name, licence, body in ls.TEMPLATES:
            want, size = set(ls._parts(body)), ls.size_class(body)
            for at in range(0, max(0, len(words) - 4), size):
                part = words[at : at + 2 * size + 4]
                hits = len(want & {tuple(part[i : i + 5]) for i in range(len(part) - 4)})
                here = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
                rivals = [want - other for name2, other in bodies if name2 != licence and 2 * len(want & other) >= len(want)]
                told = all(2 * len(rest & here) >= len(rest) for rest in rivals)
                if hits >= 0.8 * len(want) and told:
                    old = best.get((doc, name, licence))
                    best[doc, name, licence] = (max(hits, old[0] if old else 0), len(want), min(at, old[2] if old else at))
    return sorted((*k, *v) for k, v in best.items()) if None not in {k[0] for k in best} else sorted(((*k, *v) for k, v in best.items()), key=repr)


def test_against_plain_windows(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(99)] + ["license", "the", "licensed", "software"]
    docs = []
    for i in range(60):
        words = rng.choices(filler, k=rng.choice([2, 30, 900]))
        for _, _, body in rng.sample(ls.TEMPLATES, rng.randint(0, 3)):
            part = body.split()
            if rng.random() < 0.4 and len(part) > 20:
                part[rng.randrange(len(part))] = "changed"
            words[rng.randint(0, len(words)) : 0] = part
        docs.append((i, rng.choice([" ", "\n", " -- "]).join(words)))
    docs += [(100, None), (101, ""), (102, "released UNDER the mit license"), (103, "Licensed under"), (None, "Licensed under CC BY-NC 4.0."), (102, "released UNDER the mit license")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id long, text string, template string, words string")
    found = sorted((tuple(r) for r in ls.scan(df).collect()), key=repr)
    assert found == sorted(plain(docs), key=repr) and len(found) > 30


def test_anchors_lose_nothing():
    marks = ls.anchors()
    for _, _, text in ls.TEMPLATES:
        parts = ls._parts(text)
        assert sum(not set(p) & set(marks) for p in parts) < 0.8 * len(parts)


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ls.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


GPL = "This program is free software; {} GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


def test_versions_and_families_are_told_apart(spark):
    grant = "you can redistribute it and/or modify it under the terms of the"
    texts = {"GPL 2": GPL.format(grant, "", "2"), "GPL 3": GPL.format(grant, "", "3"), "LGPL 2.1": GPL.format(grant, "Lesser ", "2.1"), "AGPL 3": GPL.format(grant, "Affero ", "3")}
    texts |= {f"notice {v}": f"This work is licensed under the GNU General Public License, version {v}." for v in (2, 3, 4)}
    texts["BSD 2"] = ls._BSD
    texts["BSD 3"] = f"{ls._BSD} {ls._BSD_NAMES}"
    texts["MIT"] = " ".join(t for n, _, t in ls.TEMPLATES if n in ("mit-permission", "mit-warranty"))
    names = list(texts)
    df = spark.createDataFrame([(i, texts[n]) for i, n in enumerate(names)], "doc_id long, text string")
    found = {}
    for r in ls.scan(df).collect():
        found.setdefault(names[r.doc_id], set()).add(r.license)
    assert found["GPL 2"] == {"GPL", "GNU version 2 or later"} and found["GPL 3"] == {"GPL", "GNU version 3 or later"}
    assert found["LGPL 2.1"] == {"LGPL", "GNU version 2.1 or later"} and found["AGPL 3"] == {"AGPL", "GNU version 3 or later"}
    assert found["notice 2"] == {"GPL-2.0"} and found["notice 3"] == {"GPL-3.0"} and "notice 4" not in found
    assert found["BSD 2"] == {"BSD"} and found["BSD 3"] == {"BSD", "BSD-3-Clause"} and found["MIT"] == {"MIT"}


def test_a_very_long_text_with_hits_and_rows_without_ids(spark):
    rng = random.Random(8)
    filler = rng.choices([f"w{i}" for i in range(500)], k=60_000)
    notices = {50: ls._APACHE, 30_000: ls._BSD, 59_990: "Released under the MIT License."}
    for at in sorted(notices, reverse=True):
        filler[at:at] = notices[at].split()
    docs = [(None, " ".join(filler)), (None, "Licensed under CC BY-SA 4.0."), (None, "x " + ls._APACHE)]
    found = sorted((tuple(r) for r in ls.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert found == sorted(plain(docs), key=repr) and {f[2] for f in found} == {"Apache-2.0", "BSD", "MIT", "CC-BY-SA-4.0"}
