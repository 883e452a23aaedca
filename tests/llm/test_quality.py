import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é \t\n\x0b\x0c\r#*|<>\U0001f600", max_size=120))
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == plain(text)


def test_repeats_in_a_long_text():
    words = [f"w{i}" for i in range(3000)] + [f"w{i}" for i in range(50, 90)]
    assert quality.base_counts(" ".join(words).encode()) == plain(" ".join(words))


SCHEMA = "doc_id long, source string, text string, host string, lines int"


def test_common_lines_deplete_documents(spark):
    name = lambda d: chr(97 + d // 26) + chr(97 + d % 26)
    own = [" ".join(f"{name(d)}x{name(i)}" for i in range(30)) for d in range(40)]
    line = " ".join(f"menu{i}" for i in range(25))
    rows = [(d, "a", f"{own[d]}\n{line} {d}") for d in range(15)]  # half of the words stay
    rows += [(100 + d, "a", f"{line.upper()} {d}\nshort tail{d}") for d in range(5)]  # nothing of note stays
    rows += [(200 + d, "b", f"{line} {d}\nother tail{d}") for d in range(5)]  # another host, under the limit
    rows += [(300 + d, "c", f"{own[39]}\n{line}") for d in range(30)]  # copies are one document
    rows += [(400, None, None), (401, "", ""), (None, "a", own[38]), (402, None, own[37]), (402, None, own[37])]
    df = spark.createDataFrame([(a, b, c, "h", 1) for a, b, c in rows], SCHEMA)
    found = {}
    for r in quality.judge(df).collect():
        found.setdefault(r.doc_id, []).append((r.kept, r.n_words_removed))
    assert all(found[d] == [(True, 26)] for d in range(15))
    assert all(found[100 + d] == [(False, 26)] for d in range(5))
    assert all(found[200 + d] == [(True, 0)] for d in range(5))
    assert all(found[300 + d] == [(True, 0)] for d in range(30))
    assert found[400] == found[401] == [(False, 0)] and found[None] == [(True, 0)] and found[402] == [(True, 0)] * 2


def test_the_limit_grows_with_the_host(spark):
    """A line in 12 of 40 documents is common where the limit is one in 20 of them, and not where it is one in 3."""
    rows = [(i, "a", f"{'menu ' * 30}of the site\n" * (i < 12) + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(25)), "h", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sum(r.n_words_removed > 0 for r in quality.judge(df, share=20).collect()) == 12
    assert sum(r.n_words_removed > 0 for r in quality.judge(df, share=3).collect()) == 0


def test_empty_table(spark):
    out = quality.judge(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "kept" in out.columns
