import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.llm import url_filter


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [
    None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://a.www.example.com/en/1", "http://example.com",
    "http://notexample.com/en/", "x://y.net/es/a", "x://y.net/fr/?a", "x://y.net/de/", "://z.net/es/", "a://b://c.net/es/", "http://É.net/fr/", "http://a.net\n/es/", "http://com/", "http://org/?x", "http://q.org#/a", "http://net/es/" * 2,
]


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[4], "h", "v")], "page_id long, url string, host string, verdict string")
    listed = lambda h: h.isin("y.net", "org", "q.org", "com")
    rows = url_filter.judge(df, listed=listed).collect()
    assert len(rows) == len(URLS) + 4
    for r in rows:
        host, path, rule, verdict = plain(URLS[4] if r.page_id is None else (URLS + URLS[:3])[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if host in ("y.net", "org", "q.org", "com") else "allow"))


def test_cascade_is_exact_over_the_universe_in_several_blocks(spark):
    keys = spark.range(6000).select(F.concat(F.lit("key"), "id").alias("key"))
    cascades, shards = url_filter.membership(keys, F.expr("cast(substr(key, 4) as int) % 3 = 0"), block_bytes=2500)
    assert len(cascades) > 2 and max(len(c.bits) for c in cascades) > 2
    marked = url_filter.probe(keys, "key", cascades, shards).collect()
    assert all(r.listed == (int(r.key[3:]) % 3 == 0) for r in marked)


def test_hashes_that_both_kinds_of_key_have(spark):
    keys = spark.range(6000).select(F.concat(F.lit("key"), "id").alias("key"))
    cascades, shards = url_filter.membership(keys, F.expr("cast(substr(key, 4) as int) % 3 = 0"), bits=20)
    assert cascades[0].shared
    marked = url_filter.probe(keys, "key", cascades, shards, bits=20).collect()
    assert len(marked) == 6000 and all(r.listed == (int(r.key[3:]) % 3 == 0) for r in marked)


def test_empty_lists_and_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(one, listed=lambda h: F.lit(False)).collect()] == ["allow"]
    assert [r.verdict for r in url_filter.judge(one, listed=lambda h: F.lit(True)).collect()] == ["block"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_positions_stay_inside(values):
    for p in url_filter._positions(np.array(values, np.uint64), 3, 97):
        assert (p < 97).all()
