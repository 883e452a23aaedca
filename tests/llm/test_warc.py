import gzip
import hashlib
import random

from tributary.llm import warc

SCHEMA = "page_id long, url string, html string, archive string"


def history(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return warc.archived_history(df, **kw)


def test_round_trip_with_hostile_payloads(spark):
    big = "é<p>WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60
    rows = [(1, "http://a.org/x", big), (2, "http://a.org/y z\r\nWARC-Type: bad", big), (9, "http://b.org/", big), (3, None, None), (4, "http://a.org/", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "http://a.org/x", "x" * 1000), (8, "q", "x" * 1000), (None, "http://n.org", big), (9, "http://b.org/", big), (12, "http://k", "\x00\n\r"), (None, "http://n.org", "solo" * 400)]
    found = sorted((tuple(r[:1]) + tuple(r[4:8]) for r in history(spark, rows).collect()), key=repr)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        keep = max(ids, default=None) if len(body) >= 1000 else page
        again = keep is not None and page != keep
        want.append((page, "revisit" if again else "response", keep if again else None, len(body), hashlib.sha1(body).hexdigest()))
    assert found == sorted(want, key=repr)


def test_history_is_globally_ordered(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{'hot' if i % 3 else rng.choice('abcdef')}.example.org/{rng.randint(0, 3)}", f"text {i}") for i in range(500)]
    parts = history(spark, rows).rdd.glom().collect()
    keys = [(r.urlkey, r.captured, r.page_id) for part in parts for r in part]
    assert keys == sorted(keys) and len(keys) == 500 and sum(1 for p in parts if p) > 1
    assert all([r.ordinal for r in p] == list(range(len(p))) for p in parts)


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_the_merge_holds_one_block_a_run():
    """Runs of very unlike lengths and ranges, cut by a key range; the stream comes in the order of its due keys."""
    rng = random.Random(2)
    rows = []
    for run in range(40):
        low, n = rng.random(), rng.choice([1, 31, 32, 33, 400])
        entries = sorted(((None, None, f"{low + rng.random() * rng.choice([0.01, 1]):.9f}", "d", "", None, 0, "", f"a{run}", k, 1) for k in range(n)), key=warc.sort_key)
        rows += [r for r in warc.blocks(entries) if "0.3" <= r[2] < "1.4"]
    before = {None: ()}
    rows.sort(key=lambda r: (tuple(r[12].values()) if r[12] else before[None], r[8], r[11]))
    merge = warc.Forecast(iter(rows))
    out = list(warc.LoserTree(merge.runs(), warc.sort_key))
    assert out == sorted((r[:11] for r in rows), key=warc.sort_key) and len(out) > 1500
    assert merge.most <= 40 * warc.BLOCK and merge.now == 0


def test_records_are_fetched_from_the_compressed_files(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/{i}", ("é\r\n\r\n" if i % 3 else "long ") * (i * (900 if i == 55 else 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.archived_history(df, path=str(tmp_path)).collect()
    bodies = {i: (h or "").encode() for i, _, h in rows}
    for r in index:
        with open(tmp_path / r.archive, "rb") as f:
            f.seek(r.offset)
            fields, payload = warc.parse_record(gzip.decompress(f.read(r.length)))
        assert payload == bodies[r.page_id] and fields["WARC-Target-URI"] == r.url
    for file in {r.archive for r in index}:  # whole files are gzip, too, and sorted runs
        assert gzip.decompress((tmp_path / file).read_bytes()).count(b"WARC/1.1\r\n") == sum(r.archive == file for r in index)
        run = sorted((r.offset, r.urlkey, r.captured) for r in index if r.archive == file)
        assert [x[1:] for x in run] == sorted(x[1:] for x in run)
    assert {r.archive.split("/")[0] for r in index} == {"size=0", "size=1"}


def test_files_are_cut_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://a.org/", "x" * 30000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path), file_bytes=1 << 17)
    entries = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(entries) == 20 and len({r.archive for r in entries}) == 5


def test_key_as_a_column(spark):
    urls = ["https://WWW.Example.com:80/A?b#c", "http://x.org", "no scheme/p", "a://u@H.org?q://r", "x://", "", "://..", "http://É.ORG/É", "http://h/\n?x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.k for r in df.select(warc._surt(warc.F.col("url")).alias("k")).collect()] == [warc.surt(u) for u in urls]


def test_surt():
    assert warc.surt("https://WWW.Example.com:80/A?b#c") == "com,example,www)/a?b"
    assert warc.surt("http://x.org") == "org,x)/" and warc.surt(None) == ""


def test_empty_table(spark):
    assert history(spark, []).count() == 0
