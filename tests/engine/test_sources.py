import bz2
import gzip
import io
import json
import lzma
import os

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.operators import breakdown
from tributary.plans.session import Logs
from tributary.sources import formats
from tributary.sources.datasource import read_files_and_stdin, read_logs, read_stats, read_stdin
from tributary.sources.generate import Corpus
from tributary.sources.infer import column_name, demote, infer, infer_and_promote
from tributary.sources.reader import ReadStats, read, row, valid_text
from tributary.sources.store import Store
from tributary.sources.times import parse_time
from tributary.sources.walk import logical_source, walk, walk_all

LINES = {
    "jsonl": '{"ts":"2026-08-13T14:00:00Z","level":"WARN","msg":"slow","status":502,"ok":true}',
    "docker": '{"log":"ERROR read timed out\\n","stream":"stderr","time":"2026-08-13T14:00:00.5Z"}',
    "journald": '{"MESSAGE":"up","PRIORITY":"4","__REALTIME_TIMESTAMP":"1786629600000000","_PID":"7"}',
    "logfmt": 'ts=2026-08-13T14:00:00Z level=warn msg="slow call" status=502 id=007',
    "nginx": '10.0.0.1 - alice [13/Aug/2026:14:00:00 +0200] "GET /a/b HTTP/1.1" 404 12 "-" "curl/8"',
    "nginx_error": '2026/08/13 14:00:00 [crit] 12#34: *5 open() failed, client: 10.0.0.1, server: a.b, request: "GET / HTTP/1.1"',
    "syslog": '<11>1 2026-08-13T14:00:00Z host-1 sshd 99 ID7 [x@1 user="bob"] failed login',
    "log4j": "2026-08-13 14:00:00,250 [main] ERROR c.a.Pay [trace_id=ab12, n=3] - boom",
    "postgres": "2026-08-13 14:00:00.5 UTC [77] app@db ERROR: deadlock detected",
    "cri": "2026-08-13T14:00:00.5Z stderr P WARN part of",
    "haproxy": '10.0.0.1:5555 [13/Aug/2026:14:00:00.123 +0000] web api/srv1 1/2/3/4/10 503 99 - - sC-- 1/2/3/4/0 5/6 "GET /x HTTP/1.1"',
    "cef": "CEF:0|Acme|Wall|1.0|100|port scan|8|src=10.0.0.1 msg=two words rt=1786629600000",
    "redis": "812:M 13 Aug 2026 14:00:00.123 # Out of memory",
    "console": "[02:15] ✗ FAIL src/app.test",
    "text": "plain words",
}
LEVELS = dict(jsonl="warn", docker="error", journald="warn", logfmt="warn", nginx="warn", nginx_error="fatal", syslog="error", log4j="error", postgres="error", cri="warn", haproxy="error", cef="error", redis="warn", console=None, text=None)
NOON = 1786629600_000_000


@pytest.mark.parametrize("name", LINES)
def test_each_format(name):
    record = formats.FORMATS[name].parse(LINES[name])
    assert record.format == name and record.level == (LEVELS[name] or record.level)
    if name not in ("console", "text"):
        assert abs(record.stamp.us - NOON) <= 7200 * 10**6
    assert formats.choose([LINES[name]] * 3).name == name
    assert formats.MIXED.parse(LINES[name]).format == name


def test_details():
    f = formats.FORMATS
    coloured = f["console"].parse("[00:00:31] \x1b[31m✖\x1b[0m fail  src/payments/authorize.spec.ts")
    assert (coloured.level, coloured.message, coloured.fields) == ("error", "fail  src/payments/authorize.spec.ts", {"elapsed": "00:00:31", "elapsed_s": 31, "marker": "✖"})
    assert f["console"].parse("[12:05] • npm WARN deprecated").level == "warn" and f["console"].parse("[01:02:05] ok").fields["elapsed_s"] == 3725
    assert f["haproxy"].parse(LINES["haproxy"]).fields["client_port"] == 5555
    assert f["jsonl"].parse(LINES["jsonl"]).fields == {"status": 502, "ok": True}
    cut = f["jsonl"].parse('{"msg":"a","n":12,"m":3')
    assert cut.partial and cut.fields == {"n": 12, "truncated": True}
    assert f["logfmt"].parse(LINES["logfmt"]).fields == {"status": 502, "id": "007"}
    assert f["nginx"].parse(LINES["nginx"]).fields == {"client": "10.0.0.1", "user": "alice", "method": "GET", "path": "/a/b", "protocol": "HTTP/1.1", "agent": "curl/8", "status": 404, "bytes": 12}
    assert f["nginx_error"].parse(LINES["nginx_error"]).fields["client"] == "10.0.0.1"
    assert f["log4j"].parse(LINES["log4j"]).fields == {"thread": "main", "logger": "c.a.Pay", "trace_id": "ab12", "n": 3}
    assert f["postgres"].parse("2026-08-13 14:00:00 CST [7] LOG: x").stamp.abbrev == "CST"
    assert f["haproxy"].parse(LINES["haproxy"]).fields["tr_ms"] == 4
    assert f["cef"].parse(LINES["cef"]).fields["msg"] == "two words" and f["cef"].parse(LINES["cef"]).stamp.us == NOON
    assert f["console"].parse(LINES["console"]).fields == {"elapsed": "02:15", "elapsed_s": 135, "marker": "✗"}
    assert f["jsonl"].parse('{"a":1,"a":2}').fields == {"a": 1, "a.2": 2}
    with pytest.raises(formats.Unread):
        f["postgres"].parse("2026-08-13 14:00:00 UTC [7] WHATEVER: x")


@pytest.mark.parametrize(
    "text,us,zoned",
    [
        ("2026-08-13T14:00:00.123456789Z", NOON + 123456, True), ("2026-08-13T16:00:00+0200", NOON, True), ("2026-08-13 14:00:00", NOON, False), ("2026-08-13 14:00:00,250", NOON + 250000, False), ("2026-08-13 14:00:00 GMT", NOON, True),
        ("2026-08-13 14:00:00 CST", NOON, False), ("13/Aug/2026:14:00:00 +0000", NOON, True), ("2026/08/13 14:00:00", NOON, False), ("Thu, 13 Aug 2026 14:00:00 GMT", NOON, True), ("20260813T140000Z", NOON, True),
        ("1786629600", NOON, True), ("1786629600000", NOON, True), ("1786629600000000000", NOON, True), ("1786629600.5", NOON + 500000, True),
    ],
)
def test_times(text, us, zoned):
    assert (parse_time(text).us, parse_time(text).zoned) == (us, zoned)


def test_no_times():
    assert [parse_time(t) for t in ("", "x", "12", "2026-13-01T00:00:00Z", "99999999999999999999")] == [None] * 5
    assert parse_time("Aug  3 01:02:03", year=2020).us == 1596416523_000_000


def entries(data: bytes, **kw):
    stats = ReadStats()
    return list(read(io.BytesIO(data), stats=stats, **kw)), stats


def test_reader_keeps_everything():
    data = b"2026-08-13 14:00:00.000 [m] ERROR a.B - boom\r\n\tat x\n\n\tat y\nnot a log line\n2026-08-13 14:00:01.000 [m] INFO a.B - \xff\xfe ok\n"
    found, stats = entries(data, fmt=formats.FORMATS["log4j"], zone="Europe/Berlin")
    assert [e.line_no for e in found] == [1, 5, 6] and [e.parsed for e in found] == [True, False, True]
    assert found[0].record.message == "boom\n\tat x\n\tat y" and found[2].record.message.endswith("� ok")
    assert found[0].record.stamp.us == NOON - 2 * 3600 * 10**6 and row(found[2], "s", "f")["fields"].count("_raw_hex") == 1
    assert (stats.lines, stats.records, stats.unparsed, stats.continuation, stats.blank, stats.invalid_utf8, stats.zone_assumed) == (6, 3, 1, 2, 1, 1, 2)


def test_long_lines_are_cut(monkeypatch):
    from tributary.sources import reader

    assert [(len(a), b) for a, b, _ in reader.split_lines(io.BytesIO(b"x" * 50 + b"\nshort\n" + b"y" * 30), 20)] == [(20, True), (5, False), (20, True)]


def test_invalid_runs_become_one_mark():
    assert valid_text(b"a\xff\xfe\xfdb\xc3(") == ("a�b�(", False) and valid_text("é".encode()) == ("é", True)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80))
def test_no_line_breaks_the_reader(data):
    found, stats = entries(data, fmt=formats.MIXED)
    assert stats.records == len(found) and stats.lines >= stats.records + stats.blank + stats.continuation - 0


def test_walk(tmp_path):
    files = {"app.log": b"a b\n", "app.log.1": b"c\n", "app.log.2.gz": gzip.compress(b"d\n"), ".hid.log": b"x\n", "empty.log": b"", "x.png": b"x\n", "bin.log": b"\0" * 100, "doc.log": b"{\n \"a\": 1\n}\n", "node_modules/m.log": b"x\n", "sub/other.txt": b"e\n"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.log").symlink_to(tmp_path / "app.log")
    (tmp_path / "broken.log").symlink_to(tmp_path / "nowhere")
    out = walk(str(tmp_path))
    assert [os.path.relpath(f.path, tmp_path) for f in out.files] == ["app.log.2.gz", "app.log.1", "app.log", "sub/other.txt"]
    why = {os.path.relpath(p, tmp_path): w for p, w in out.skipped}
    assert why["empty.log"] == "empty" and why["bin.log"] == "binary" and why["doc.log"] == "a JSON document" and "same file" in why["link.log"] and "link" in why["broken.log"]
    assert [os.path.basename(f.path) for f in walk(str(tmp_path), include=("app*",), exclude=("*.1",)).files] == ["app.log.2.gz", "app.log"]
    assert walk_all([str(tmp_path / "nope")]).skipped[0][1] == "does not exist"
    assert logical_source("/x/app.log.2.gz") == "app" and logical_source("plain") == "plain"


def test_codecs_and_splits_give_the_same_rows(spark, tmp_path):
    Corpus(str(tmp_path / "plain"), minutes=0.3).write()
    os.remove(tmp_path / "plain" / "manifest.json")
    whole = read_logs(spark, [str(tmp_path / "plain")]).orderBy("seq").collect()
    assert [r.seq for r in whole] == list(range(1, len(whole) + 1)) and len(whole) > 200
    assert read_logs(spark, [str(tmp_path / "plain")], splitBytes=500).orderBy("seq").collect() == whole
    (tmp_path / "packed").mkdir()
    packers = [gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress, lambda x: x, gzip.compress]
    for pack, name in zip(packers, sorted(os.listdir(tmp_path / "plain"))):
        (tmp_path / "packed" / name).write_bytes(pack((tmp_path / "plain" / name).read_bytes()))
    same = read_logs(spark, [str(tmp_path / "packed")]).orderBy("seq").collect()
    assert [(r.seq, r.raw, r.pattern_id) for r in same] == [(r.seq, r.raw, r.pattern_id) for r in whole]
    figures = {os.path.basename(r.file): r for r in read_stats(spark, [str(tmp_path / "plain")]).collect()}
    assert sum(r.records for r in figures.values()) == len(whole) and figures["access.log"].format == "nginx"


def test_promotion(spark, tmp_path):
    lines = [json.dumps({"msg": f"m{i}", "status": i % 3, "ratio": i / 2, "when": "2026-08-13T14:00:00Z", "flag": i % 2 == 0, "deep": {"a": 1}, "rare": 1 if i < 3 else None, "7up": "x"}) for i in range(30)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    table, found = infer_and_promote(read_logs(spark, [str(tmp_path)]))
    assert {p.field: (p.column, p.kind) for p in found} == {"status": ("status", "integer"), "ratio": ("ratio", "float"), "when": ("when", "timestamp"), "flag": ("flag", "boolean"), "7up": ("f_7up", "string")}
    assert table.agg({"ratio": "max"}).first()[0] == 14.5 and demote(table).columns[-1] == "pattern_id"
    assert column_name("a.b-C d") == "a_b_c_d" and infer([]) == []


def test_store_refreshes_what_changed(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text('{"msg":"one","n":1}\n')
    (folder / "b.log").write_text('{"msg":"two","n":2}\n')
    store = Store(spark, str(tmp_path / "cache"))
    read_ = lambda: [(r.seq, r.message) for r in store.open([str(folder)]).table.orderBy("seq").collect()]
    assert read_() == [(1, "one"), (2, "two")]
    before = store.entries()[0][0]
    with open(folder / "a.log", "a") as f:
        f.write('{"msg":"more","n":3}\n')
    assert read_() == [(1, "one"), (2, "more"), (3, "two")] and store.entries()[0][0] == before
    os.remove(folder / "b.log")
    assert read_() == [(1, "one"), (2, "more")]
    assert "n" in store.open([str(folder)]).table.columns
    assert store.prune(most_days=-1) == [before] and store.entries() == []


def test_stdin(spark):
    table = read_stdin(spark, stream=io.BytesIO(b"level=info msg=hi n=1\nlevel=warn msg=ho n=2\n"))
    logs = Logs(table)
    assert [r.message for r in logs.matching(logs.plan("n:>1")).collect()] == ["ho"]
    assert breakdown.sources(logs).first().source == "stdin"


def test_which_endings_are_read(tmp_path):
    skipped = "duckdb db sqlite sqlite3 zip tar 7z png jpg jpeg gif pdf ico so dylib dll exe a o class jar pyc wasm mp4 mov mp3 woff woff2 ttf".split()
    taken = "log txt out err yaml yml md html js ts py go rb toml lock css svg 1".split()
    for ending in skipped + taken:
        (tmp_path / f"x.{ending}").write_text("level=info msg=hi\n")
    found = walk(str(tmp_path))
    assert sorted(os.path.basename(f.path) for f in found.files) == sorted(f"x.{e}" for e in taken)
    assert len(found.skipped) == len(skipped)


def test_a_stream_and_files_are_one_table(spark, tmp_path):
    (tmp_path / "app.log").write_text('{"ts":"2026-08-13T14:03:00Z","level":"info","msg":"from a file"}\n')
    piped = b"".join(b'{"ts":"2026-08-13T14:0%d:00Z","level":"info","msg":"piped %d","status":50%d}\n' % (n, n, n) for n in range(3))
    rows = read_files_and_stdin(spark, ["-", str(tmp_path)], io.BytesIO(piped)).orderBy("seq").collect()
    assert [(r.seq, r.source, r.message) for r in rows] == [(1, "app", "from a file"), (2, "stdin", "piped 0"), (3, "stdin", "piped 1"), (4, "stdin", "piped 2")]
    assert read_files_and_stdin(spark, ["-"], io.BytesIO(piped)).count() == 3 and read_files_and_stdin(spark, [str(tmp_path)]).count() == 1
