import io
import zipfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.dsl.syntax import DslError
from tributary.functions import udfs
from tributary.functions.template import id_column, template, template_column, template_id, template_of
from tributary.operators import investigate
from tributary.render import rendered
from tributary.sources.lines import parse_column
from tributary.streaming.follow import stream_pipe

TEMPLATES = {
    "request completed": "request completed",
    "GET /api/v1/users/12345 took 35ms from 10.0.0.1:443": "GET /api/v1/users/<num> took <num>ms from <ip>",
    "id=a91c40f2 status=500 ratio=1,234.5%": "id=<id> status=<num> ratio=<num>%",
    "at 2026-08-13T14:00:00Z and 14:00:01.5": "at <ts> and <ts>",
    "'quoted words' \"and more\" `x`": "'<str>' \"<str>\" `<str>`",
    "uuid 123e4567-e89b-12d3-a456-426614174000,": "uuid <uuid>,",
    "fe80::1 (42) [deadbeef99]": "<ip> (<num>) [<id>]",
    "word-with-dash k=v k=ab1": "word-with-dash k=v k=<id>",
    "nul\x00\x01byte\ttab": "nul<ctl>byte\ttab",
    "-5 +3.2s 7apples 12abcd": "<num> <num>s 7apples 12abcd",
    "/var/log/app/2026-08-13/x.log": "/var/log/app/<ts>/x.log",
    "/api/orders/(2291)/x": "/api/orders/(<num>)/x",
    "/a/[7]/'42'!/(deadbeef99)/()": "/a/[<num>]/'<num>'!/(<id>)/()",
    "": "",
}


@pytest.mark.parametrize("line", TEMPLATES)
def test_templates(line):
    assert template(line) == TEMPLATES[line]


def test_template_ids_are_stable():
    assert template_id("request completed") == "002cf356a676"
    assert template_of("first 1\r\nsecond 2") == "first <num>" and template_of("", "raw 7") == "raw <num>"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_template_never_fails_and_keeps_words(line):
    out = template(line)
    assert template(line) == out
    if not any(c.isdigit() or c in "./=:-\"'`" or ord(c) < 32 or ord(c) == 127 for c in line):
        assert out == line


def test_columns_and_sql_names(spark):
    udfs.register(spark)
    df = spark.createDataFrame([(1, "a 1"), (2, "a 2"), (3, None)], "id int, t string")
    rows = df.select(template_column(F.col("t")).alias("p")).select("p", id_column(F.col("p")).alias("i")).collect()
    assert [r.p for r in rows] == ["a <num>", "a <num>", None] and rows[0].i == template_id("a <num>")
    df.createOrReplaceTempView("t")
    out = spark.sql("SELECT id, template(t) AS p, template_id(t) AS i, norm_level('WARNING') AS l, log_time('2026-08-13T14:00:00Z') AS at FROM t ORDER BY id").collect()
    assert out[0].p == "a <num>" and out[2].p is None and out[0].l == "warn" and out[0].at.hour == 14
    parsed = spark.sql("SELECT p.* FROM (SELECT 'level=error msg=hi n=3' AS line), LATERAL parse_line(line) p").first()
    assert (parsed.format, parsed.level, parsed.message, parsed.parsed, parsed.fields) == ("logfmt", "error", "hi", True, '{"n":3}')


def test_parse_column(spark):
    df = spark.createDataFrame([(1, "level=error msg=hi n=3"), (2, "just text"), (3, None), (4, '{"msg":"cut","n":1,')], "message_id int, line string")
    rows = {r.message_id: r for r in parse_column(df, "line").collect()}
    assert rows[1].bag == {"n": "3"} and rows[2].format == "text" and rows[3].message is None
    assert rows[4].parsed is False and rows[4].bag["n"] == "1"
    assert parse_column(df.limit(0), "line").count() == 0


def test_redaction_in_bulk(eleven):
    rows = investigate.redact(eleven.matching(eleven.plan("region:*")), ("region", "nope")).collect()
    assert all(r.bag["region"].startswith("redacted:") and "west" not in r.fields for r in rows) and len(rows) == 2


def test_handoff_files(eleven, tmp_path):
    out = investigate.handoff(eleven, eleven.plan("level:error"))
    out.write(str(tmp_path / "h.zip"))
    assert Counter(zipfile.ZipFile(tmp_path / "h.zip").namelist()) == Counter(["handoff.md", "handoff.json", "raw.log"])


def test_pipe(spark):
    seen = []
    data = b"".join(b"level=%s msg=m%d n=%d\n" % (b"error" if n % 3 else b"info", n, n) for n in range(25))
    assert stream_pipe(spark, io.BytesIO(data), "level:error n:>=20", lambda rows: seen.extend(r.message for r in rows), rows=10) == 25
    assert seen == ["m20", "m22", "m23"]


PIPED = b"""{"ts":"2026-08-13T14:00:00Z","level":"info","msg":"piped one","status":200}
{"ts":"2026-08-13T14:00:01Z","level":"error","msg":"piped two","status":502}
{"ts":"2026-08-13T14:00:02Z","level":"info","msg":"piped three","region":"eu"}
"""


@pytest.mark.parametrize("text, expect", [("", "one two three"), ("level:error", "two"), ("status:>=500", "two"), ("-region:eu", "one two"), ("region:none", "one two"), ("status:*", "one two")])
def test_pipe_filters(spark, text, expect):
    seen = []
    assert stream_pipe(spark, io.BytesIO(PIPED), text, lambda rows: seen.extend(r.message for r in rows)) == 3
    assert seen == [f"piped {x}" for x in expect.split()]


@pytest.mark.parametrize("text", ["stats:>=500", "-nope:1", "nope:none"])
def test_a_pipe_rejects_an_unknown_field(spark, text):
    with pytest.raises(DslError, match="arrived so far") as problem:
        stream_pipe(spark, io.BytesIO(PIPED), text, lambda rows: None)
    assert "status" in str(problem.value) or "nope" in text
    with pytest.raises(DslError, match="arrived so far"):
        stream_pipe(spark, io.BytesIO(b""), text, lambda rows: None)
    assert stream_pipe(spark, io.BytesIO(b""), "", lambda rows: None) == 0


def test_a_pipe_emits_each_record_once(spark):
    seen, batches = [], []
    data = b"".join(b'{"ts":"2026-08-13T14:00:00Z","level":"info","msg":"record %d"}\n' % n for n in range(1200))
    stream_pipe(spark, io.BytesIO(data), "", lambda rows: (batches.append(len(rows)), seen.extend(r.message for r in rows)))
    assert sorted(seen) == sorted(f"record {n}" for n in range(1200)) and len(batches) > 1


def test_rendering():
    rows = [(1, None, "a,b"), (2, 0.5, "c\nd")]
    names = ["n", "x", "raw"]
    assert rendered(names, rows, "csv").splitlines()[1] == '1,,"a,b"'
    assert rendered(names, rows, "raw") == "a,b\nc\nd" and rendered(names, rows, "ndjson").count("\n") == 1
    assert rendered(names, rows).splitlines()[0] == "n  x    raw" and rendered(names, [], "json") == "[]"
