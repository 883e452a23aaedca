import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tributary.operators import breakdown, investigate, records, stats
from tributary.plans.sql import query


def at(clock):
    return datetime.fromisoformat(f"2026-08-13T{clock}")


def run(logs, text, **kw):
    return [tuple(r) for r in stats.stats(logs, logs.plan(text, aggregate=True), **kw).collect()]


def test_stats(eleven):
    assert run(eleven, "stats count()") == [(11,)]
    assert run(eleven, "level:nothing stats count(), sum(status)") == [(0, None)]
    assert run(eleven, "stats count() by level")[:2] == [("error", 3), ("info", 3)]
    assert run(eleven, "stats count(), count_distinct(trace_id), avg(status) by source")[0] == ("checkout-api", 5, 2, (200 + 429 + 502) / 3)
    assert run(eleven, "stats p50(latency_ms), p95(latency_ms)") == [(310, pytest.approx(310 + 0.9 * 3090))]
    assert run(eleven, "stats count() by bin(1h), source")[0] == (at("13:00:00"), "nginx", 1)
    assert run(eleven, "after:14:00 stats count() by bin(7m)") == [(at("13:53:00"), 0 + 0) for _ in ()] + [(at("14:00:00"), 7), (at("14:07:00"), 2)]


def test_disclosures(eleven):
    found = stats.disclosed(eleven, eleven.plan("stats avg(latency_ms) by region, bin(1h)", aggregate=True))
    assert (found.matched, found.grouped, found.undated, found.absent) == (11, 2, 1, {"region": 9, "bin(1h)": 1})
    assert "8 of 11 records have no latency_ms" in found.notes
    gaps = stats.disclosed(eleven, eleven.plan("stats count() by bin(10m)", aggregate=True))
    assert gaps.empty_bins == 5
    with pytest.raises(stats.NonNumericField):
        stats.disclosed(eleven, eleven.plan("stats sum(region)", aggregate=True))


def test_records_pages_and_order(eleven):
    first = [r.message for r in records.records(eleven, eleven.plan(""), 2).collect()]
    assert first == ["GET /healthz", "request completed"]
    newest = records.page(eleven, eleven.plan("level:error"), 2, newest=True)
    assert [r.message for r in newest.rows] == ["Timeout waiting for lock", "upstream timeout contacting payments"]
    assert newest.truncated and newest.total == 3
    assert records.records(eleven, eleven.plan(""), 0, 9).count() == 2


def test_context(make_logs):
    rows = [(f"10:00:{n:02d}", "info", f"line {n}", "s", f"f{n % 2}.log", "text", {"k": n}) for n in range(20)]
    logs = make_logs(rows)
    found = [(r.seq, r.hit) for r in records.context(logs, logs.plan("k:5,9,0"), 2).collect()]
    assert found == [(1, True), (3, False), (4, False), (6, True), (8, False), (10, True), (12, False)]
    assert records.context(logs, logs.plan("k:99"), 2).count() == 0
    for n, block in ((1, 3), (2, 5), (3, 7), (2, 4)):
        whole = records.context(logs, logs.plan("k:5,9,0,6"), n).collect()
        assert records.context(logs, logs.plan("k:5,9,0,6"), n, block=block).collect() == whole


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_fold_does_not_depend_on_partitions(spark, make_logs, parts):
    rows = [(f"10:{n // 60:02d}:{n % 60:02d}" if n % 13 else None, ["info", None][n % 2], f"{'abcd'[(n // 7) % 4]} {n}", "s", "f", "text", {}) for n in range(90)]
    logs = make_logs(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    found = [(r.repeats, r.ts, r.level, r.message) for r in records.fold(logs, logs.plan("")).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for ts, level, message, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", rows.index(r))):
        if want and want[-1][3][0] == message[0]:
            want[-1][0] += 1
        else:
            want.append([1, at(ts) if ts else None, level, message])
    assert found == [tuple(w) for w in want]


def test_histogram(eleven):
    found = breakdown.histogram(eleven, eleven.plan("between:14:00-14:05"), 5).collect()
    assert len({r.bucket for r in found}) == 5 and {r.level for r in found} == {"info", "warn", "error", "fatal", "debug"}
    assert sum(r.n for r in found) == 5 and sum(r.n == 0 for r in found) == 20
    whole = breakdown.histogram(eleven, eleven.plan("level:none")).collect()
    assert [r.n for r in whole if r.n] == [1] and {r.level for r in whole} == {"none"}
    assert breakdown.bucket_width(3_600_000_000, 60) == 60_000_000 and breakdown.bucket_width(1) == 1000


def test_top(make_logs):
    logs = make_logs([(None, "info", f"GET /p{n % 3} {n}ms", "s", "f", "text", {"path": f"/p{n % 3}"} if n < 7 else ({"path": ""} if n == 7 else {})) for n in range(10)])
    assert [tuple(r) for r in breakdown.top(logs, logs.plan(""), "path").collect()] == [("/p0", 3, 3 / 8), ("/p1", 2, 2 / 8), ("/p2", 2, 2 / 8), ("", 1, 1 / 8)]
    assert tuple(breakdown.top_totals(logs, logs.plan(""), "path").first()) == (10, 8, 2, 4)
    assert [tuple(r)[:2] for r in breakdown.top(logs, logs.plan(""), r"/GET (\S+)/", 1).collect()] == [("/p0", 4)]
    assert [tuple(r)[:2] for r in breakdown.top(logs, logs.plan(""), r"message~/nothing/").collect()] == []


def test_fields(eleven):
    found = {r.field: r for r in breakdown.fields(eleven, eleven.plan(""), -1).collect()}
    assert (found["status"].records, found["status"].distinct, found["status"].numeric, found["status"].type, found["status"].place) == (5, 3, 5, "integer", "bag")
    assert found["status"].examples == ["200", "429", "502"] and found["level"].coverage == 10 / 11
    assert found["ts"].type == "timestamp" and found["message"].distinct == 11 and "absent" not in found


def test_patterns(make_logs):
    rows = [(f"10:00:{n:02d}", "info", f"took {n}ms", "s1" if n % 2 else "s2", "f", "text", {}) for n in range(6)]
    rows += [("10:30:00", "error", "fresh trouble 7", "s1", "f", "text", {}), (None, "info", "took 9ms", "s1", "f", "text", {}, False)]
    logs = make_logs(rows)
    found = breakdown.patterns(logs, logs.plan("")).collect()
    assert [(r.pattern, r.n, r.undated, r.unparsed, r.sources, r.example) for r in found] == [("took <num>ms", 7, 1, 1, ["s1", "s2"], "took 0ms"), ("fresh trouble <num>", 1, 0, 0, ["s1"], "fresh trouble 7")]
    assert [r.pattern for r in breakdown.patterns(logs, logs.plan(""), new_since="10m").collect()] == ["fresh trouble <num>"]
    assert tuple(breakdown.pattern_totals(logs, logs.plan("")).first()) == (8, 2, 1, 1)


def test_trace(eleven):
    assert investigate.detect_trace_field(eleven, "a91c40f2") == "trace_id"
    hops = investigate.trace(eleven, eleven.plan(""), "a91c40f2")
    assert [(r.seq, r.gap_us, r.text_only) for r in hops.collect()] == [(1, None, False), (3, 120_000_000, False)]
    assert tuple(investigate.trace_summary(hops).first()) == (2, 120_000_000, 0, 0, 3, 120_000_000)
    reach = {r.source: r.reach for r in investigate.trace_reach(eleven, eleven.plan(""), "a91c40f2").collect()}
    assert reach == {"checkout-api": "present", "nginx": "blind", "auth-svc": "blind", "postgres": "blind"}
    assert [r.text_only for r in investigate.trace(eleven, eleven.plan(""), "lock", "trace_id").collect()] == [True]


def test_diff(make_logs):
    rows = [(f"10:0{n % 10}:00", "info", "steady", "s", "f", "text", {"region": "eu"}) for n in range(20)]
    rows += [(f"10:1{n % 10}:00", "info", "steady", "s", "f", "text", {"region": "us" if n < 10 else "eu"}) for n in range(20)]
    rows += [("10:15:00", "error", "broken", "s", "f", "text", {"code": 5}), ("10:05:00", "info", "gone", "s", "f", "text", {}), (None, "error", "undated", "s", "f", "text", {})]
    logs = make_logs(rows)
    before, after = logs.plan("between:10:00-10:10"), logs.plan("between:10:10-10:20")
    found = {(r.kind, r.name, r.value): r for r in investigate.diff(logs, before, after, -1).collect()}
    us = found["value", "region", "us"]
    assert (us.before, us.after, us.change) == (0, 10, "appeared")
    assert us.surprise == pytest.approx(2 * 10 * math.log(10 / (10 * 21 / 42)), abs=1e-6) and us.after_rate == 10 / 600
    assert found["field", "code", None].change == "appeared" and ("value", "code", "5") not in found
    gone = next(r for k, r in found.items() if k[0] == "pattern" and r.change == "vanished")
    assert (gone.before, gone.after) == (1, 0)
    assert tuple(investigate.window_sizes(logs, before, after).first()) == (21, 21, 0, 1)


def test_explain(eleven):
    plan = eleven.plan("level:debug status:200")
    assert {r.term: r.n for r in investigate.explain(eleven, plan).collect()} == {"*": 11, "level:debug": 1, "status:200": 3}
    assert "no record matches all" in investigate.why_empty(eleven, plan)
    assert "outside the data" in investigate.why_empty(eleven, eleven.plan("after:2027-01-01T00:00:00Z"))
    assert "status:999" in investigate.why_empty(eleven, eleven.plan("status:999"))


def test_handoff(eleven):
    out = investigate.handoff(eleven, eleven.plan("trace_id:*"), redact=("region",))
    assert out.matched == 3 and out.records[0]["bag"]["region"].startswith("redacted:") and "eu-west-1" not in out.json()
    assert "| checkout-api |" in out.markdown()


def test_sources_and_range(eleven):
    found = {r.file: r for r in breakdown.sources(eleven).collect()}
    assert (found["logs/checkout-api.log"].records, found["logs/checkout-api.log"].unparsed, found["logs/checkout-api.log"].undated) == (5, 1, 1)
    assert tuple(eleven.time_range().first()) == (at("13:00:00"), at("14:08:00"), 1)


def test_raw_sql(eleven):
    out = query(eleven, "SELECT source, count(*) AS n FROM logs GROUP BY source ORDER BY n DESC, source", 2)
    assert [tuple(r) for r in out.rows] == [("checkout-api", 5), ("auth-svc", 2)] and out.truncated and out.total == 4


def test_scalars(spark):
    from tributary.functions import scalar

    df = spark.createDataFrame([("1d",), ("1f",), ("1_000",), (" 5 ",), ("inf",), ("1e3",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(scalar.try_double(F.col("t"))).collect()] == [None, None, 1000.0, 5.0, math.inf, 1000.0, None, None, None]
    levels = spark.createDataFrame([("[WARN]",), ("Err",), ("custom",), ("",), (None,)], "t string")
    assert [r[0] for r in levels.select(scalar.normal_level(F.col("t"))).collect()] == ["warn", "error", "custom", None, None]
    quoted = spark.createDataFrame([("a\\Eb+É",)], "t string")
    assert quoted.where(scalar.contains(F.col("t"), "\\eb+é")).count() == 1


def test_bucket_widths():
    hour = 3_600_000_000
    assert [breakdown.bucket_width(h * hour) // hour for h in (48, 60, 100, 120, 180, 181, 360, 700, 720, 1440, 10080, 20000)] == [1, 1, 2, 2, 3, 6, 6, 12, 12, 24, 168, 168]
    assert breakdown.bucket_width(60 * 5_000) == 10_000 and breakdown.bucket_width(1) == 1_000


def test_trace_names(make_logs):
    row = ("a.log", "jsonl")
    logs = make_logs([("14:00:00", "info", "a", "s", *row, {"x-request-id": "r1", "traceID": "r1", "trace-id": "r1"}), ("14:01:00", "info", "b", "s", *row, {"x-request-id": "r1"})])
    assert investigate.detect_trace_field(logs, "r1") == "x-request-id"
    many = [("14:00:00", "info", "a", "s", *row, {"correlation_id": "c1"})] * 20 + [("14:00:01", "info", "b", "s", *row, {"trace_id": "t1"})]
    assert investigate.detect_trace_field(make_logs(many), "c1") == "correlation_id"


def test_quantiles_of_many_values_are_the_same(make_logs):
    import random

    rng = random.Random(3)
    rows = [("14:00:00", rng.choice(["info", "error"]), "m", rng.choice("ab"), "f", "jsonl", {"n": rng.choice([rng.randint(0, 9), round(rng.random(), 3), "x"]), "k": rng.choice("uv")}) for _ in range(300)]
    logs = make_logs(rows)
    for text in ("stats p50(n), count(), p95(n), p99(k)", "stats p95(n), p50(n) by source, k", "stats p99(n) by level", "level:fatal stats p50(n), count()", "stats avg(n), p50(n) by source"):
        few, many = run(logs, text), run(logs, text, most=0)
        assert few and len(few) == len(many)
        for a, b in zip(few, many):
            assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(a, b)), text
