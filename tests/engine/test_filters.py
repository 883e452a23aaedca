import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.dsl.syntax import DslError, SyntaxProblem, parse, render
from tributary.functions.predicates import UnknownLevel
from tributary.plans.schema import UnknownField, suggest
from tributary.plans.session import AmbiguousPattern, MalformedPattern, StatsUnsupported, UnknownPattern

from .conftest import messages

SEQ = {
    "": set(range(1, 12)),
    "level:error": {3, 10, 11},
    "level:ERR,warning": {2, 3, 10, 11},
    "level:>=warn": {2, 3, 4, 10, 11},
    "level:>warn": {3, 4, 10, 11},
    "level:<info": {5},
    "-level:info": {2, 3, 4, 5, 8, 9, 10, 11},
    "level:none": {8},
    "level:*": set(range(1, 12)) - {8},
    "level:audit": {9},
    "status:>=400": {2, 3},
    "status:200": {1, 6, 7},
    "-status:200": set(range(1, 12)) - {1, 6, 7},
    "latency_ms:<50": {1},
    "status:200,429": {1, 2, 6, 7},
    "region:*": {1, 3},
    "region:none level:info": {6, 7},
    "region:eu-west-1": {1},
    "TRACE_ID:a91c40f2": {1, 3},
    "timeout": {3, 11},
    "Timeout": {11},
    "FATAL": {4},
    '"rate limited"': {2},
    "-timeout level:error": {10},
    "message~/^GET .*out$/": {6},
    "message~timeout": {3, 11},
    "msg~Timeout": {11},
    "-message~/e/": set(),
    "source:check": {1, 2, 3, 5, 10},
    "source:NGINX": {6, 7},
    "file:access.log": {6},
    "file:access.log*": {6, 7},
    "file:*post*": {4, 11},
    "parsed:false": {10},
    "ts:none": {10},
    "ts:*": set(range(1, 12)) - {10},
    "pid:20044,20099": {4, 11},
    "path~checkout": {6},
    "flag:new_checkout_flow": {5},
    "issuer:auth.internal -actor:*": {8},
    "line:>=10": {10, 11},
    "14:02-14:04": {3, 4},
    "between:14:02-14:04": {3, 4},
    "after:14:06": {8, 9, 11},
    "before:13:30": {7},
    "last:2m": {8, 9, 11},
    "on:2026-08-13": set(range(1, 12)) - {10},
    "-between:14:00-14:05": {6, 7, 8, 9, 10, 11},
    "after:2026-08-13T14:05:30Z before:2026-08-13T14:07:00Z": {8},
    "after:2026-08-14": set(),
    'after:"2026-08-13 14:07:30"': {11},
    "message:>z": set(),
    "message~100%": set(),
    "message~rate_limited": set(),
}


@pytest.mark.parametrize("text", SEQ)
def test_filters(eleven, text):
    plan = eleven.plan(text)
    assert {r.seq for r in eleven.matching(plan).select("seq").collect()} == SEQ[text]
    assert parse(render(parse(text))) == parse(text)


def test_promoted_fields_answer_alike(eleven):
    from tributary.plans.session import Logs
    from tributary.sources.infer import infer, promote, sample

    found = infer(sample(eleven.table), least=0.1)
    assert {p.field for p in found} >= {"status", "pid", "path"}
    typed = Logs(promote(eleven.table, found), tuple(found))
    assert dict(typed.table.dtypes)["status"] == "bigint"
    for text in SEQ:
        assert {r.seq for r in typed.matching(typed.plan(text)).select("seq").collect()} == SEQ[text], text
    assert {r.seq for r in typed.matching(typed.plan("status:abc")).collect()} == set()
    assert {r.seq for r in typed.matching(typed.plan("status~5")).collect()} == {3}


def test_time_reaches_the_scan(spark, eleven, tmp_path):
    from tributary.plans.session import Logs

    eleven.table.write.parquet(str(tmp_path / "t"))
    logs = Logs(spark.read.parquet(str(tmp_path / "t")))
    plan = logs.matching(logs.plan("after:2026-08-13T14:05:00Z level:error"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "In(level" in plan or "EqualTo(level" in plan


@pytest.mark.parametrize("text", ["level:", "a:,b", "stats", "stats count(", "stats nope(x)", "stats sum()", "stats count() by", "stats count() by bin(0s)", "stats count() by bin(x)", "stats count() stats count()", "last:", ":x", 'a:"x', "a~/x", "stats count() by f(x)"])
def test_malformed(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


@pytest.mark.parametrize("text,error", [("stauts:200", UnknownField), ("level:>loud", UnknownLevel), ("last:x", DslError), ("on:14:00", DslError), ("between:14:00", DslError), ("after:yesterday", DslError), ("stats count()", StatsUnsupported), ("pattern:zz", MalformedPattern), ("pattern:000000000000", UnknownPattern)])
def test_errors(eleven, text, error):
    with pytest.raises(error):
        eleven.plan(text)


def test_suggestions():
    assert "status" in suggest("stauts", ["status", "path", "state"])
    assert suggest("trace", ["trace_id", "level"]) == ["trace_id"]
    assert suggest("qqqqqq", ["status"]) == []


def test_pattern_ids(eleven):
    ids = sorted({r.pattern_id for r in eleven.table.select("pattern_id").collect()})
    assert eleven.pattern(ids[0]) == ids[0] and len(messages(eleven, f"pattern:{ids[0]}")) == 1
    shared = next((a[:1] for a, b in zip(ids, ids[1:]) if a[0] == b[0]), None)
    if shared:
        with pytest.raises(AmbiguousPattern):
            eleven.pattern(shared)


WORDS = st.text(alphabet='ab:,"~/-<>= \\n\'.()*1é', max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=4).map(" ".join))
def test_what_parses_renders_back(text):
    try:
        tree = parse(text)
    except DslError:
        return
    assert parse(render(tree)) == tree


def test_views_of_a_call_leave_the_sessions_own_alone(spark, eleven):
    from tributary.plans.sql import query, run_sql

    spark.range(3).createOrReplaceTempView("logs")
    assert query(eleven, "SELECT count(*) AS n FROM logs").rows[0].n == 11
    assert spark.table("logs").count() == 3
    late = run_sql(spark, "SELECT * FROM only_here", {"only_here": spark.range(5)})
    assert late.count() == 5 and not spark.catalog.tableExists("only_here")
    spark.catalog.dropTempView("logs")
