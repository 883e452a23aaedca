import json
import os
import time
import urllib.error
import urllib.request
from threading import Thread

import pytest

from tributary import cli
from tributary.server import server
from tributary.sources.generate import Corpus
from tributary.streaming import windows
from tributary.streaming.follow import Follower, Hub
from tributary.workspace import Workspace


def test_follow_emits_whole_records_once(spark, tmp_path):
    folder, check = tmp_path / "logs", str(tmp_path / "check")
    folder.mkdir()
    path = folder / "a.log"
    seen: list[str] = []
    follower = Follower(spark, [str(folder)], options={"parser": "log4j"})

    query = follower.records("level:error", check, lambda rows: seen.extend(r.message for r in rows))

    def wait(n):
        until = time.time() + 40
        while len(seen) < n and time.time() < until and query.isActive:
            time.sleep(0.2)
        assert query.exception() is None
        return seen

    try:
        path.write_text("2026-08-13 14:00:00.000 [m] ERROR a.B - one\n\tat x\n2026-08-13 14:00:01.000 [m] INFO a.B - two\n")
        assert wait(1) == ["one\n\tat x"]
        with open(path, "a") as f:
            f.write("2026-08-13 14:00:02.000 [m] ERROR a.B - three\n\tat y\n")
        (folder / "b.log").write_text("2026-08-13 14:00:03.000 [m] ERROR a.B - four\n")
        assert sorted(wait(3)) == ["four", "one\n\tat x", "three\n\tat y"]
    finally:
        query.stop()


def test_hub_serves_each_listener(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    hub = Hub(Follower(spark, [str(folder)]), str(tmp_path / "check"))
    errors, numbers, unknown = hub.subscribe("level:error"), hub.subscribe("n:>1"), hub.subscribe("nope:1")
    (folder / "a.log").write_text("".join(f"level={l} msg=m{n} n={n}\n" for n, l in enumerate(["error", "info", "error"])))
    query = hub.start()
    try:
        assert [r.message for _ in range(2) for r in errors.events.get(timeout=40)[1]] == ["m0", "m2"]  # the last line waits for a second look
        assert [r.message for r in numbers.events.get(timeout=40)[1]] == ["m2"]
        assert unknown.events.get(timeout=40)[0] == "notice"
    finally:
        query.stop()
    for n in range(40):
        errors.put(("records", [n]))
    assert errors.lag > 0


@pytest.mark.parametrize("kind", ["tumbling", "session"])
def test_windows_agree_with_batch(spark, tmp_path, kind):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * F.lit(37) + F.floor(F.col("id") / 50) * 4000).alias("ts"), (F.col("id") % 2).alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    if kind == "tumbling":
        found = windows.run_to_table(spark, windows.binned(stream, "ts", "10 minutes", ["k"]), str(tmp_path / "out"))
        want = rows.groupBy(F.window("ts", "10 minutes").alias("w"), "k").count().select("w.start", "k", "count")
    else:
        found = windows.run_to_table(spark, windows.sessions(stream, "ts", "10 minutes", ["k"]), str(tmp_path / "out"))
        want = rows.groupBy(F.session_window("ts", "10 minutes").alias("w"), "k").count().select("w.start", "w.end", "k", "count")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture(scope="module")
def demo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("demo")
    Corpus(str(folder), minutes=0.4).write()
    os.remove(folder / "manifest.json")
    return str(folder)


@pytest.mark.parametrize(
    "arguments,expect",
    [
        (["level:error stats count() by source"], "checkout-api"), (["records", "status:502", "--limit", "2"], "upstream timeout"), (["patterns"], "<num>"), (["top", "status"], "502"), (["fields"], "latency_ms"), (["sources"], "nginx"),
        (["histogram", "--buckets", "5"], "bucket"), (["sql", "SELECT count(*) AS n FROM logs"], "n"), (["diff", "--before", "before:14:19:45", "--after", "after:14:19:45"], "surprise"), (["records", "--context", "1", "status:502"], "hit"), (["records", "--fold"], "repeats"),
    ],
)
def test_commands(spark, demo, tmp_path_factory, capsys, arguments, expect):
    command = arguments[:1] if arguments[0] in ("records", "patterns", "top", "fields", "sources", "histogram", "sql", "diff") else []
    cache = str(tmp_path_factory.getbasetemp() / "cli-cache")
    assert cli.main([*command, demo, *arguments[len(command) :], "--cache-dir", cache]) == 0
    assert expect in capsys.readouterr().out


def test_errors_and_workspace(spark, demo, tmp_path, capsys):
    assert cli.main([demo, "stauts:1", "--no-cache"]) == 2 and "status" in capsys.readouterr().err
    own = ["--config-dir", str(tmp_path)]
    assert cli.main(["subscribe", demo, "--label", "d", *own]) == 0
    space = Workspace(str(tmp_path))
    assert space.active() == [demo] and space.remove(demo) and space.active() == [] and space.forget(demo) and not space.forget(demo)
    assert [a["action"] for a in space.audit()] == ["subscribe", "unsubscribe", "forget"]


def test_http(spark, eleven, tmp_path):
    with server(eleven, space=Workspace(str(tmp_path)), root=str(tmp_path)) as http:
        Thread(target=http.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{http.server_port}"

        def ask(path, body=None, **headers):
            data = json.dumps(body).encode() if body is not None else None
            try:
                with urllib.request.urlopen(urllib.request.Request(base + path, data, headers)) as r:
                    return r.status, json.load(r)
            except urllib.error.HTTPError as e:
                return e.code, json.load(e)

        assert ask("/api/health") == (200, {"records": 11})
        assert "status" in ask("/api/schema")[1]["fields"]
        assert ask("/api/query", {"filter": "level:error", "limit": 2})[1]["total"] == 3
        assert "status:999" in ask("/api/query", {"filter": "status:999"})[1]["explanation"]
        assert ask("/api/query", {"sql": "SELECT 1 AS x"})[1]["rows"] == [[1]]
        assert ask("/api/query", {"nope": 1})[0] == 400 and ask("/api/none")[0] == 404
        assert ask("/api/health", Host="evil.example")[0] == 403
        assert ask("/api/top?field=status&limit=1")[1]["rows"][0][:2] == ["200", 3]
        assert ask("/api/trace?id=a91c40f2")[1]["summary"]["hops"] == 2
        assert ask("/api/histogram", {"filter": "level:error", "buckets": 4})[0] == 200
        assert ask("/api/patterns")[1]["records"] == 11 and ask("/api/browse?path=..")[0] == 404
        http.shutdown()
