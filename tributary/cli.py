"""Command line: ``python -m tributary.cli [command] paths... [filter]``."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from pyspark.sql import SparkSession

from tributary.dsl.syntax import DslError, parse
from tributary.functions.scratch import new_path
from tributary.operators import breakdown, investigate, records, stats
from tributary.plans.session import Logs
from tributary.plans.sql import query
from tributary.render import FORMATS, rendered
from tributary.sources.generate import Corpus
from tributary.sources.infer import infer_and_promote
from tributary.sources.store import Store
from tributary.sources.walk import walk_all
from tributary.workspace import Workspace

HOME = os.path.join(os.path.expanduser("~"), ".tributary")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tributary").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 4)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary", description=__doc__)
    shared = argparse.ArgumentParser(add_help=False)
    for name, kw in (
        ("--parser", {}), ("--format", {"choices": FORMATS, "default": "table"}), ("--limit", {"type": int, "default": records.DISPLAY_LIMIT}), ("--tz", {"default": "UTC"}),
        ("--source-tz", {"default": "UTC"}), ("--max-file-size", {"type": int}), ("--include", {"default": ""}), ("--exclude", {"default": ""}), ("--sort", {"choices": ("oldest", "newest"), "default": "oldest"}),
        ("--cache-dir", {"default": os.path.join(HOME, "cache")}), ("--config-dir", {"default": HOME}), ("--handoff", {"help": "write .md or .json"}), ("--redact", {"default": ""}),
    ):
        shared.add_argument(name, **kw)
    for name in ("--no-cache", "--relative-to-now", "-q", "--all"):
        shared.add_argument(name, action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    for name, extra in (("records", ("--context", "--fold", "--follow")), ("sql", ()), ("sources", ()), ("histogram", ("--buckets",)), ("patterns", ("--new-since",)), ("trace", ("--field",)), ("top", ()), ("fields", ()), ("diff", ("--before", "--after")), ("serve", ("--addr",)), ("cache", ()), ("subscribe", ("--label",)), ("unsubscribe", ("--forget",)), ("subscriptions", ("--audit",)), ("demo", ("--minutes",))):
        one = commands.add_parser(name, parents=[shared])
        one.add_argument("arguments", nargs="*")
        for flag in extra:
            one.add_argument(flag, **({"action": "store_true"} if flag in ("--fold", "--follow", "--forget", "--audit") else {"type": int} if flag in ("--context", "--buckets") else {}))
    return p


def paths_and_rest(arguments: list[str], space: Workspace) -> tuple[list[str], list[str]]:
    paths = [a for a in arguments if a == "-" or os.path.exists(a)]
    return paths or space.active() or ["."], [a for a in arguments if a not in paths]


def opened(spark: SparkSession, paths: list[str], a: argparse.Namespace) -> Logs:
    from datetime import datetime, timezone

    from tributary.dsl.timeexpr import micros
    from tributary.sources.datasource import read_files_and_stdin, read_logs

    now = micros(datetime.now(timezone.utc)) if a.relative_to_now else None
    own = {k: v for k, v in (("parser", a.parser), ("sourceTz", a.source_tz if a.source_tz != "UTC" else None), ("include", a.include or None), ("exclude", a.exclude or None), ("maxFileSize", a.max_file_size)) if v}
    if "-" in paths:
        table, promotions = infer_and_promote(read_files_and_stdin(spark, paths, **own))
        return Logs(table, promotions, a.tz, now)
    if not walk_all(paths).files:
        raise DslError(f"no log files in {', '.join(paths)}")
    if a.no_cache:
        table, promotions = infer_and_promote(read_logs(spark, paths, **own))
        return Logs(table.persist(), promotions, a.tz, now)
    logs = Store(spark, a.cache_dir).open(paths, a.tz, **own)
    logs.now = now
    return logs


def show(a: argparse.Namespace, df) -> None:
    print(rendered(df.columns, df.collect(), a.format, a.tz))


def note(a: argparse.Namespace, *lines: str) -> None:
    if not a.q:
        for line in lines:
            print(line, file=sys.stderr)


def execute(a: argparse.Namespace) -> int:
    space = Workspace(a.config_dir)
    if a.command in ("subscribe", "unsubscribe"):
        for path in a.arguments:
            space.add(path, a.label or "") if a.command == "subscribe" else (space.forget if a.forget else space.remove)(path)
        return 0
    if a.command == "subscriptions":
        entries = space.audit() if a.audit else space.all()
        print(rendered(list(entries[0]) if entries else ["path"], [list(e.values()) for e in entries], a.format))
        return 0
    if a.command == "demo":
        folder = a.arguments[0] if a.arguments else os.path.join(tempfile.gettempdir(), "tributary-demo")
        Corpus(folder, minutes=float(a.minutes or 2)).write()
        print(folder)
        return 0
    spark = session()
    if a.command == "cache":
        store = Store(spark, a.cache_dir)
        if a.arguments == ["clear"]:
            store.clear()
        print(rendered(["key", "bytes", "used"], store.entries(), a.format))
        return 0
    text_first = a.command in ("sql", "trace", "top")
    paths, rest = paths_and_rest(a.arguments, space)
    head = rest.pop(0) if text_first and rest else ""
    text = " ".join(rest)
    if a.command == "serve":
        from tributary.server import serve

        serve(opened(spark, paths, a), a.addr or "127.0.0.1:7700", space)
        return 0
    if a.command == "records" and a.follow:
        from tributary.streaming.follow import Follower

        if paths == ["-"]:
            from tributary.streaming.follow import stream_pipe

            stream_pipe(spark, sys.stdin.buffer, text, lambda rows: print(rendered(list(records.LISTED), [[r[c] for c in records.LISTED] for r in rows], a.format, a.tz), flush=True), a.parser, a.source_tz)
            return 0
        emit = lambda rows: print(rendered(list(records.LISTED), [[r[c] for c in records.LISTED] for r in rows], a.format, a.tz), flush=True)
        Follower(spark, paths).records(text, new_path(spark, "follow"), emit).awaitTermination()
        return 0
    logs = opened(spark, paths, a)
    limit = -1 if a.all else (0 if a.limit == records.DISPLAY_LIMIT else a.limit)
    if a.command == "records":
        plan = logs.plan(text, aggregate=True)
        note(a, *plan.notes)
        if plan.stats:
            found = stats.disclosed(logs, plan)
            note(a, f"{found.grouped} of {found.matched} records grouped", *found.notes)
            show(a, stats.stats(logs, plan))
        elif a.handoff:
            out = investigate.handoff(logs, plan, tuple(x for x in a.redact.split(",") if x))
            out.write(a.handoff)
        elif a.context is not None:
            show(a, records.context(logs, plan, a.context))
        elif a.fold:
            show(a, records.fold(logs, plan))
        else:
            page = records.page(logs, plan, a.limit, newest=a.sort == "newest", columns=(*records.LISTED, "raw") if a.format == "raw" else records.LISTED)
            print(rendered(list(page.rows[0].asDict()) if page.rows else list(records.LISTED), page.rows, a.format, a.tz))
            note(a, f"{len(page.rows)} of {page.total} records" if page.truncated else f"{len(page.rows)} records")
            if not page.rows:
                note(a, investigate.why_empty(logs, plan))
    elif a.command == "sql":
        out = query(logs, head, a.limit)
        print(rendered(out.columns, out.rows, a.format, a.tz))
        note(a, f"{len(out.rows)} of {out.total} rows") if out.truncated else None
    elif a.command == "diff":
        plans = [logs.plan(f"{text} {w}".strip()) for w in (a.before, a.after)]
        show(a, investigate.diff(logs, *plans, limit))
    else:
        plan = logs.plan(text, operator=a.command)
        show(a, {
            "sources": lambda: breakdown.sources(logs), "histogram": lambda: breakdown.histogram(logs, plan, a.buckets or breakdown.BUCKETS), "patterns": lambda: breakdown.patterns(logs, plan, limit, a.new_since),
            "trace": lambda: investigate.trace(logs, plan, head, a.field), "top": lambda: breakdown.top(logs, plan, head, limit), "fields": lambda: breakdown.fields(logs, plan, limit),
        }[a.command]())
    return 0


def main(arguments: list[str] | None = None) -> int:
    arguments = list(sys.argv[1:] if arguments is None else arguments)
    names = {"records", "sql", "sources", "histogram", "hist", "patterns", "trace", "top", "fields", "schema", "diff", "compare", "serve", "cache", "subscribe", "unsubscribe", "subscriptions", "demo", "-h", "--help"}
    if not arguments or arguments[0] not in names:
        arguments.insert(0, "records")
    arguments[0] = {"hist": "histogram", "schema": "fields", "compare": "diff"}.get(arguments[0], arguments[0])
    a, loose = options().parse_known_args(arguments)
    a.arguments += loose  # filter terms between options, and negated ones
    try:
        return execute(a)
    except DslError as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())


__all__ = ["main", "parse"]
