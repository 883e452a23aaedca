"""A thin local HTTP layer over the same operators: JSON, and server-sent events for the tail."""

from __future__ import annotations

import json
import os
import queue
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from tributary.dsl.syntax import DslError
from tributary.functions.scratch import new_path
from tributary.operators import breakdown, investigate, records
from tributary.plans.session import Logs
from tributary.plans.sql import query
from tributary.render import localised
from tributary.workspace import Workspace

MOST_BODY = 1 << 20
HEARTBEAT = 20
LOCAL = ("127.0.0.1", "localhost", "[::1]", "::1")


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def rows_of(df, zone: str) -> dict:
    return {"columns": df.columns, "rows": [[localised(v, zone) for v in r] for r in df.collect()]}


class Api:
    """The routes, as functions of the request's parameters or JSON body."""

    def __init__(self, logs: Logs, space: Workspace | None = None, root: str = "/"):
        self.logs, self.space, self.root = logs, space, root
        self.get: dict[str, Callable[[dict], Any]] = {
            "/api/schema": self.schema, "/api/sources": lambda q: rows_of(breakdown.sources(self.logs), self.logs.zone), "/api/patterns": self.patterns, "/api/trace": self.trace,
            "/api/trace-field": lambda q: {"field": investigate.detect_trace_field(self.logs, q["id"])}, "/api/top": self.top, "/api/health": lambda q: {"records": self.logs.table.count()},
            "/api/browse": self.browse, "/api/subscriptions": lambda q: self.space.all() if self.space else [], "/api/audit": lambda q: self.space.audit() if self.space else [],
        }
        self.post: dict[str, tuple[Callable[[dict], Any], set]] = {
            "/api/query": (self.query, {"filter", "sql", "limit", "offset", "sort", "columns"}), "/api/histogram": (self.histogram, {"filter", "buckets", "interval_ms"}),
            "/api/subscribe": (lambda b: self.space.add(b["path"], b.get("label", "")), {"path", "label"}), "/api/unsubscribe": (lambda b: self.space.remove(b["path"]), {"path"}),
        }

    def schema(self, _: dict) -> dict:
        first, last, undated = self.logs.span
        return {"fields": self.logs.schema.names, "sources": list(self.logs.schema.sources), "promoted": [p.__dict__ for p in self.logs.promotions], "first_us": first, "last_us": last, "undated": undated}

    def query(self, body: dict) -> dict:
        limit = int(body.get("limit") or records.DISPLAY_LIMIT)
        if body.get("sql"):
            out = query(self.logs, body["sql"], limit)
            return {"columns": out.columns, "rows": [[localised(v, self.logs.zone) for v in r] for r in out.rows], "truncated": out.truncated, "total": out.total}
        plan = self.logs.plan(body.get("filter", ""))
        columns = tuple(body.get("columns") or records.LISTED)
        page = records.page(self.logs, plan, limit, offset=int(body.get("offset") or 0), newest=body.get("sort") == "newest", columns=columns)
        out = {"columns": list(columns), "rows": [[localised(v, self.logs.zone) for v in r] for r in page.rows], "truncated": page.truncated, "total": page.total, "notes": plan.notes}
        return out if page.rows else out | {"explanation": investigate.why_empty(self.logs, plan)}

    def histogram(self, body: dict) -> dict:
        width = int(body["interval_ms"]) * 1000 if body.get("interval_ms") else None
        return rows_of(breakdown.histogram(self.logs, self.logs.plan(body.get("filter", "")), int(body.get("buckets") or breakdown.BUCKETS), width), self.logs.zone)

    def patterns(self, q: dict) -> dict:
        plan = self.logs.plan(q.get("filter", ""))
        return rows_of(breakdown.patterns(self.logs, plan, int(q.get("limit", 0)), q.get("new_since")), self.logs.zone) | breakdown.pattern_totals(self.logs, plan).first().asDict()

    def trace(self, q: dict) -> dict:
        plan = self.logs.plan("")
        hops = investigate.trace(self.logs, plan, q["id"], q.get("field"))
        return rows_of(hops, self.logs.zone) | {"summary": investigate.trace_summary(hops).first().asDict(), "reach": rows_of(investigate.trace_reach(self.logs, plan, q["id"], q.get("field")), self.logs.zone)}

    def top(self, q: dict) -> dict:
        plan = self.logs.plan(q.get("filter", ""))
        return rows_of(breakdown.top(self.logs, plan, q["field"], int(q.get("limit", 0))), self.logs.zone) | breakdown.top_totals(self.logs, plan, q["field"]).first().asDict()

    def browse(self, q: dict) -> dict:
        path = os.path.realpath(os.path.join(self.root, q.get("path", "").lstrip("/")))
        if os.path.commonpath([path, os.path.realpath(self.root)]) != os.path.realpath(self.root) or not os.path.isdir(path):
            raise Refused(404, "no such folder")
        return {"path": path, "folders": sorted(e.name for e in os.scandir(path) if e.is_dir() and not e.name.startswith("."))}


def handler(api: Api, hub=None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: Any) -> None:
            return None

        def answer(self, status: int, value: Any) -> None:
            body = json.dumps(value, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def guarded(self, work: Callable[[], Any]) -> None:
            try:
                host = self.headers.get("Host", "").rsplit(":", 1)[0]
                if host not in LOCAL:
                    raise Refused(403, "only this machine may ask")
                self.answer(200, work())
            except Refused as no:
                self.answer(no.status, {"error": str(no)})
            except (DslError, KeyError, ValueError) as problem:
                self.answer(400, {"error": str(problem)})

        def do_GET(self) -> None:
            where = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(where.query).items()}
            if where.path == "/api/tail" and hub is not None:
                return self.tail(q.get("filter", ""))
            work = api.get.get(where.path)
            return self.guarded((lambda: work(q)) if work else self.missing)

        def do_POST(self) -> None:
            work, known = api.post.get(self.path, (None, set()))

            def run() -> Any:
                if work is None:
                    self.missing()
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BODY:
                    raise Refused(413, "the request is too large")
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict) or set(body) - known:
                    raise Refused(400, f"unknown keys; known are {', '.join(sorted(known))}")
                return work(body)

            self.guarded(run)

        def missing(self) -> Any:
            raise Refused(404, "no such route")

        def tail(self, text: str) -> None:
            try:
                one = hub.subscribe(text)
            except DslError as problem:
                return self.answer(400, {"error": str(problem)})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            try:
                while True:
                    try:
                        kind, value = one.events.get(timeout=HEARTBEAT)
                        data = json.dumps([r.asDict() for r in value] if kind == "records" else value, default=str)
                        self.wfile.write(f"event: {kind}\ndata: {data}\n\n".encode())
                    except queue.Empty:
                        self.wfile.write(b": still here\n\n")
                    self.wfile.flush()
            except OSError:
                hub.unsubscribe(one)

    return Handler


def server(logs: Logs, address: str = "127.0.0.1:0", space: Workspace | None = None, hub=None, root: str = "/") -> ThreadingHTTPServer:
    host, _, port = address.rpartition(":")
    if host not in LOCAL:
        raise ValueError("the server listens on this machine only")
    return ThreadingHTTPServer((host.strip("[]"), int(port)), handler(Api(logs, space, root), hub))


def serve(logs: Logs, address: str, space: Workspace | None = None, paths: list[str] | None = None) -> None:
    hub = None
    if paths:
        from tributary.streaming.follow import Follower, Hub

        hub = Hub(Follower(logs.table.sparkSession, paths, logs.promotions), new_path(logs.table.sparkSession, "tail"))
        hub.start()
    with server(logs, address, space, hub) as http:
        print(f"http://{address}")
        http.serve_forever()
