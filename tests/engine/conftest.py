import json

import pytest
from pyspark.sql import Row

from tributary.model import LOGS_SCHEMA
from tributary.plans.session import Logs


@pytest.fixture(scope="session")
def make_logs(spark):
    """Logs of (ts, level, message, source, file, format, fields[, parsed]) rows; ts is a clock time of one day or None."""

    def make(rows, **kw):
        from datetime import datetime

        from tributary.functions.template import template_id, template_of
        from tributary.sources.reader import kind_of, value_text

        out = []
        for n, (ts, level, message, source, file, fmt, fields, *rest) in enumerate(rows, 1):
            pattern = template_of(message)
            moment = None if ts is None else datetime.fromisoformat(ts if "-" in ts else f"2026-08-13T{ts}")
            out.append((n, moment, ts is not None, level, message, source, file, fmt, n, rest[0] if rest else True, message, json.dumps(fields) if fields else None, {k: value_text(v) for k, v in fields.items()}, {k: kind_of(v) for k, v in fields.items()}, pattern, template_id(pattern)))
        return Logs(spark.createDataFrame(out, LOGS_SCHEMA), **kw)

    return make


@pytest.fixture(scope="session")
def eleven(make_logs):
    """Eleven records with a missing level, an unknown level, a missing time and a rotated file."""
    c, n, a, p = ("checkout-api", "logs/checkout-api.log", "jsonl"), ("nginx", "logs/access.log", "nginx"), ("auth-svc", "logs/auth-svc.log", "logfmt"), ("postgres", "logs/postgresql.log", "postgres")
    return make_logs(
        [
            ("14:00:00", "info", "request completed", *c, {"status": 200, "latency_ms": 42, "trace_id": "a91c40f2", "region": "eu-west-1"}),
            ("14:01:00", "warn", "rate limited by upstream", *c, {"status": 429, "latency_ms": 310, "trace_id": "b7712def"}),
            ("14:02:00", "error", "upstream timeout contacting payments", *c, {"status": 502, "latency_ms": 3400, "trace_id": "a91c40f2", "region": "us-east-1"}),
            ("14:03:00", "fatal", "FATAL: remaining connection slots are reserved", *p, {"pid": 20044}),
            ("14:04:00", "debug", "evaluating feature flag", *c, {"flag": "new_checkout_flow"}),
            ("14:05:00", "info", "GET /api/checkout", *n, {"status": 200, "path": "/api/checkout"}),
            ("13:00:00", "info", "GET /healthz", "nginx", "logs/access.log.1", "nginx", {"status": 200, "path": "/healthz"}),
            ("14:06:00", None, "no level on this record", *a, {"issuer": "auth.internal"}),
            ("14:07:00", "audit", "key rotated", *a, {"actor": "svc-rotate"}),
            (None, "error", "truncated line with no timestamp", *c, {}, False),
            ("14:08:00", "error", "Timeout waiting for lock", *p, {"pid": 20099}),
        ]
    )


def messages(logs, text):
    return {r.message for r in logs.matching(logs.plan(text)).collect()}


__all__ = ["Row", "messages"]
