"""A seeded corpus of log files with an incident in it, and some damage."""

from __future__ import annotations

import json
import os
import random
from dataclasses import dataclass, field
from datetime import datetime, timedelta

END = datetime(2026, 8, 13, 14, 20)
#: The incident's part of the span.
INCIDENT = (0.60, 0.72)
PATHS = ("/api/cart", "/api/checkout", "/api/session", "/api/orders/{}", "/healthz")
DAMAGE = ("cut", "nul", "newline", "blank", "foreign")


@dataclass
class Corpus:
    """Writes one file for each of six programs; what was written, line by line, goes to manifest.json."""

    folder: str
    seed: int = 42
    minutes: float = 10
    per_second: float = 20
    malformed: float = 0.015
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def write(self) -> dict[str, dict[str, int]]:
        rng = random.Random(self.seed)
        os.makedirs(self.folder, exist_ok=True)
        files: dict[str, list[str]] = {n: [] for n in ("checkout-api.log", "auth-svc.log", "access.log", "payment-worker.log", "postgresql.log", "syslog.log")}
        total = int(self.minutes * 60 * self.per_second)
        start = END - timedelta(minutes=self.minutes)
        for n in range(total):
            at = start + timedelta(seconds=n / self.per_second)
            bad = INCIDENT[0] <= n / total < INCIDENT[1] and rng.random() < 0.4
            name, line = rng.choice((self._checkout, self._auth, self._access, self._payment, self._postgres, self._host))(rng, at, bad)
            kind = rng.choice(DAMAGE) if rng.random() < self.malformed else None
            files[name].append(self._damaged(rng, line, kind))
            own = self.counts.setdefault(name, {"records": 0, "lines": 0, **{k: 0 for k in DAMAGE}})
            own["records"] += 1
            own["lines"] += files[name][-1].count("\n") + 1
            if kind:
                own[kind] += 1
        for name, lines in files.items():
            with open(os.path.join(self.folder, name), "w") as f:
                f.write("".join(x + "\n" for x in lines))
        with open(os.path.join(self.folder, "manifest.json"), "w") as f:
            json.dump({"seed": self.seed, "files": self.counts}, f, indent=1)
        return self.counts

    def _damaged(self, rng: random.Random, line: str, kind: str | None) -> str:
        at = rng.randint(1, max(1, len(line) - 1))
        return {None: line, "cut": line[:at], "nul": line[:at] + "\0\0" + line[at:], "newline": line[:at] + "\n" + line[at:], "blank": "", "foreign": "*** foreign line ***"}[kind]

    def _checkout(self, rng, at, bad):
        path = rng.choice(PATHS).format(rng.randint(1000, 9999))
        own = {"ts": at.isoformat() + "Z", "level": "error" if bad else "info", "msg": "upstream timeout contacting payments" if bad else "request completed", "path": path, "status": 502 if bad else 200, "latency_ms": rng.randint(3000, 5000) if bad else rng.randint(5, 300), "trace_id": f"{rng.getrandbits(32):08x}", "region": rng.choice(("eu-west-1", "us-east-1"))}
        return "checkout-api.log", json.dumps(own)

    def _auth(self, rng, at, bad):
        return "auth-svc.log", f'ts={at.isoformat()}Z level={"warn" if bad else "info"} msg="{"token near expiry" if bad else "token validated"}" issuer=auth.internal ttl_s={rng.randint(10, 3600)} user_id=u_{rng.randint(1000, 9999)}'

    def _access(self, rng, at, bad):
        return "access.log", f'10.0.{rng.randint(0, 3)}.{rng.randint(1, 254)} - - [{at:%d/%b/%Y:%H:%M:%S} +0000] "GET {rng.choice(PATHS).format(rng.randint(1000, 9999))} HTTP/1.1" {504 if bad else 200} {rng.randint(100, 9000)} "-" "curl/8.4.0"'

    def _payment(self, rng, at, bad):
        clock = f"{at:%Y-%m-%d %H:%M:%S}.{at.microsecond // 1000:03d}"
        if not bad:
            return "payment-worker.log", f"{clock} [worker-{rng.randint(1, 4)}] INFO c.a.p.ChargeHandler - charged order {rng.randint(1000, 9999)}"
        stack = "".join(f"\n\tat com.acme.pay.Step{k}.run(Step{k}.java:{rng.randint(10, 300)})" for k in range(rng.randint(2, 6)))
        return "payment-worker.log", f"{clock} [worker-1] ERROR c.a.p.ChargeHandler [trace_id={rng.getrandbits(32):08x}, attempt=1] - read timed out after 3000ms{stack}"

    def _postgres(self, rng, at, bad):
        clock = f"{at:%Y-%m-%d %H:%M:%S}.{at.microsecond // 1000:03d}"
        text = "FATAL: remaining connection slots are reserved" if bad else f"LOG: duration: {rng.random() * 300:.3f} ms"
        return "postgresql.log", f"{clock} UTC [{rng.randint(20000, 29999)}] {text}"

    def _host(self, rng, at, bad):
        return "syslog.log", f"<{11 if bad else 14}>1 {at.isoformat()}Z host-01 sshd {rng.randint(1000, 9999)} - - {'connection reset by peer' if bad else 'session opened for user deploy'}"
