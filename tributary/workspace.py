"""Remembered paths, with an append-only record of what was done."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime, timezone


@dataclass
class Workspace:
    """Subscriptions in a folder of one's own."""

    folder: str

    @property
    def _paths(self) -> str:
        return os.path.join(self.folder, "subscriptions.json")

    @property
    def _audit(self) -> str:
        return os.path.join(self.folder, "audit.jsonl")

    def all(self) -> list[dict]:
        try:
            with open(self._paths) as f:
                return json.load(f)
        except (OSError, ValueError):
            return []

    def active(self) -> list[str]:
        return [s["path"] for s in self.all() if s["active"]]

    def _save(self, entries: list[dict], action: str, path: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self._paths + ".partial", "w") as f:
            json.dump(entries, f, indent=1)
        os.replace(self._paths + ".partial", self._paths)
        with open(self._audit, "a") as f:
            f.write(json.dumps({"at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "action": action, "path": path}) + "\n")

    def add(self, path: str, label: str = "") -> None:
        path = os.path.abspath(path)
        entries = [s for s in self.all() if s["path"] != path]
        self._save([*entries, {"path": path, "label": label, "active": True}], "subscribe", path)

    def remove(self, path: str) -> bool:
        path = os.path.abspath(path)
        entries = self.all()
        found = [s for s in entries if s["path"] == path and s["active"]]
        if found:
            self._save([s | {"active": s["active"] and s["path"] != path} for s in entries], "unsubscribe", path)
        return bool(found)

    def forget(self, path: str) -> bool:
        path = os.path.abspath(path)
        entries = self.all()
        kept = [s for s in entries if s["path"] != path]
        if len(kept) < len(entries):
            self._save(kept, "forget", path)
        return len(kept) < len(entries)

    def audit(self) -> list[dict]:
        try:
            with open(self._audit) as f:
                return [json.loads(line) for line in f]
        except OSError:
            return []
