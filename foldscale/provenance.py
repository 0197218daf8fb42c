"""Run lineage: an SQLite store of runs and events, and an append-only JSON-lines log."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from datetime import datetime, timezone

# The store's tables.
_TABLES = """
CREATE TABLE IF NOT EXISTS runs (run_id TEXT PRIMARY KEY, command TEXT NOT NULL, started_at TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS events (id INTEGER PRIMARY KEY AUTOINCREMENT, run_id TEXT NOT NULL, event TEXT NOT NULL,
  timestamp TEXT NOT NULL, structure_id TEXT, details_json TEXT NOT NULL);
"""


class Recorder:
    def __init__(self, command: str, sqlite: str | None = None, jsonl: str | None = None):
        self.run_id, self.jsonl = str(uuid.uuid4()), jsonl
        for path in filter(None, (sqlite, jsonl)):
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.store = sqlite3.connect(sqlite) if sqlite else None
        if self.store:
            self.store.executescript(_TABLES)
            self.store.execute("INSERT INTO runs VALUES (?, ?, datetime('now'))", (self.run_id, command))
            self.store.commit()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.store:
            self.store.close()

    def record(self, event: str, structure_id: str | None = None, **details) -> None:
        now = datetime.now(timezone.utc).isoformat()
        if self.store:
            self.store.execute(
                "INSERT INTO events (run_id, event, timestamp, structure_id, details_json) VALUES (?, ?, ?, ?, ?)",
                (self.run_id, event, now, structure_id, json.dumps(details)),
            )
            self.store.commit()
        if self.jsonl:
            with open(self.jsonl, "a") as f:
                f.write(json.dumps({"event": event, "timestamp": now, "structure_id": structure_id, "details": details}) + "\n")


def runs(sqlite: str) -> list[str]:
    """Runs as tab-separated lines, the newest first."""
    with sqlite3.connect(sqlite) as store:
        return ["\t".join(r) for r in store.execute("SELECT run_id, command, started_at FROM runs ORDER BY started_at DESC")]
