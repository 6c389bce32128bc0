"""What is known of change-sets between commands: a small SQL database, SQLite or (if its driver is there) Postgres."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..errors import ConfigError


@dataclass
class Pin:
    table: str
    tag: str
    snapshot: int


@dataclass
class ChangeSet:
    id: str
    branch: str
    base: str = "main"
    source: str = "explicit"
    git_branch: str = ""
    base_commit: str | None = None
    created: float = field(default_factory=time.time)
    scope: list[str] = field(default_factory=list)
    hashes: dict[str, str] = field(default_factory=dict)
    #: Snapshot ids that a model's last build read, by reference: part of the rule by which it is skipped.
    read: dict[str, dict[str, int]] = field(default_factory=dict)
    pins: dict[str, Pin] = field(default_factory=dict)
    #: Heads of the base when the branch was made, by table; None where the base had nothing.
    base_heads: dict[str, int | None] = field(default_factory=dict)
    last_run: str | None = None


class StateStore:
    """Three tables of JSON rows: change-sets, runs, promotions. Every write is one transaction."""

    TABLES = ("change_sets", "runs", "promotions")

    def __init__(self, store: str = "local", path: Path | None = None, uri: str | None = None):
        self.lock = threading.RLock()
        if store == "postgres":
            try:
                import psycopg
            except ImportError as e:
                raise ConfigError("state.store postgres needs the psycopg package") from e
            self.mark, self.db = "%s", psycopg.connect(uri, autocommit=False)
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            self.mark, self.db = "?", sqlite3.connect(path, check_same_thread=False, timeout=30)
            self.db.execute("PRAGMA journal_mode=WAL")
        with self._write() as cur:
            for t in self.TABLES:
                cur.execute(f"CREATE TABLE IF NOT EXISTS {t} (id TEXT PRIMARY KEY, body TEXT NOT NULL)")

    @contextmanager
    def _write(self):
        with self.lock:
            cur = self.db.cursor()
            try:
                yield cur
                self.db.commit()
            except BaseException:
                self.db.rollback()
                raise
            finally:
                cur.close()

    def put(self, table: str, key: str, body: dict) -> None:
        m = self.mark
        with self._write() as cur:
            cur.execute(f"INSERT INTO {table} (id, body) VALUES ({m}, {m}) ON CONFLICT (id) DO UPDATE SET body = excluded.body", (key, json.dumps(body)))

    def get(self, table: str, key: str) -> dict | None:
        with self._write() as cur:
            cur.execute(f"SELECT body FROM {table} WHERE id = {self.mark}", (key,))
            row = cur.fetchone()
        return json.loads(row[0]) if row else None

    def all(self, table: str) -> dict[str, dict]:
        with self._write() as cur:
            cur.execute(f"SELECT id, body FROM {table} ORDER BY id")
            return {k: json.loads(v) for k, v in cur.fetchall()}

    def delete(self, table: str, key: str) -> None:
        with self._write() as cur:
            cur.execute(f"DELETE FROM {table} WHERE id = {self.mark}", (key,))

    # -- change-sets

    @staticmethod
    def _change_set(body: dict) -> ChangeSet:
        return ChangeSet(**{**body, "pins": {k: Pin(**p) for k, p in body["pins"].items()}})

    def save(self, c: ChangeSet) -> None:
        with self.lock:
            self.put("change_sets", c.id, asdict(c))

    def find(self, change_set: str, branch: str | None = None) -> ChangeSet | None:
        body = self.get("change_sets", change_set)
        if body is None and branch is not None:
            body = next((b for b in self.all("change_sets").values() if b["branch"] == branch), None)
        return self._change_set(body) if body else None

    def change_sets(self) -> list[ChangeSet]:
        return [self._change_set(b) for b in self.all("change_sets").values()]

    def close(self) -> None:
        self.db.close()
