"""What the driver keeps: a catalogue of repositories with a revision, signed cursors, validated names, ordered plug-ins.

A catalogue has a row a repository, so it is a file, not a table.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import re
import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class CursorError(ValueError):
    """A cursor that was tampered with, has expired, or belongs to another request."""


@dataclass(frozen=True)
class Cursors:
    """Opaque cursors: JSON of operation, filter digest, expiry and payload, signed with a key."""

    key: bytes
    seconds: int = 900

    def encode(self, operation: str, filters: Mapping, payload, now: float | None = None) -> str:
        until = int((time.time() if now is None else now) + self.seconds)
        body = json.dumps([operation, filter_digest(filters), until, payload], separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(hmac.digest(self.key, body, "sha256") + body).decode().rstrip("=")

    def decode(self, cursor: str, operation: str, filters: Mapping, now: float | None = None):
        """The payload; an error unless signature, operation, filters and expiry hold."""
        try:
            data = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
        except ValueError as e:
            raise CursorError("not a cursor") from e
        mark, body = data[:32], data[32:]
        if not hmac.compare_digest(mark, hmac.digest(self.key, body, "sha256")):
            raise CursorError("the signature doesn't match")
        of, digest, until, payload = json.loads(body)
        if of != operation or digest != filter_digest(filters):
            raise CursorError("the cursor belongs to another request")
        if until < (time.time() if now is None else now):
            raise CursorError("the cursor has expired")
        return payload


def filter_digest(filters: Mapping) -> str:
    """The same for equal filters in any order; lists count as sets."""
    plain = {k: sorted(v, key=str) if isinstance(v, list | tuple | set) else v for k, v in filters.items() if v is not None}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def group_name(name: str) -> str:
    """A name that is safe as part of a path: letters, digits, - and _."""
    if not name or not all(c.isalnum() or c in "-_" for c in name):
        raise ValueError(f"invalid group name {name!r}")
    return name


@dataclass
class Catalogue:
    """Repositories in a JSON file: {revision, repos: {name: entry}}; updates hold a lock file and raise the revision."""

    path: str

    def load(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"revision": 0, "repos": {}}

    @contextmanager
    def _locked(self, patience: float = 10.0):
        lock, until = self.path + ".lock", time.monotonic() + patience
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.monotonic() > until:
                    raise TimeoutError(f"{lock} is held") from None
                time.sleep(0.02)
        try:
            yield
        finally:
            os.unlink(lock)

    def update(self, change: Callable[[dict], None]) -> dict:
        with self._locked():
            state = self.load()
            change(state["repos"])
            state["revision"] += 1
            temporary = f"{self.path}.{os.getpid()}"
            with open(temporary, "w", encoding="utf-8") as f:
                json.dump(state, f, sort_keys=True)
            os.replace(temporary, self.path)
            return state

    def upsert(self, name: str, **entry) -> dict:
        return self.update(lambda repos: repos.update({name: {**repos.get(name, {}), **entry}}))

    def page(self, cursors: Cursors, cursor: str | None = None, limit: int = 50, prefix: str = "", group: str | None = None) -> dict:
        """Repositories by name from after the cursor, those of a prefix or group only, and the next page's cursor."""
        filters = {"prefix": prefix, "group": group, "limit": limit}
        after = "" if cursor is None else cursors.decode(cursor, "repos", filters)
        wanted = lambda n, e: n > after and n.startswith(prefix) and (group is None or group in e.get("groups", ()))
        state = self.load()
        rows = sorted((n, e) for n, e in state["repos"].items() if wanted(n, e))
        taken = rows[:limit]
        more = cursors.encode("repos", filters, taken[-1][0]) if len(rows) > limit else None
        return {"revision": state["revision"], "repos": [{"name": n, **e} for n, e in taken], "next": more}


@dataclass
class Plugins:
    """Named callables in an order, each behind a switch: resolvers of languages, augmentors of graphs, strategies."""

    found: list[tuple[int, str, Callable, Callable[[Mapping], bool]]] = field(default_factory=list)

    def add(self, order: int, name: str, run: Callable, when: Callable[[Mapping], bool] = lambda options: True) -> None:
        if any(n == name for _, n, _, _ in self.found):
            raise ValueError(f"{name!r} is there already")
        self.found.append((order, name, run, when))
        self.found.sort(key=lambda p: p[:2])

    def active(self, options: Mapping) -> list[str]:
        return [n for _, n, _, when in self.found if when(options)]

    def augment(self, nodes: DataFrame, edges: DataFrame, options: Mapping = {}, observe: Callable[[str, str], None] = lambda name, phase: None) -> tuple[DataFrame, DataFrame]:
        """Each active plug-in gets (nodes, edges) and returns more of both; ``observe`` hears of begin and end."""
        for _, name, run, when in self.found:
            if when(options):
                observe(name, "begin")
                more_nodes, more_edges = run(nodes, edges)
                nodes, edges = nodes.unionByName(more_nodes, allowMissingColumns=True), edges.unionByName(more_edges, allowMissingColumns=True)
                observe(name, "end")
        return nodes, edges


def changed_files_of(diff: str) -> list[tuple[str, str]]:
    """(path, change) of the output of ``git diff --name-status``: added, modified or removed; a rename removes one path and adds another."""
    out, names = [], {"A": "added", "M": "modified", "D": "removed", "T": "modified", "C": "added"}
    for line in diff.splitlines():
        state, *paths = line.split("\t")
        if state[:1] == "R" and len(paths) == 2:
            out += [(paths[0], "removed"), (paths[1], "added")]
        elif paths and state[:1] in names:
            out.append((paths[-1], names[state[:1]]))
    return out


def stages_to_run(saved: Mapping[str, str], current: Mapping[str, str], needs: Mapping[str, Sequence[str]]) -> list[str]:
    """Stages whose fingerprint changed, and those that need one of them, in the order of ``current``."""
    run: list[str] = []
    for name in current:
        if saved.get(name) != current[name] or any(n in run for n in needs.get(name, ())):
            run.append(name)
    return run


class Jobs:
    """Index jobs by repository: one at a time each, started in a Spark job group so that it can be cancelled."""

    def __init__(self, spark):
        self.spark, self.state = spark, {}

    def run(self, repo: str, work: Callable[[], object]) -> str:
        """Run a job unless one of the repository is running; its last state."""
        if self.state.get(repo) == "running":
            return "running"
        self.state[repo] = "running"
        self.spark.sparkContext.setJobGroup(_group(repo), f"index {repo}", interruptOnCancel=True)
        try:
            work()
            self.state[repo] = "done" if self.state[repo] == "running" else self.state[repo]
        except Exception:
            if self.state[repo] != "cancelled":
                self.state[repo] = "failed"
                raise
        return self.state[repo]

    def cancel(self, repo: str) -> bool:
        if self.state.get(repo) != "running":
            return False
        self.state[repo] = "cancelled"
        self.spark.sparkContext.cancelJobGroup(_group(repo))
        return True

    def status(self, repo: str) -> str:
        return self.state.get(repo, "unknown")


def _group(repo: str) -> str:
    return "index-" + re.sub(r"[^A-Za-z0-9_-]", "_", repo)
