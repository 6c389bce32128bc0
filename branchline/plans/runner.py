"""Building the models of a scope on a branch."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import BranchlineError
from ..functions.sqlmeta import model_settings, spark_dialect
from ..naming import pin_tag, qualified
from ..sources.snapshots import Snapshot, SnapshotStore
from .graph import Graph, Model, Scope

Event = Callable[..., None]


def quiet(name: str, **payload) -> None:
    """An event callback that says nothing."""


@dataclass
class ModelResult:
    model: str
    status: str  # ran, skipped or error
    hash: str = ""
    snapshot: int | None = None
    rows: int = 0
    seconds: float = 0.0
    read: dict[str, int] = field(default_factory=dict)
    error: str | None = None


@dataclass
class Manifest:
    run_id: str
    change_set: str
    branch: str
    results: list[ModelResult] = field(default_factory=list)
    pins: dict[str, int] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Runner:
    spark: SparkSession
    store: SnapshotStore
    graph: Graph
    hashes: dict[str, str]
    namespace: str | None = None
    tag_prefix: str = "branchline_pin__"
    pin_inputs: bool = True
    #: Models of one level that are built at once.
    parallel: int = 4
    #: Called with the session of every model, to register functions there.
    on_session: Callable[[SparkSession], None] | None = None

    def table(self, name: str) -> str:
        return qualified(self.namespace, name)

    def resolve(self, name: str, branch: str, base: str, in_scope: bool) -> Snapshot:
        """What a reference reads: the branch if the run builds it, else its pin, else the base, else main."""
        table = self.store.load(self.table(name))
        tried = [branch] if in_scope else [pin_tag(self.tag_prefix, branch, name), base, "main"]
        for ref in tried:
            if (found := table.head(ref)) is not None:
                return found
        raise BranchlineError(f"{table.name}: no {' or '.join(tried)} to read")

    def prepare(self, scope: Scope, branch: str, base: str, repin: bool) -> dict[str, int]:
        """Branches for the tables of the scope that exist, and pins for what it reads; returns the pinned snapshots."""
        for name in scope.models:
            if branch != base and self.store.exists(self.table(name)):
                self.store.create_branch(self.table(name), branch, base)
        pins = {}
        for name in scope.pinned:
            if not self.store.exists(self.table(name)):
                raise BranchlineError(f"{self.table(name)}: no such table")
            table, tag = self.store.load(self.table(name)), pin_tag(self.tag_prefix, branch, name)
            head = table.head(base) or table.head("main")
            if head is None:
                raise BranchlineError(f"{table.name}: nothing to pin")
            if self.pin_inputs and (repin or tag not in table.refs):
                self.store.pin(table.name, tag, head.id)
                pins[name] = head.id
            else:
                pins[name] = table.refs[tag].snapshot if tag in table.refs else head.id
        return pins

    def bind(self, model: Model, read: dict[str, Snapshot]) -> DataFrame:
        """The model's rows, not computed yet: its inputs are views of their own names in a session of its own."""
        session = self.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
            session.conf.set(key, self.spark.conf.get(key))
        for key, value in model_settings().items():
            session.conf.set(key, value)
        if self.on_session:
            self.on_session(session)
        store = self.store.on(session)
        sql = model.sql
        for i, (name, snapshot) in enumerate(sorted(read.items())):
            view = name if "." not in name else f"_input_{i}"
            store.read_snapshot(snapshot).createOrReplaceTempView(f"`{view}`")
        views = {name: f"_input_{i}" for i, name in enumerate(sorted(read))}
        sql = spark_dialect(sql)
        # names with dots are replaced in place, last first, and keep their last part as alias where they have none
        for ref in sorted((r for r in model.refs if len(r.parts) > 1), key=lambda r: -r.start):
            key = next((k for k in (ref.name, ref.parts[-1]) if k in read), None)
            if key is None or ref.start < 0:
                continue
            aliased = sql[ref.end :].lstrip()
            has_alias = bool(aliased) and (aliased[0] in '`"' or aliased[0].isalpha()) and aliased.split(None, 1)[0].lower() not in AFTER_TABLE
            view = key if "." not in key else views[key]
            sql = sql[: ref.start] + f"`{view}`" + ("" if has_alias else f" AS `{ref.parts[-1]}`") + sql[ref.end :]
        return session.sql(sql)

    def build(self, name: str, scope: Scope, branch: str, base: str, summary: dict[str, str]) -> ModelResult:
        began, model = time.time(), self.graph.models[name]
        inside = set(scope.models)
        read = {r: self.resolve(r, branch, base, r in inside) for r in (*model.parents, *model.inputs)}
        made = self.store.overwrite(self.table(name), self.bind(model, read), branch, {"branchline.model": name, "branchline.ast_hash": self.hashes[name], "branchline.branch": branch, **summary})
        return ModelResult(name, "ran", self.hashes[name], made.id, made.records, round(time.time() - began, 3), {k: s.id for k, s in read.items()})

    def run(self, scope: Scope, branch: str, base: str, known: dict[str, str], known_read: dict[str, dict[str, int]], change_set: str = "", repin: bool = False, never_skip: frozenset[str] = frozenset(), on_event: Event = quiet, on_model: Callable[[ModelResult], None] = lambda r: None) -> Manifest:
        """Level by level, the models of a level at once. A model is skipped if its SQL and all snapshots it reads are as at
        its last build and none of its parents was built in this run. The first failure ends the run after its level; what
        was built stays recorded."""
        manifest = Manifest(secrets.token_hex(6), change_set, branch, pins=self.prepare(scope, branch, base, repin))
        summary = {"branchline.run_id": manifest.run_id, "branchline.changeset": change_set}
        ran: set[str] = set()
        inside = set(scope.models)

        def one(name: str) -> ModelResult:
            model = self.graph.models[name]
            on_event("run.model.begin", model=name)
            try:
                if name not in never_skip and known.get(name) == self.hashes[name] and not ran & set(model.parents) and self.store.head(self.table(name), branch) is not None:
                    read = {r: self.resolve(r, branch, base, r in inside).id for r in (*model.parents, *model.inputs)}
                    if read == known_read.get(name):
                        return ModelResult(name, "skipped", self.hashes[name], self.store.head(self.table(name), branch), read=read)
                return self.build(name, scope, branch, base, summary)
            except Exception as e:  # reported by the run, with the other models of the level
                return ModelResult(name, "error", error=str(e).strip().split("\n")[0])

        for level in scope.levels:
            if len(level) > 1 and self.parallel > 1:
                with ThreadPoolExecutor(self.parallel) as pool:
                    results = list(pool.map(one, level))
            else:
                results = list(map(one, level))
            for r in results:
                manifest.results.append(r)
                on_event("run.model.end", model=r.model, status=r.status, rows=r.rows, seconds=r.seconds)
                if r.status != "error":
                    on_model(r)
                if r.status == "ran":
                    ran.add(r.model)
            if any(r.status == "error" for r in results):
                break
        return manifest


#: Words that can follow a table name and are not its alias. Fixed values.
AFTER_TABLE = frozenset("where group order having limit join inner left right full cross natural semi anti on using union intersect except minus lateral pivot unpivot tablesample window qualify offset cluster distribute sort fetch version timestamp for".split())
