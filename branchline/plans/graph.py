"""The models of a project, how they depend on each other, and what an edit touches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import BranchlineError, LineageError
from ..functions.sqlmeta import SqlMeta, TableRef

KINDS = ("table", "view")


@dataclass(frozen=True)
class Model:
    name: str
    sql: str
    path: Path
    kind: str = "table"
    keys: tuple[str, ...] = ()
    refs: tuple[TableRef, ...] = ()
    parents: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()


def header(text: str) -> dict[str, str]:
    """``-- key: value`` lines before the first line of SQL; keys in lower case, blank lines allowed between."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if not line.startswith("--"):
            break
        if m := re.match(r"--\s*([A-Za-z_][\w-]*)\s*:\s*(.*)", line):
            out[m[1].lower()] = m[2].strip()
    return out


@dataclass
class Graph:
    models: dict[str, Model] = field(default_factory=dict)

    def children(self, name: str) -> list[str]:
        return sorted(m.name for m in self.models.values() if name in m.parents)

    def downstream(self, names: Iterable[str], depth: int | None = None) -> set[str]:
        """Everything that depends on ``names``, without them; ``depth`` steps at most."""
        names = set(names)
        seen, front, steps = set(names), set(names), 0
        while front and (depth is None or steps < depth):
            front = {c for n in front for c in self.children(n)} - seen
            seen |= front
            steps += 1
        return seen - names

    def order(self, names: Iterable[str]) -> list[list[str]]:
        """Levels of ``names``: a model comes after all its parents among them. A cycle is an error."""
        left, levels = set(names), []
        while left:
            ready = sorted(n for n in left if not left & set(self.models[n].parents) - {n})
            if not ready:
                raise LineageError(f"models depend on each other in a circle: {', '.join(sorted(left))}")
            levels.append(ready)
            left -= set(ready)
        return levels

    def edges(self, spark: SparkSession) -> DataFrame:
        """parent, child, kind (model or input)."""
        rows = [(p, m.name, kind) for m in self.models.values() for kind, of in (("model", m.parents), ("input", m.inputs)) for p in of]
        return spark.createDataFrame(rows, "parent string, child string, kind string")


def build_graph(folder: Path, meta: SqlMeta, namespace: str | None = None) -> Graph:
    """Every ``*.sql`` file below ``folder`` is a model, named by its header or its file."""
    found: dict[str, tuple[Model, list[TableRef]]] = {}
    for path in sorted(folder.rglob("*.sql")):
        text = path.read_text()
        head = header(text)
        name, kind = head.get("model") or path.stem, (head.get("kind") or "table").lower()
        if kind not in KINDS:
            raise LineageError(f"{path.name}: kind '{kind}' is not one of {', '.join(KINDS)}")
        if name in found:
            raise LineageError(f"two models are named {name}: {found[name][0].path} and {path}")
        keys = tuple(k.strip() for k in re.split("[,;]", head.get("key", "")) if k.strip())
        try:
            refs = meta.refs(text)
        except LineageError as e:
            raise LineageError(f"{path.name}: {e}") from e
        found[name] = (Model(name, text, path, kind, keys), refs)
    graph = Graph()
    for name, (model, refs) in found.items():
        parents, inputs = set(), set()
        for ref in refs:
            # a name in the project's own namespace may be written in full
            bare = ref.parts[-1] if len(ref.parts) == 1 or ".".join(ref.parts[:-1]) == namespace else None
            if bare in found:
                if bare != name:
                    parents.add(bare)
            else:
                inputs.add(ref.name)
        graph.models[name] = Model(name, model.sql, model.path, model.kind, model.keys, tuple(refs), tuple(sorted(parents)), tuple(sorted(inputs)))
    graph.order(graph.models)
    return graph


@dataclass(frozen=True)
class Scope:
    """What a run builds, in order, and what it reads from outside."""

    edited: tuple[str, ...]
    downstream: tuple[str, ...]
    beyond_depth: tuple[str, ...]
    pinned: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]

    @property
    def models(self) -> list[str]:
        return [n for level in self.levels for n in level]


def scope_of(graph: Graph, edited: Iterable[str], depth: int | None = None) -> Scope:
    edited = set(edited)
    if unknown := edited - graph.models.keys():
        raise BranchlineError(f"no such model: {', '.join(sorted(unknown))}")
    reached = graph.downstream(edited, depth)
    inside = edited | reached
    pinned = {p for n in inside for p in (*graph.models[n].parents, *graph.models[n].inputs)} - inside
    return Scope(tuple(sorted(edited)), tuple(sorted(reached)), tuple(sorted(graph.downstream(edited) - reached)), tuple(sorted(pinned)), tuple(map(tuple, graph.order(inside))))


def changed(graph: Graph, hashes: dict[str, str], baseline: dict[str, str]) -> list[str]:
    """Models whose hash is not the one of the baseline; those it does not know have not changed."""
    return sorted(n for n in graph.models if n in baseline and baseline[n] != hashes[n])


def stale(graph: Graph, newest: Callable[[str], int | None]) -> list[str]:
    """Models without a snapshot on main, or with an upstream whose main snapshot is strictly newer."""
    out = []
    for name, m in graph.models.items():
        own = newest(name)
        if own is None or any((t := newest(p)) is not None and t > own for p in (*m.parents, *m.inputs)):
            out.append(name)
    return sorted(out)
