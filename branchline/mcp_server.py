"""The verbs as agent tools over the Model Context Protocol, where its package is installed."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from .errors import BranchlineError, ConfigError, Exit
from .project import Project

#: What an exit status is called in a tool's answer.
CODES = {Exit.ERROR: "error", Exit.CONFIG: "config", Exit.DRIFT: "drift", Exit.PROMOTE_BLOCKED: "promote_blocked", Exit.EMPTY_SCOPE: "empty_scope", Exit.LINEAGE: "lineage", Exit.MISSING_KEY: "missing_key"}


def new_change_set() -> str:
    return f"mcp-{secrets.token_hex(4)}"


def answered(call: Callable[[], dict]) -> dict:
    """The verb's envelope; a failure becomes one with an error code and what output there was."""
    try:
        return call()
    except BranchlineError as e:
        return {**(e.payload or {"ok": False, "data": {}, "errors": [str(e)]}), "error": {"code": CODES.get(e.status, "error"), "message": str(e)}}


def tools(project: Project) -> dict[str, Callable[..., dict]]:
    def run(models: str | None = None, depth: int | None = None, dry_run: bool = False, refresh: bool = False, force: bool = False, change_set: str | None = None) -> dict:
        """Build models on a branch; without a change-set a new one is made."""
        return answered(lambda: project.run(models, depth, dry_run, change_set or new_change_set(), refresh=refresh, force=force))

    def diff(change_set: str, tables: str | None = None, against: str = "base", schema_only: bool = False, rows: int | None = None) -> dict:
        """Rows and columns that a change-set would change."""
        return answered(lambda: project.diff(tables, against, schema_only, rows, change_set=change_set))

    def estimate(change_set: str, models: str | None = None) -> dict:
        """Rows and bytes that a run would read."""
        return answered(lambda: project.estimate(models, change_set=change_set))

    def status(change_set: str) -> dict:
        """Where a change-set stands, and whether production has moved."""
        return answered(lambda: project.status(change_set))

    def promote(change_set: str, ff_only: bool = False, dry_run: bool = False) -> dict:
        """Fast-forward production to a change-set's branch."""
        return answered(lambda: project.promote(ff_only, dry_run, change_set))

    def branch_create(name: str, from_ref: str | None = None, change_set: str | None = None) -> dict:
        """Make a data branch, for a change-set if one is named."""
        return answered(lambda: project.branch_create(name, from_ref, change_set))

    def branch_list() -> dict:
        """All change-sets and their data branches."""
        return answered(project.branch_list)

    def branch_show(name: str) -> dict:
        """Refs that carry a name."""
        return answered(lambda: project.branch_show(name))

    def branch_discard(name: str) -> dict:
        """Drop a data branch and its pins."""
        return answered(lambda: project.branch_discard(name))

    def gc(before_days: float | None = None, dry_run: bool = True) -> dict:
        """Drop branches past their time, pins that nothing holds and unreachable snapshots; by default only say which."""
        return answered(lambda: project.gc(before_days, dry_run))

    return {f.__name__: f for f in (run, diff, estimate, status, promote, branch_create, branch_list, branch_show, branch_discard, gc)}


def serve(project: Project) -> None:
    try:
        from mcp.server.fastmcp import FastMCP
    except ImportError as e:
        raise ConfigError("serving agent tools needs the mcp package") from e
    server = FastMCP("branchline")
    for f in tools(project).values():
        server.tool()(f)
    server.run()
