"""The command line. Output is a short listing, or the envelope with --json; progress with --events."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import yaml

from . import config
from .envelope import Answer, event_writer
from .errors import BranchlineError, ConfigError, Exit
from .project import Project


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="branchline", description="Branch-first SQL transformation on Spark.")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--json", action="store_true", help="print the whole envelope")
    shared.add_argument("--project", default=".", help="project folder")
    shared.add_argument("--profile")
    shared.add_argument("--change-set")
    shared.add_argument("--branch", help="data branch, if not the change-set's own")
    verbs = top.add_subparsers(dest="verb", required=True)

    def add(name: str, about: str) -> argparse.ArgumentParser:
        return verbs.add_parser(name, help=about, parents=[shared])

    p = add("init", "write branchline.yml and a models folder")
    p.add_argument("--warehouse", default=".branchline/warehouse")
    p.add_argument("--catalog", default="parquet", choices=config.CATALOGS)
    p.add_argument("--uri", help="the catalog's address, where its type needs one")
    p.add_argument("--namespace")
    p.add_argument("--no-git", action="store_true")
    p = add("run", "build what has changed on a branch")
    p.add_argument("--models")
    p.add_argument("--depth", type=int)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--refresh", action="store_true", help="build what is older than its inputs")
    p.add_argument("--force", action="store_true")
    p.add_argument("--engine", default="spark", help="accepted; there is one engine")
    p.add_argument("--events", action="store_true")
    p = add("diff", "rows and columns that a branch would change")
    p.add_argument("--tables")
    p.add_argument("--against", default="base")
    p.add_argument("--schema-only", action="store_true")
    p.add_argument("--rows", type=int)
    p.add_argument("--full", action="store_true")
    p.add_argument("--events", action="store_true")
    p = add("estimate", "rows and bytes a run would read")
    p.add_argument("--models")
    p.add_argument("--depth", type=int)
    p.add_argument("--refresh", action="store_true")
    add("status", "where the branch stands; status 3 if production has moved")
    p = add("promote", "fast-forward production to the branch")
    p.add_argument("--ff-only", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--yes", action="store_true", help="do not ask")
    branch = verbs.add_parser("branch", help="data branches").add_subparsers(dest="action", required=True)
    p = branch.add_parser("create", parents=[shared])
    p.add_argument("name")
    p.add_argument("--from-ref")
    branch.add_parser("list", parents=[shared])
    for action in ("show", "discard"):
        branch.add_parser(action, parents=[shared]).add_argument("name")
    p = add("gc", "drop expired branches, orphan pins and unreachable snapshots")
    p.add_argument("--before-days", type=float)
    p.add_argument("--dry-run", action="store_true")
    add("mcp", "serve the verbs as agent tools on standard input and output")
    return top


def init(a: argparse.Namespace) -> dict:
    root = Path(a.project)
    path = root / config.FILE
    if path.exists():
        raise ConfigError(f"{path} exists")
    body: dict = {"version": 1, "warehouse": {"catalog": {"type": a.catalog, "warehouse": a.warehouse}}, "branching": {"git_sync": not a.no_git}}
    if a.uri:
        body["warehouse"]["catalog"]["uri"] = a.uri
    elif a.catalog in config.NEED_URI:
        raise ConfigError(f"--uri is needed for a catalog of type {a.catalog}")
    if a.namespace:
        body["warehouse"]["namespace"] = a.namespace
    config.refuse_secrets(body)
    (root / "models").mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(body, sort_keys=False))
    advice = [] if a.catalog == "parquet" else ["credentials: leave them to the environment, or refer to variables, as in warehouse.catalog: {s3.access-key-id: ${AWS_ACCESS_KEY_ID}}"]
    return Answer("init", {"config": str(path), "models": str(root / "models")}, warnings=advice).as_dict()


def perform(a: argparse.Namespace) -> dict:
    if a.verb == "init":
        return init(a)
    project = Project(a.project, profile=a.profile)
    if a.verb == "mcp":
        from .mcp_server import serve

        serve(project)
        return Answer("mcp").as_dict()
    where = {"change_set": a.change_set, "branch": a.branch}
    events = {"on_event": event_writer(a.verb)} if getattr(a, "events", False) else {}
    if a.verb == "run":
        return project.run(a.models, a.depth, a.dry_run, refresh=a.refresh, force=a.force, **where, **events)
    if a.verb == "diff":
        return project.diff(a.tables, a.against, a.schema_only, a.rows, a.full, **where, **events)
    if a.verb == "estimate":
        return project.estimate(a.models, a.depth, refresh=a.refresh, **where)
    if a.verb == "status":
        return project.status(**where)
    if a.verb == "promote":
        if not a.yes and not a.dry_run and sys.stdin.isatty() and input("Promote to production? [y/N] ").strip().lower() != "y":
            raise BranchlineError("not promoted")
        return project.promote(a.ff_only, a.dry_run, **where)
    if a.verb == "gc":
        return project.gc(a.before_days, a.dry_run)
    return {"create": lambda: project.branch_create(a.name, a.from_ref, a.change_set), "list": project.branch_list, "show": lambda: project.branch_show(a.name), "discard": lambda: project.branch_discard(a.name)}[a.action]()


def shortened(names: list, most: int = 3) -> str:
    """The first names of a list, and how many more there are."""
    first = ", ".join(map(str, names[:most])) or "none"
    return f"{first} and {len(names) - most} more" if len(names) > most else first


def show(answer: dict, as_json: bool) -> None:
    if as_json:
        print(json.dumps(answer, indent=2, default=str))
        return
    for key, value in answer["data"].items():
        if key == "preflight" and isinstance(value, dict):
            for name, found in value.items():
                print(f"{name}: {shortened(found)}")
            continue
        print(f"{key}: {json.dumps(value, default=str) if isinstance(value, (dict, list)) else value}")
    for kind in ("warnings", "errors"):
        for line in answer[kind]:
            print(f"{kind[:-1]}: {line}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    command = a.verb if a.verb != "branch" else f"branch {a.action}"
    try:
        show(perform(a), a.json)
        return Exit.OK
    except BranchlineError as e:
        show(e.payload or Answer(command, errors=[str(e)]).as_dict(), a.json)
        if e.payload:
            print(f"error: {e}", file=sys.stderr)
        return int(e.status)
    except KeyboardInterrupt:
        return int(Exit.INTERRUPTED)


if __name__ == "__main__":
    sys.exit(main())
