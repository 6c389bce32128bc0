"""What git knows of a project; everything is read only, and absent outside a repository."""

from __future__ import annotations

import subprocess
from pathlib import Path


def _git(root: Path, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def root_of(path: Path) -> Path | None:
    out = _git(path, "rev-parse", "--show-toplevel")
    return Path(out.strip()) if out else None


def branch_of(path: Path) -> str | None:
    out = _git(path, "rev-parse", "--abbrev-ref", "HEAD")
    return out.strip() if out and out.strip() != "HEAD" else None


def head_of(path: Path) -> str | None:
    out = _git(path, "rev-parse", "HEAD")
    return out.strip() if out else None


def fork_point(path: Path, bases: tuple[str, ...] = ("origin/main", "main", "origin/master", "master")) -> str | None:
    """The commit where HEAD left the first of the bases that exists."""
    for base in bases:
        if out := _git(path, "merge-base", "HEAD", base):
            return out.strip()
    return None


def file_at(root: Path, commit: str, relative: str) -> str | None:
    return _git(root, "show", f"{commit}:{relative}")


def uncommitted(path: Path) -> list[str]:
    return [line[3:] for line in (_git(path, "status", "--porcelain") or "").splitlines()]
