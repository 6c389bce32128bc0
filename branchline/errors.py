"""Failures and the process exit status each one stands for."""

from __future__ import annotations

from enum import IntEnum


class Exit(IntEnum):
    """Exit statuses of the command line. Fixed values."""

    OK = 0
    ERROR = 1
    CONFIG = 2
    DRIFT = 3
    PROMOTE_BLOCKED = 4
    EMPTY_SCOPE = 5
    LINEAGE = 6
    MISSING_KEY = 7
    INTERRUPTED = 130


class BranchlineError(Exception):
    """Carries an exit status and, where output exists in spite of the failure, the envelope with it."""

    status = Exit.ERROR

    def __init__(self, message: str, status: Exit | None = None, payload: dict | None = None):
        super().__init__(message)
        self.status = self.status if status is None else status
        self.payload = payload


class ConfigError(BranchlineError):
    status = Exit.CONFIG


class DriftError(BranchlineError):
    status = Exit.DRIFT


class PromoteBlocked(BranchlineError):
    status = Exit.PROMOTE_BLOCKED


class EmptyScope(BranchlineError):
    status = Exit.EMPTY_SCOPE


class LineageError(BranchlineError):
    status = Exit.LINEAGE


class MissingKey(BranchlineError):
    status = Exit.MISSING_KEY


class CommitConflict(BranchlineError):
    """Another writer committed to the same ref meanwhile."""
