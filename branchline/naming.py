"""Names of refs and tables."""

from __future__ import annotations

import getpass
import hashlib
import itertools
import re

LONGEST = 255
DEFAULT_REPLACEMENTS = {"/": "__", " ": "_"}


def ref_name(name: str, replacements: dict[str, str] | None = None) -> str:
    """A change-set id as a ref name: replacements first, then any run of other characters becomes one underscore."""
    for old, new in (replacements or DEFAULT_REPLACEMENTS).items():
        name = name.replace(old, new)
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")[:LONGEST] or "unnamed"


def apart_from(ref: str, taken: set[str], user: str | None = None) -> str:
    """``ref`` if it is free, else the first free ``<ref>__<user><hash>``; a long ref gives way to what sets it apart."""
    owner = "".join(c for c in (getpass.getuser() if user is None else user) if c.isascii() and c.isalnum())[:16] or "user"
    found = ref
    for attempt in itertools.count():
        if found not in taken:
            return found
        mark = hashlib.blake2b(f"{attempt} {ref}".encode(), digest_size=4, person=owner.encode()).hexdigest()
        tail = f"__{owner}{mark}"
        found = ref[: LONGEST - len(tail)] + tail
    raise AssertionError("unreachable")


def pin_tag(prefix: str, branch: str, table: str) -> str:
    return f"{prefix}{branch}__{table}"


def qualified(namespace: str | None, name: str) -> str:
    """Dotted names are complete; others get the namespace."""
    return name if "." in name or not namespace else f"{namespace}.{name}"
