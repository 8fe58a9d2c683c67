"""Names that cannot clash with a user's columns."""

from __future__ import annotations

from collections.abc import Iterable


def free_prefix(columns: Iterable[str]) -> str:
    """A beginning of names that no column has, whatever its case."""
    taken, prefix = [c.lower() for c in columns], "own_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix
