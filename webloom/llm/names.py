"""Column names that meet no column of the caller's tables."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, with underscores before it until no name in ``taken`` is the same (case aside)."""
    known = {c.lower() for c in taken}
    while wish.lower() in known:
        wish = f"_{wish}"
    return wish
