"""Column names that do not clash with those of the input."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with a number behind it where the input has that name (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        chosen = name if name.lower() not in taken else next(n for i in count(1) if (n := f"{name}{i}").lower() not in taken)
        taken.add(chosen.lower())
        out.append(chosen)
    return out
