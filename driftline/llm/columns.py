"""Column names that do not clash with those of a given table."""

from __future__ import annotations


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each followed by underscores until no column in ``taken`` has that name, whatever its case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
