"""Column-name normalisation (schema only; nothing runs on the data)."""

from __future__ import annotations

import re

# Fixed values (as the analysed tool normalises names): characters kept, the run
# that collapses, the name for an empty result.
_NOT_WORD = re.compile(r"[^a-z0-9_]")
_RUNS = re.compile(r"_+")
EMPTY_NAME = "column"


def snake_name(name: str) -> str:
    """strip, lower, every char outside [a-z0-9_] -> '_', runs of '_' -> one, trim '_';
    an empty result becomes 'column'."""
    s = _RUNS.sub("_", _NOT_WORD.sub("_", name.strip().lower())).strip("_")
    return s or EMPTY_NAME


def unique_names(names: list[str]) -> list[str]:
    """Normalise every name; a repeat gets ``_1``, ``_2``, ... counting on until the
    name is free (also free of names taken by earlier suffixes)."""
    taken: set[str] = set()
    counter: dict[str, int] = {}
    out = []
    for n in names:
        base = snake_name(n)
        cand = base
        if cand in taken:
            k = counter.get(base, 0)
            while cand in taken:
                k += 1
                cand = f"{base}_{k}"
            counter[base] = k
        taken.add(cand)
        out.append(cand)
    return out
