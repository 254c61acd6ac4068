"""All queries outside the optional subpackage, with their oracles."""

from __future__ import annotations

from memloom.plans import advantages, answers, calls, evaluating, memory, reshaping, splitting, star, training

_MODULES = (advantages, answers, calls, evaluating, memory, reshaping, splitting, star, training)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
