"""Queries of the llm problems; modules that are there are added."""

from __future__ import annotations

import importlib
import importlib.util

_MODULES = ("q_pages", "q_dedup", "q_truncated", "q_residue", "q_packing", "q_leaks", "q_abuse")


def _loaded():
    for name in _MODULES:
        if importlib.util.find_spec(f"{__package__}.{name}") is not None:
            yield importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _loaded() for k, q in getattr(m, "ORACLE", {}).items()}
