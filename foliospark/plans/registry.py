"""All core queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from foliospark.plans import operations, problems, reference

_MODULES = (reference, operations, problems)


def queries() -> dict[str, Callable]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
