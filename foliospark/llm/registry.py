"""The subpackage's queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from foliospark.llm import queries as _queries


def queries() -> dict[str, Callable]:
    return dict(_queries.QUERIES)


def sql() -> dict[str, str]:
    return dict(_queries.SQL)
