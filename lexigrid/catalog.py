"""All queries of the package outside ``llm`` with their SQL."""

from __future__ import annotations

from importlib import import_module

from lexigrid.registry import QUERIES, SQL, Query

MODULES = ("text", "arabic", "morphology", "filters", "joins", "turkish", "aggregates", "windows", "ordering", "arrays", "alignment", "sources", "streams", "choice", "search", "state", "archives")


def _load() -> None:
    for m in MODULES:
        import_module(f"lexigrid.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
