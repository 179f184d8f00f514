"""Registered queries over the given tables, each with its SQL check."""

from __future__ import annotations

import importlib
import pkgutil

from newswake.registry.base import QUERIES, SQL, Query


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
