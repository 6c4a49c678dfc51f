"""Registered queries over the supplied tables, each next to its DuckDB oracle."""

from __future__ import annotations

import importlib
import pkgutil

from larder.suite.registry import ORACLES, QUERIES


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
