"""Where queries register themselves together with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from larder.sources.roles import Roles, with_roles

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame`` under a survey id, with oracle SQL where SQL can say it."""

    def register(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return fn(Roles(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return fn

    return register
