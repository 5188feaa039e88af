"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermalcube.checks.views import SQL_VIEWS
from thermalcube.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    used: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        found = {name for name in SQL_VIEWS if re.search(rf"\b{name}\b", text)} - used
        used |= found
        texts += [SQL_VIEWS[name] for name in found]
    body = sql.strip()
    if not used:
        return body
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name].strip()})" for name in SQL_VIEWS if name in used)
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(sql: str | None = None):
    """Register a function as the query of its name, with the SQL that must give the same rows."""

    def register(function):
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, function.__doc__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register
