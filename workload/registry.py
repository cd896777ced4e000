from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can express it, the SQL to check it against."""
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return add


def with_views(body: str, *views: tuple[str, str]) -> str:
    """`WITH name AS (...) body`; views are (name, sql) pairs in dependency order."""
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in views)
    joiner = ",\n" if body.lstrip().startswith("--more") else "\n"
    return f"WITH {listed}{joiner}{body.lstrip().removeprefix('--more')}"
