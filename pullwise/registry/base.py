"""The query registry: name -> (Spark query, equivalent SQL over the same tables)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pullwise.sources.tables import Tables, ctes


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def with_views(body: str, *views: str, extra: str = "", recursive: bool = False) -> str:
    """SQL text: the named views as a WITH list, further CTEs, then the body."""
    parts = [p for p in (ctes(*views), extra.strip().rstrip(",")) if p]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql)
        return fn

    return wrap
