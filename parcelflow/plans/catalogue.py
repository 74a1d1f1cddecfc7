"""The registry of catalogue queries: each by name, with the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        REGISTRY[name] = Query(name, run, sql)
        return run

    return register


def all_queries() -> dict[str, Query]:
    from . import admin_queries, ingest_queries, more_queries, project_queries, read_queries, survival_queries, text_queries  # noqa: F401

    return dict(REGISTRY)
