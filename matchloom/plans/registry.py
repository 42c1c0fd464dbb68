"""Catalogue of named queries, each with an optional ANSI SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from matchloom.plans.fixtures import Tables, with_views


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``views`` are the fixture views the check SQL reads; they are put in front of it.
    """

    def register(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(fn, None if sql is None else with_views(sql, views))
        return fn

    return register


def as_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = CATALOG[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.run(Tables(spark, sf_dir))

    run.__name__ = name
    return run
