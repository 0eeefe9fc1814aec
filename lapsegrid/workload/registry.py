"""Registry of the runnable queries: a Spark plan and, where one exists, the same answer in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lapsegrid.functions.numeric import round_doubles
from lapsegrid.sources.canonical import Inputs


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    digits: int


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 8):
    """Register a query. ``doubles`` names the floating columns, rounded alike on both sides."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        text = sql
        if text is not None:
            text = text.strip()
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles.split())
            text = f"SELECT *{' REPLACE (' + replaced + ')' if replaced else ''} FROM (\n{text}\n)"
        ENTRIES[name] = Entry(name, build, text, digits)
        return build

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, folder: round_doubles(entry.build(Inputs(spark, folder)), entry.digits)

    return {name: bind(entry) for name, entry in ENTRIES.items()}


def sql_texts() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql is not None}
