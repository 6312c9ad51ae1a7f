"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.plans.binding import Binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
RECURSIVE: set[str] = set()


def view(name: str, body: str, recursive: bool = False) -> None:
    """A named building block of the checking SQL; a recursive one reads itself."""
    CTES[name] = body.strip()
    if recursive:
        RECURSIVE.add(name)


def compose(body: str) -> str:
    """Prefix the building blocks a statement uses, in definition order."""
    import re

    names = list(CTES)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    blocks = [f"{n} AS ({CTES[n]})" for n in names if n in needed]
    return ("WITH " + ("RECURSIVE " if needed & RECURSIVE else "") + ",\n".join(blocks) + "\n" if blocks else "") + body.strip()


def query(name: str, sql: str | None = None):
    """Register ``fn(binding)`` under a name, with its checking SQL when there is one."""

    def register(fn: Callable[[Binding], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Binding(spark, folder))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register


def day(column: str):
    """A date as text, the same in every engine."""
    return F.col(column).cast("date").cast("string").alias(column.split(".")[-1])
