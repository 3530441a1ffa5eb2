"""Catalogue of registered queries, each paired with its oracle where SQL can state it.

A query is a build function over the driver's tables plus the list of its output
columns and their kinds: ``l`` whole number, ``d`` double rounded to six places,
``e`` double rounded to nine (short decimal fractions that would tie at six),
``b`` boolean, ``s`` string.  Both sides are cast the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelens.sources.standins import Tables

PLACES = {"d": 6, "e": 9}
REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        frame = self.build(Tables(spark, folder))
        out = []
        for name, kind in self.columns:
            c = F.col(name)
            if kind == "l":
                c = c.cast("bigint")
            elif kind == "b":
                c = c.cast("boolean")
            elif kind == "s":
                c = c.cast("string")
            else:
                d = c.cast("double")
                c = F.when(~F.isnan(d), F.round(d, PLACES[kind]))
            out.append(c.alias(name))
        return frame.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind == "l":
                c = f"CAST({name} AS BIGINT)"
            elif kind == "b":
                c = f"CAST({name} AS BOOLEAN)"
            elif kind == "s":
                c = f"CAST({name} AS VARCHAR)"
            else:
                d = f"CAST({name} AS DOUBLE)"
                r = f"round({d}, {PLACES[kind]})"
                c = f"CASE WHEN isnan({d}) THEN NULL WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END"
            out.append(f"{c} AS {name}")
        return f"SELECT {', '.join(out)} FROM ({self.sql.strip()}) AS answer"


def query(name: str, ids: str, columns: str, sql: str | None = None):
    """Register a build function: ``columns`` is ``"player:l mean:d"``."""

    def register(build: Callable[[Tables], DataFrame]):
        pairs = tuple(tuple(c.split(":")) for c in columns.split())
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), pairs, build, sql)
        return build

    return register


def load() -> dict[str, Query]:
    """Import every catalogue module and return the registry."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
