"""Registration of queries: a name, a Spark plan, and SQL for the check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bridge import Bridge, with_ctes


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Output types both engines print alike: decimals as doubles, dates as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.unix_millis(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Register ``fn(bridge)`` under a name, with its SQL twin if there is one."""

    def register(fn: Callable[[Bridge], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Bridge(spark, folder)))

        text = None if sql is None else with_ctes(needs or [], sql)
        REGISTRY[name] = Query(name, run, text)
        return fn

    return register


def load() -> dict[str, Query]:
    """Every registered query; importing the modules fills the registry."""
    from . import columns, files, ledger, projects, reconcile, spend, streams, texts, timeline  # noqa: F401

    return REGISTRY
