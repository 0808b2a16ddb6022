"""Registry of runnable queries and the SQL that checks them.

Every query returns the columns named in its ``spec``, a space-separated list
of ``name:type`` with the types s(tring), i(nteger), d(ouble), r(atio: a double
kept to more digits), t(imestamp) and b(oolean). The same spec casts and rounds both the Spark result and the SQL
result, so the two can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.plans.telemetry import Tables
from voltmill.session import ensure_utc

DIGITS = {"d": 6, "r": 12}
_SPARK_TYPES = {"s": "string", "i": "bigint", "t": "timestamp_ntz", "b": "boolean"}
_SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "t": "TIMESTAMP", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    spec: str
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(item.split(":")) for item in self.spec.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_utc(spark)
        return self.build(Tables(spark, sf_dir)).select(
            *[_present(name, kind) for name, kind in self.columns()]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        chosen = ", ".join(_present_sql(name, kind) for name, kind in self.columns())
        return f"SELECT {chosen} FROM (\n{self.sql}\n) AS answer"


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    """Register the decorated builder under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, spec, sql)
        return build

    return register


def _present(name: str, kind: str) -> Column:
    column = F.col(name)
    if kind in DIGITS:
        # adding zero turns a negative zero into zero
        return (F.round(column.cast("double"), DIGITS[kind]) + F.lit(0.0)).alias(name)
    return column.cast(_SPARK_TYPES[kind]).alias(name)


def _present_sql(name: str, kind: str) -> str:
    if kind in DIGITS:
        return f"round(CAST({name} AS DOUBLE), {DIGITS[kind]}) + CAST(0 AS DOUBLE) AS {name}"
    return f"CAST({name} AS {_SQL_TYPES[kind]}) AS {name}"
