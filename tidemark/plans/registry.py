"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame``; ``sql`` is its check on the same tables.

    Dates are handed out as ISO text, so that they compare alike whichever way a client reads them.
    """

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _dates_as_text(build(Tables(spark, sf_dir)))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _dates_as_text(frame: DataFrame) -> DataFrame:
    days = {
        f.name: F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd")
        for f in frame.schema.fields
        if isinstance(f.dataType, T.DateType)
    }
    return frame.withColumns(days) if days else frame
