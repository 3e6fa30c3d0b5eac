"""Where registered queries and their SQL counterparts meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickerloom.session import LEDGER_SETTINGS, configure
from tickerloom.testbed.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """The result in types that both engines write alike: bigint, double, boolean and text."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("string") if kind.scale == 0 else c.cast("double")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def moment(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def query(name: str, views: str = "", sql: str | None = None):
    """Registers ``fn(views)``; ``sql`` may read the named views of :mod:`tickerloom.testbed.views`."""

    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return portable(fn(Views(configure(spark, **LEDGER_SETTINGS), folder)))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(*views.split(), body=sql) if views else sql
        return fn

    return add
