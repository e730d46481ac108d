"""Registry of runnable queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.common import col_of, quoted
from tidewatch.sources.readers import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL twin if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, so that results compare as text."""
    return F.round(col_of(c).cast("double"), digits) + F.lit(0.0)


def stamp(c: str | Column) -> Column:
    return F.date_format(col_of(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, times as text, integers as BIGINT."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = quoted(f.name)
        if kind in ("double", "float"):
            c = rnd(c, digits)
        elif kind in ("timestamp", "timestamp_ntz"):
            c = stamp(c)
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("integer", "short", "byte", "long") or kind.startswith("decimal"):
            c = c.cast("bigint")
        elif kind in ("array", "map", "struct"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)
