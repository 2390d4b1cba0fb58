"""All market queries by name, and their SQL for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import composed, evolved, library, live, pairs, population, portfolio, rotation, storage, times
from tidemark.plans.market import SQL
from tidemark.sources import TABLES, table


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs SQL with {table} places over the tables of a folder."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    return run


def portable(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: sql_query(text) for name, text in (SQL | library.SPARK).items()} | composed.QUERIES | evolved.QUERIES | population.QUERIES | live.QUERIES | storage.QUERIES | times.QUERIES | portfolio.QUERIES | pairs.QUERIES | rotation.QUERIES
ORACLE: dict[str, str] = {name: portable(text) for name, text in (SQL | library.OTHER | composed.ORACLE | evolved.ORACLE | population.ORACLE | live.ORACLE | storage.ORACLE | times.ORACLE | portfolio.ORACLE | pairs.ORACLE | rotation.ORACLE).items()}
