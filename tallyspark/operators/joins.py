"""Helpers around joins. None of them runs a job or gives a broadcast hint: the
planner measures the sides (AQE, by bytes) and picks the join at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def values_of(df: DataFrame, column: str) -> Column:
    """The distinct values of a rule column (sheet names) as one array, to be
    exploded per company: an uncorrelated subquery that runs inside the query."""
    return df.agg(F.array_sort(F.collect_set(column)).alias("_values")).scalar()


def any_row(df: DataFrame) -> Column:
    """Whether ``df`` has a row, decided inside the query."""
    return df.limit(1).exists()


def header_names(headers: DataFrame, column: str) -> list[str]:
    """Header texts of a set of files in column order: by their first position,
    then by text. Column names of a result must be known when it is built, so
    this reads the headers; pass the names to avoid it."""
    cells = headers.select(F.posexplode(column).alias("pos", "name")).where("name is not null")
    rows = cells.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").collect()
    return [r["name"] for r in rows]
