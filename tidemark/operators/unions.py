"""Putting rows of several producers together, and first-that-has-rows choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn(tag, F.lit(name)) for name, rows in parts.items()])


def distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def first_with_rows(first: DataFrame, otherwise: DataFrame) -> DataFrame:
    """first, or the other one where first is empty; one plan, decided by Spark as it runs."""
    any_row = first.limit(1).agg(F.count("*").alias("_n"))
    fallback = otherwise.crossJoin(F.broadcast(any_row)).where("_n = 0").drop("_n")  # one row
    return first.unionByName(fallback)


def day_or_first(rows: DataFrame, day: str, n: int, *order: Column, ts: str = "ts") -> DataFrame:
    """Rows of a day; where there are none, the first n rows."""
    start = F.lit(day).cast("timestamp_ntz")
    today = rows.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY")))
    return first_with_rows(today, rows.orderBy(*order).limit(n))
