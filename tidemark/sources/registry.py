"""Registry resources: the catalogue of a package, and scans of its rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import or_text
from tidemark.operators.unions import first_with_rows


def latest_active(catalogue: DataFrame) -> DataFrame:
    """The id of the last active resource (catalogue: id, datastore_active, pos)."""
    return catalogue.where("datastore_active").agg(F.max_by("id", "pos").alias("id"))


def bounded(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows, or a sample of limit where a caller asks for one."""
    return rows if limit is None else rows.limit(limit)


def exact(rows: DataFrame, column: str, value) -> DataFrame:
    """Equality, which reaches the files' own statistics."""
    return rows.where(F.col(column) == value)


def containing(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows with the query in any of the columns, whatever the case."""
    hits = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(query.lower()) for c in columns]
    return rows.where(reduce(Column.__or__, hits))


def search(rows: DataFrame, key: str, columns: list[str], query: str) -> DataFrame:
    """A query of digits asks for the key first; any other, or one without a hit, for texts."""
    found = containing(rows, columns, query)
    return first_with_rows(exact(rows, key, query), found) if re.fullmatch("[0-9]+", query) else found


def with_defaults(rows: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """new name -> (column, default for null and empty)."""
    return rows.select(*[or_text(F.col(f"`{c}`"), d).alias(n) for n, (c, d) in names.items()])


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def snapshots(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """All snapshots, each row with its date."""
    dated = [rows.withColumn("snapshot_date", F.lit(day).cast("date")) for rows, day in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dated)
