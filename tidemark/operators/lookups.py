"""Joins with dimension tables. A side is only hinted for broadcast where it is made in code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_or(rows: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """rows with the name of their key, or the default."""
    return rows.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(name, F.coalesce("_name", default)).drop("_name")


def named_only(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names, key)


def three_way(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Keys that all three have."""
    return a.join(b, key).join(c, key)


def related(entities: DataFrame, known: DataFrame, key: str = "id", links: str = "related") -> DataFrame:
    """Each entity's links to entities that there are; dangling links vanish."""
    edges = entities.select(F.col(key).alias("from"), F.explode(links).alias(key))
    return edges.join(known, key)


def first_source(rows: DataFrame, mapped: DataFrame, key: str, fallback: Column) -> DataFrame:
    """source: the mapped one of the key, else the fallback (which may be null)."""
    return rows.join(mapped.select(key, F.col("source").alias("_mapped")), key, "left").withColumn("source", F.coalesce("_mapped", fallback)).drop("_mapped")


def or_default_row(rows: DataFrame, names: DataFrame, key: str, default: str) -> DataFrame:
    """rows with the columns of names for their key; a key that names doesn't have takes those of
    the default key. names is a small table of fixed values, joined once."""
    known = F.broadcast(names.select(F.col(key).alias("_known")))
    stands = rows.join(known, F.col(key) == F.col("_known"), "left").withColumn("_stands", F.coalesce("_known", F.lit(default))).drop("_known")
    return stands.join(F.broadcast(names.withColumnRenamed(key, "_stands")), "_stands", "left").drop("_stands")


def fulfilled(answers: DataFrame, error: str = "error") -> DataFrame:
    """Answers of sites that did not fail."""
    return answers.where(F.col(error).isNull()).drop(error)
