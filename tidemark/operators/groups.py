"""Counts, sums, shares, top lists, latest rows and ladders by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import or_text


def top_counts(rows: DataFrame, key: str, n: int | None = None, missing: str = "Unknown") -> DataFrame:
    """Rows a key, most first, ties by key; n: so many keys."""
    counted = rows.groupBy(or_text(F.col(key).cast("string"), missing).alias(key)).agg(F.count("*").alias("count"))
    ordered = counted.orderBy(F.desc("count"), key)
    return ordered.limit(n) if n else ordered


def top_with_rest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n counts, with how many keys there are beyond them."""
    counted = rows.groupBy(key).agg(F.count("*").alias("count"))
    more = counted.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return counted.orderBy(F.desc("count"), key).limit(n).crossJoin(F.broadcast(more))  # one row


def sums(rows: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    """Exact sums of two-decimal values."""
    return rows.groupBy(*keys).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias(name))


def shares(totals: DataFrame, value: str = "total", floor: float = 1.0) -> DataFrame:
    """share (of the sum, in percent) and bar (of the largest, at least floor). The window is over
    group totals, so over as many rows as there are groups."""
    everything = totals.agg(F.sum(F.col(value).cast("decimal(38,2)")).cast("double").alias("_all"), F.max(value).alias("_most"))
    joined = totals.crossJoin(F.broadcast(everything))  # one row
    bar = F.greatest(F.try_divide(F.col(value) * 100, F.col("_most")), F.lit(floor))
    return joined.select(*totals.columns, F.try_divide(F.col(value) * 100, F.col("_all")).alias("share"), bar.alias("bar"))


def statistics(rows: DataFrame, value: str) -> DataFrame:
    total = F.sum(F.col(value).cast("decimal(28,2)")).cast("double")
    return rows.agg(total.alias("total"), F.min(value).alias("min"), F.max(value).alias("max"), F.try_divide(total, F.count(value)).alias("avg"), F.count(value).alias("count"))


def sum_first_known(rows: DataFrame, columns: list[str], fallback: float) -> DataFrame:
    """The sum over rows of the first column that isn't null (else 0), or the fallback where that
    isn't above zero."""
    total = F.sum(F.coalesce(*[F.col(c).cast("decimal(18,2)") for c in columns], F.lit(0).cast("decimal(18,2)"))).cast("double")
    return rows.agg(total.alias("_sum")).select(F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.lit(fallback)).alias("total"))


def distinct_known(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(column).distinct()


def keep_latest(rows: DataFrame, keys: list[str], when: str, *ties: Column) -> DataFrame:
    """One row a key: the latest; blank times lose to any, ties go by the given order."""
    order = [F.desc_nulls_last(F.nullif(F.col(when).cast("string"), F.lit(""))), *ties]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def top_n_per_group(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; Spark drops the rest before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def date_range(rows: DataFrame, column: str) -> DataFrame:
    known = F.nullif(F.col(column).cast("string"), F.lit(""))
    return rows.agg(F.min(known).alias("first"), F.max(known).alias("last"))


def nest(rows: DataFrame, key: str, order: list[str], fields: list[str], missing: str = "unknown", name: str = "children") -> DataFrame:
    """One row a key with its children in order, and their number."""
    child = F.struct(*order, *[f for f in fields if f not in order])
    grouped = rows.groupBy(or_text(F.col(key).cast("string"), missing).alias(key))
    return grouped.agg(F.array_sort(F.collect_list(child)).alias(name), F.count("*").alias(f"n_{name}"))


def health(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Checks (status, required) to counts and a status: healthy if all required are, degraded if
    at least half of them (rounded up), else unhealthy."""
    up, needed = F.col("status") == "healthy", F.coalesce(F.col("required"), F.lit(False))
    out = (checks.groupBy(*keys) if keys else checks.groupBy()).agg(
        F.count("*").alias("total"), F.count_if(up).alias("healthy"), F.count_if(needed).alias("required"), F.count_if(needed & up).alias("required_healthy"),
        F.count_if(~needed).alias("optional"), F.count_if(~needed & up).alias("optional_healthy"),
    )
    half = F.ceil(F.col("required") / 2)
    return out.withColumn("status", F.when(F.col("required_healthy") == F.col("required"), "healthy").when(F.col("required_healthy") >= half, "degraded").otherwise("unhealthy"))


def first_row(rows: DataFrame, value: str, position: str) -> DataFrame:
    return rows.agg(F.min_by(value, position).alias(value))
