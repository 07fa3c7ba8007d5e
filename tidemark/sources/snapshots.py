"""Materialised results with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: minutes by beginning of the key; any other key
MINUTES = [("economy", 30), ("property", 60), ("environment", 15), ("baltic_compare", 60)]
OTHER_MINUTES = 60


def ttl_minutes(key: Column) -> Column:
    """The first beginning that fits decides."""
    out = F.when(F.lit(False), 0)
    for start, minutes in MINUTES:
        out = out.when(key.startswith(start), minutes)
    return out.otherwise(OTHER_MINUTES)


def write(rows: DataFrame, path: str, key: str) -> None:
    """Rows with their key and the time of writing, a folder a key."""
    stamped = rows.withColumns({"cache_key": F.lit(key), "fetched_at": F.current_timestamp()})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)


def read_fresh(spark: SparkSession, path: str, key: str, now: Column | None = None) -> DataFrame:
    """The key's rows that are younger than its time to live."""
    return fresh(spark.read.parquet(path).where(F.col("cache_key") == key), now)


def fresh(rows: DataFrame, now: Column | None = None) -> DataFrame:
    age = F.unix_seconds(F.current_timestamp() if now is None else now) - F.unix_seconds("fetched_at")
    return rows.where(age < 60 * ttl_minutes(F.col("cache_key")))


def max_age(key: Column) -> Column:
    """The header that tells how long a result may be kept."""
    return F.concat(F.lit("public, max-age="), (60 * ttl_minutes(key)).cast("string"))


def as_json(rows: DataFrame, key: str, name: str = "rows", now: Column | None = None) -> DataFrame:
    """One JSON row for each row, stamped with its key, how long it may be kept, and fetchedAt; the time
    belongs to the sink, so it is taken here and nowhere before."""
    at = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(F.to_json(F.struct(F.struct("*").alias(name), max_age(F.lit(key)).alias("cacheControl"), at.alias("fetchedAt"))).alias("value"))


def write_json(rows: DataFrame, path: str, key: str, name: str = "rows") -> None:
    as_json(rows, key, name).write.mode("overwrite").text(path)
