"""Operators on series: long rows of keys (indicator, geo, ...), period and value.

``period`` orders a series; use a date (functions.periods.period_start) where spellings mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import cents


def summary(rows: DataFrame, keys: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """latest, previous, change, min, max, avg, count of each series' values that aren't null. A
    series without any has nulls and count 0; with one, previous and change are null.

    One shuffle by the keys; the second latest value comes from the same sort."""
    known = F.col(value).isNotNull()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(known, 0).otherwise(1), F.col(period).desc()))
    ranked = rows.withColumn("_k", place)
    pick = lambda k: F.max(F.when((F.col("_k") == k) & known, F.col(value)))
    out = ranked.groupBy(*keys).agg(
        pick(1).alias("latest"), pick(2).alias("previous"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.sum(F.col(value).cast("decimal(28,2)")).cast("double").alias("_sum"), F.count(value).alias("count"),
    )
    return out.select(
        *keys, "latest", "previous", cents(F.col("latest") - F.col("previous")).alias("change"), cents(F.col("min")).alias("min"), cents(F.col("max")).alias("max"),
        cents(F.try_divide("_sum", "count")).alias("avg"), "count",
    )


def change(rows: DataFrame, keys: list[str], lag: int = 1, percent: bool = False, period: str = "period", value: str = "value") -> DataFrame:
    """Each value that isn't null with the one lag values before it and the change, absolute or
    in percent (null where there is none before, or it is 0 for a percentage)."""
    known = rows.where(F.col(value).isNotNull())
    before = known.withColumn("before", F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(period)))
    moved = F.col(value) - F.col("before")
    return before.withColumn("change", F.try_divide(moved, "before") * 100 if percent else moved)


def latest_change(rows: DataFrame, keys: list[str], lag: int, percent: bool = False, period: str = "period", value: str = "value") -> DataFrame:
    """The last row of change for each series."""
    return last_n(change(rows, keys, lag, percent, period, value), keys, 1, period)


def last_n(rows: DataFrame, keys: list[str], n: int, period: str = "period") -> DataFrame:
    """The last n rows of each series (n = 0: all)."""
    if not n:
        return rows
    newest = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    return rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")


def last_years(rows: DataFrame, keys: list[str], years: int | None, per_year: Column, period: str = "period") -> DataFrame:
    """The last years * per_year rows of each series; None or 0 years: all."""
    if not years:
        return rows
    newest = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    return rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= per_year * years).drop("_k")


def per_year(freq: Column, compat_id: Column | None = None) -> Column:
    """Rows a year by frequency. With an indicator id, the feed's own habit: 4 for three quarterly
    indicators, 12 for all others."""
    if compat_id is not None:
        return F.when(compat_id.isin("gdp", "salary", "house_prices"), 4).otherwise(12)
    return F.when(freq == "M", 12).when(freq == "Q", 4).when(freq == "S", 2).otherwise(1)


def since_year(rows: DataFrame, year: int, start: str = "period_start") -> DataFrame:
    """Rows from the first of January on: a range that files can be pruned by."""
    return rows.where(F.col(start) >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))


def since_years(rows: DataFrame, years: int | None, this_year: int, start: str = "period_start") -> DataFrame:
    return since_year(rows, this_year - years, start) if years else rows


def align(rows: DataFrame, columns: list[str], key: str = "geo", period: str = "period", value: str = "value") -> DataFrame:
    """One row a period, one column for each of the given keys, null where a series lacks it."""
    return rows.groupBy(period).pivot(key, columns).agg(F.first(value, ignorenulls=True))


def latest_known(rows: DataFrame, keys: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """The last value that isn't null, with its period."""
    at = F.when(F.col(value).isNotNull(), F.col(period))
    return rows.groupBy(*keys).agg(F.max(at).alias(period), F.max_by(value, at).alias(value))


def index_to_growth(value: Column, base: Column | float = 100.0) -> Column:
    """An index as growth over its base, in percent points; null stays null."""
    return value - base
