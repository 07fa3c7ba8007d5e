"""Periods in the spellings of the feeds: 2024Q1, 2024M3, 2024-Q1, 2024-03, 2024-S1, 2024."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUARTER = r"^(\d{4})-?Q([1-4])$"
_MONTH = r"^(\d{4})(?:M|-)(\d{1,2})$"
_HALF = r"^(\d{4})-?S([12])$"
_YEAR = r"^(\d{4})$"
_SHORT = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _part(period: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(period, pattern, k).try_cast("int")


def frequency(period: Column) -> Column:
    """M, Q, S or A; null for any other text."""
    return F.when(period.rlike(_QUARTER), "Q").when(period.rlike(_MONTH), "M").when(period.rlike(_HALF), "S").when(period.rlike(_YEAR), "A")


def period_start(period: Column) -> Column:
    """The first day; null where there is none (a month 13, another text)."""
    year = F.regexp_extract(period, r"^(\d{4})", 1)
    month = (
        F.when(period.rlike(_QUARTER), 3 * _part(period, _QUARTER, 2) - 2)
        .when(period.rlike(_MONTH), _part(period, _MONTH, 2))
        .when(period.rlike(_HALF), 6 * _part(period, _HALF, 2) - 5)
        .when(period.rlike(_YEAR), 1)
    )
    return F.when(month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")).try_cast("date"))


def format_period(period: Column) -> Column:
    """'Q1 2024', 'Mar 2024'; anything else stays."""
    names, month = F.array(*map(F.lit, _SHORT)), _part(period, _MONTH, 2)
    year = F.regexp_extract(period, r"^(\d{4})", 1)
    return (
        F.when(period.rlike(_QUARTER), F.concat(F.lit("Q"), F.regexp_extract(period, _QUARTER, 2), F.lit(" "), year))
        .when(period.rlike(_MONTH) & month.between(1, 12), F.concat(F.get(names, month - 1), F.lit(" "), year))
        .otherwise(period)
    )
