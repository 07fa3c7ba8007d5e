"""How values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed_text, grouped


#: Decimals that stand for a whole number with commas.
WHOLE = -1


def _by_rule(v: Column, rules: list[tuple[Column, str, float, int, str]]) -> Column:
    """The text of the first rule that fits: (test, before, divisor, decimals, after). Values are
    divided and their decimals chosen first, so one function writes all numbers."""
    before = divisor = digits = after = None
    for test, *parts in reversed(rules):
        fits = F.coalesce(test, F.lit(False))
        chosen = [F.lit(x) for x in parts]
        if before is None:
            before, divisor, digits, after = chosen
        else:
            before, divisor, digits, after = (F.when(fits, x).otherwise(y) for x, y in zip(chosen, (before, divisor, digits, after), strict=True))
    number = F.when(digits == WHOLE, grouped(v)).otherwise(fixed_text(F.when(digits != WHOLE, v / divisor), F.greatest(digits, F.lit(0))))
    return F.concat(before, number, after)


def format_value(v: Column, unit: Column) -> Column:
    """A value by its unit; null gives 'N/A'. The first rule that fits the unit holds."""
    size, euro = F.abs(v), "€"
    rules = [
        (unit == "EUR/month", euro, 1.0, WHOLE, ""),
        (unit == "EUR/hour", euro, 1.0, 1, "/h"),
        ((unit == "persons") & (size >= 1e6), "", 1e6, 2, "M"),
        (unit == "persons", "", 1.0, WHOLE, ""),
        ((unit == "M EUR") & (size >= 1e9), euro, 1e9, 1, "B"),
        ((unit == "M EUR") & (size >= 1e6), euro, 1e6, 0, "M"),
        (unit == "M EUR", euro, 1.0, WHOLE, ""),
        (unit == "MIO_EUR", euro, 1.0, WHOLE, "M"),
        (unit.isin("thousands", "per 1000"), "", 1.0, WHOLE, ""),
        (unit.startswith("index"), "", 1.0, 1, ""),
        (unit == "EUR", euro, 1.0, WHOLE, ""),
        (unit == "EUR/kWh", euro, 1.0, 4, ""),
        (unit == "GWh", "", 1.0, WHOLE, " GWh"),
        (unit.isin("years", "balance"), "", 1.0, 1, ""),
        (unit.startswith("%"), "", 1.0, 1, "%"),
        (size >= 1e6, "", 1e6, 1, "M"),
        (size >= 1000, "", 1.0, WHOLE, ""),
        (F.lit(True), "", 1.0, 1, ""),
    ]
    return F.when(v.isNull(), "N/A").otherwise(_by_rule(v, rules))


def format_tonnes(v: Column) -> Column:
    """1.2M, 3K or a whole number."""
    return _by_rule(v, [(v >= 1e6, "", 1e6, 1, "M"), (v >= 1e3, "", 1e3, 0, "K"), (F.lit(True), "", 1.0, 0, "")])


def shorten(text: Column, most: int) -> Column:
    """Unchanged up to most characters; else up to an early ';', else cut with an ellipsis."""
    at = F.instr(text, ";") - 1
    return (
        F.when(F.length(text) <= most, text)
        .when((at > 0) & (at < most), F.substring(text, F.lit(1), at))
        .otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))
    )


def day_label(day: Column) -> Column:
    """'05 Jan 2024'"""
    return F.date_format(day, "dd MMM yyyy")


def day_range(first: Column, last: Column) -> Column:
    return F.when(first == last, day_label(first)).otherwise(F.concat(day_label(first), F.lit(" – "), day_label(last)))
