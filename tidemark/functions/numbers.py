"""Rounding and parsing that keep the feeds' number semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity: -2.5 gives -2."""
    return F.floor(x + 0.5)


def cents(x: Column) -> Column:
    """Two decimals by floor(100 x + 0.5): the same in any engine, so queries use it."""
    return F.floor(x * 100 + 0.5) / 100


def _half_away(x: Column, digits: Column) -> Column:
    """x, but values exactly between two neighbours of that many digits go to the next double away
    from zero. Just those have one binary digit more than the digits: x * 2^(digits + 1) is odd."""
    doubled = x * F.pow(F.lit(2.0), digits + 1)
    tie = (doubled == F.floor(doubled)) & (F.abs(F.pmod(doubled, F.lit(2.0))) == 1.0)
    return F.when((F.abs(x) < float(1 << 52)) & tie, x * (1 + 2.0**-52)).otherwise(x)


def fixed_text(x: Column, digits: int | Column) -> Column:
    """The exact binary value rounded to digits as text, ties away from zero, always with that many
    decimals and without grouping (1.005 gives 1.00). The JVM's own format rounds the exact value
    too, but ties to even, so ties are moved first. The value is computed once: the lambda's
    variable stands for it."""
    places = digits if isinstance(digits, Column) else F.lit(digits)
    value = F.struct(F.nanvl(x.cast("double"), F.lit(None).cast("double")).alias("x"), places.cast("int").alias("d"))
    shown = lambda s: F.replace(F.call_function("format_number", _half_away(s["x"], s["d"]), s["d"]), F.lit(","), F.lit(""))
    return F.get(F.transform(F.array(value), shown), F.lit(0))


def to_fixed(x: Column, digits: int) -> Column:
    """fixed_text as a number; from 1e21 on the value itself."""
    value = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(value) < 1e21, fixed_text(value, digits).cast("double")).otherwise(value)


def grouped(x: Column) -> Column:
    """Whole numbers with commas, as 12,345."""
    return F.format_number(half_up(x), 0)


def leading_int(text: Column) -> Column:
    """The number that a text begins with, or null: '12abc' gives 12."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def leading_double(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def or_text(x: Column, default: str | Column) -> Column:
    """default for null and for the empty text."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def or_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def signed_change(x: Column, digits: int, suffix: str) -> Column:
    """'+0.3pp', '-1.2%': rounded, with its sign."""
    return F.when(x.isNotNull(), F.concat(F.when(x >= 0, "+").otherwise(""), fixed_text(x, digits), F.lit(suffix)))
