"""Bands and classes of measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ladders import Ladder

# fixed values: upper ends of weather codes, and single codes with their short names
WEATHER_BANDS = [(2, "Partly cloudy"), (3, "Overcast"), (49, "Foggy"), (59, "Drizzle"), (69, "Rain"), (79, "Snow"), (82, "Rain showers"), (86, "Snow showers"), (99, "Thunderstorm")]
WEATHER_CODES = {0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "foggy", 51: "drizzle", 61: "rain", 71: "snow", 80: "rain showers", 95: "thunderstorm"}
SEA_BANDS = [(0.1, "calm"), (0.5, "slight"), (1.25, "moderate"), (2.5, "rough")]
AIR_BANDS = [(50, "good"), (100, "moderate")]
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def banded(x: Column, bands: list[tuple[float, str]], above: str, inclusive: bool = True) -> Column:
    """The first band whose upper end reaches x."""
    return Ladder.upto(bands, above, inclusive).of(x)


def describe_weather(code: Column) -> Column:
    return F.when(code == 0, "Clear sky").otherwise(F.coalesce(banded(code, WEATHER_BANDS, "Unknown"), F.lit("Unknown")))


def describe_weather_short(code: Column) -> Column:
    pairs = [F.lit(x) for pair in WEATHER_CODES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit("variable"))


def air_quality(aqi: Column) -> Column:
    return F.coalesce(banded(aqi, AIR_BANDS, "unhealthy"), F.lit("good"))


def sea_state(wave_height: Column) -> Column:
    return banded(wave_height, SEA_BANDS, "very-rough", inclusive=False)


def wind_direction(degrees: Column) -> Column:
    """One of eight points. A negative angle is turned into 0-360 first."""
    names = F.array(*map(F.lit, COMPASS))
    return F.get(names, F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)).cast("int"))


def visit_type(status: Column) -> Column:
    """cancelled, rejected or completed, by stems of either language; empty counts as completed."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.contains("atcel") | s.contains("cancel"), "cancelled").when(s.contains("noraid") | s.contains("reject"), "rejected").otherwise("completed")
