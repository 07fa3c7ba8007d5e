"""Readers of the feeds' payloads (JSON or XML text, one payload a row in column value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import air_quality, describe_weather
from tidemark.functions.numbers import or_zero


def prices(payloads: DataFrame) -> DataFrame:
    """zone, ts, price, in payload order pos."""
    parsed = F.from_json("value", "data map<string, array<struct<timestamp: bigint, price: double>>>")
    zones = payloads.select(F.explode(parsed["data"]).alias("zone", "points"))
    return zones.select("zone", F.posexplode("points").alias("pos", "p")).select("zone", "pos", F.timestamp_seconds("p.timestamp").alias("ts"), F.col("p.price").alias("price"))


def prices_of_day(rows: DataFrame, day: str) -> DataFrame:
    """Prices within a UTC day."""
    first = F.lit(day).cast("timestamp")
    return rows.where((F.col("ts") >= first) & (F.col("ts") < first + F.expr("INTERVAL 1 DAY")))


def exchange_rates(payloads: DataFrame, currencies: DataFrame, *keep: str) -> DataFrame:
    """currency, rate and name of the wanted currencies that a document has, with its columns to keep."""
    pattern = r"currency=['\"]([A-Z]{3})['\"]\s+rate=['\"]([\d.]+)['\"]"
    codes, rates = (F.regexp_extract_all("value", F.lit(pattern), k) for k in (1, 2))
    found = payloads.select(*keep, F.inline(F.arrays_zip(codes.alias("currency"), rates.alias("rate"))))
    return found.select(*keep, "currency", F.col("rate").try_cast("double").alias("rate")).join(F.broadcast(currencies), "currency")


def weather(payloads: DataFrame) -> DataFrame:
    """city and its current weather; what is missing counts as 0."""
    now = F.from_json("value", "current struct<temperature_2m: double, wind_speed_10m: double, relative_humidity_2m: double, weather_code: int>")["current"]
    code = or_zero(now["weather_code"]).cast("int")
    return payloads.select(
        "city", or_zero(now["temperature_2m"]).alias("temperature"), or_zero(now["wind_speed_10m"]).alias("wind_speed"),
        or_zero(now["relative_humidity_2m"]).alias("humidity"), code.alias("weather_code"), describe_weather(code).alias("description"),
    )


def air(payloads: DataFrame) -> DataFrame:
    """pm25, no2, aqi and status; a broken payload gives zeros and 'good'."""
    now = F.from_json("value", "current struct<pm2_5: double, nitrogen_dioxide: double, european_aqi: double>")["current"]
    aqi = or_zero(now["european_aqi"])
    return payloads.select(or_zero(now["pm2_5"]).alias("pm25"), or_zero(now["nitrogen_dioxide"]).alias("no2"), aqi.alias("aqi"), air_quality(aqi).alias("status"))


_MARINE = "wave_height: double, wave_direction: double, wave_period: double, sea_surface_temperature: double, wind_wave_height: double, swell_wave_height: double"


def marine(payloads: DataFrame) -> DataFrame:
    """port_code and its current sea."""
    now = F.from_json("value", f"current struct<{_MARINE}>")["current"]
    return payloads.select("port_code", *[F.coalesce(now[f.split(":")[0].strip()], F.lit(0.0)).alias(f.split(":")[0].strip()) for f in _MARINE.split(",")])


def marine_forecast(payloads: DataFrame) -> DataFrame:
    """port_code, time, wave_height, sea_surface_temperature: parallel arrays as rows."""
    hourly = F.from_json("value", "hourly struct<time: array<string>, wave_height: array<double>, sea_surface_temperature: array<double>>")["hourly"]
    names = ("time", "wave_height", "sea_surface_temperature")
    zipped = F.arrays_zip(*[F.coalesce(hourly[n], F.array().cast("array<string>" if n == "time" else "array<double>")).alias(n) for n in names])
    return payloads.select("port_code", F.inline(zipped))


def port_weather(payloads: DataFrame) -> DataFrame:
    fields = "temperature_2m wind_speed_10m wind_direction_10m cloud_cover precipitation".split()
    now = F.from_json("value", "current struct<" + ", ".join(f"{f}: double" for f in fields) + ">")["current"]
    return payloads.select("port_code", *[F.coalesce(now[f], F.lit(0.0)).alias(f) for f in fields])


def population(payloads: DataFrame, fallback: int) -> DataFrame:
    """The sum over rows in either envelope, or the fallback where it is not above zero."""
    rows = "array<struct<PersonCount: bigint, Count: bigint>>"
    parsed = F.from_json("value", f"value {rows}, d struct<results: {rows}>")
    people = payloads.select(F.explode_outer(F.coalesce(parsed["value"], parsed["d"]["results"])).alias("r"))
    counted = F.sum(F.coalesce(F.nullif("r.PersonCount", F.lit(0)), F.col("r.Count"), F.lit(0)))
    return people.agg(counted.alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(fallback)).cast("long").alias("population"))
