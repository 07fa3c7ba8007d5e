"""Threshold rules that turn the day's figures into insights.

Each rule is a frame of rank, headline, description, level and category; a rule without input
rows gives none. The first five by rank are shown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import AIR_BANDS, air_quality, describe_weather_short
from tidemark.functions.ladders import Ladder, first_label
from tidemark.functions.numbers import fixed_text
from tidemark.operators.unions import tagged


@dataclass(frozen=True)
class Thresholds:
    # fixed values
    price_spike: float = 100
    price_low: float = 30
    rate_strong: float = 1.12
    rate_weak: float = 1.05
    rate_high: float = 1.15
    rate_low: float = 1.03
    cold: float = -10
    frost: float = 0
    heat: float = 30
    extreme_heat: float = 35
    storm: float = 80


def below(end: float, label: str) -> Ladder:
    return Ladder([(end, False, label)])


def above(end: float, label: str) -> Ladder:
    return Ladder([(end, True, None), (None, True, label)])


def outside(low: float, high: float, label: str) -> Ladder:
    return Ladder([(low, False, label), (high, True, None), (None, True, label)])


def _insight(rank: int, headline: Column, description: Column, level: Column, category: str) -> list[Column]:
    return [F.lit(rank).alias("rank"), headline.alias("headline"), description.alias("description"), level.alias("level"), F.lit(category).alias("category")]


def price_level(current: Column, highest: Column, t: Thresholds = Thresholds()) -> Column:
    return first_label([(current, below(0, "significant")), (highest, above(t.price_spike, "significant"))], "routine")


def rate_level(rate: Column, t: Thresholds = Thresholds()) -> Column:
    return first_label([(rate, outside(t.rate_low, t.rate_high, "notable"))], "routine")


def air_level(aqi: Column) -> Column:
    return F.coalesce(Ladder.upto(zip((end for end, _ in AIR_BANDS), ("routine", "notable")), "significant").of(aqi), F.lit("routine"))


def weather_level(temperature: Column, wind: Column, t: Thresholds = Thresholds()) -> Column:
    return first_label([(temperature, outside(t.cold, t.extreme_heat, "significant")), (wind, above(t.storm, "significant"))], "routine")


def price_summary(prices: DataFrame, hour: int) -> DataFrame:
    """current (first row in the hour, else the average), avg, min and max of a day's prices; no
    row for a day without prices."""
    avg = F.try_divide(F.sum(F.col("price").cast("decimal(28,2)")).cast("double"), F.count("price"))
    now = F.min_by("price", F.when(F.hour("ts") == hour, F.col("ts")))
    return prices.agg(avg.alias("avg"), F.min("price").alias("min"), F.max("price").alias("max"), now.alias("_now"), F.count("*").alias("_n")).where("_n > 0").select(F.coalesce("_now", "avg").alias("current"), "avg", "min", "max")


# fixed values: headlines and descriptions, with places for values; in the order of the rules
ELECTRICITY = {
    "negative": ("Negative electricity price: €{current}/MWh", "Wind/solar overproduction drives prices below zero. Industrial consumers benefit from flexible scheduling. Range: €{min} to €{max}."),
    "spike": ("Electricity price spike: peak €{max}/MWh", "Today's peak is significantly above normal. Average €{avg}/MWh. Consider shifting energy-intensive tasks to off-peak hours."),
    "low": ("Electricity: €{current}/MWh (avg €{avg})", "Day-ahead prices range €{min}–€{max}/MWh. Below seasonal average — favorable for operations."),
    "normal": ("Electricity: €{current}/MWh (avg €{avg})", "Day-ahead prices range €{min}–€{max}/MWh. Within normal Baltic market range."),
}
EXCHANGE = {
    "strong": ("EUR/USD: {rate}", "Euro strengthening against the dollar — favorable for Baltic importers."),
    "weak": ("EUR/USD: {rate}", "Euro weakening — Baltic exporters benefit from cheaper euro-denominated goods."),
    "normal": ("EUR/USD: {rate}", "Exchange rate within normal range. ECB rates updated daily at 16:00 CET."),
}
AIR = {
    "good": ("{city} air quality: Good", "PM2.5: {pm25} µg/m³. Well below WHO guidelines. Outdoor activities recommended."),
    "moderate": ("{city} air quality: Moderate", "PM2.5: {pm25} µg/m³. Sensitive groups should limit prolonged outdoor exposure."),
    "unhealthy": ("{city} air quality: Unhealthy", "PM2.5: {pm25} µg/m³. Consider limiting outdoor activities. Monitor WHO advisories."),
}
WEATHER = {
    "cold": ("{city}: {temperature}°C, {sky}", "Wind {wind} km/h. Severe cold — expect elevated heating demand."),
    "frost": ("{city}: {temperature}°C, {sky}", "Wind {wind} km/h. Below freezing — monitor transport and energy costs."),
    "heat": ("{city}: {temperature}°C, {sky}", "Wind {wind} km/h. Heat wave — increased cooling demand."),
    "normal": ("{city}: {temperature}°C, {sky}", "Wind {wind} km/h. Conditions within seasonal range."),
}


def _told(texts: dict[str, tuple[str, str]], which: Column, values: dict[str, Column]) -> list[Column]:
    """Headline and description of the case that holds, with its values."""
    out = []
    for k in (0, 1):
        text = F.element_at(F.create_map(*[F.lit(x) for case, both in texts.items() for x in (case, both[k])]), which)
        for name, value in values.items():
            text = F.replace(text, F.lit(f"{{{name}}}"), value)
        out.append(text)
    return out


def electricity(day: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """From one row of current, avg, min and max."""
    case = first_label([(F.col("current"), below(0, "negative")), (F.col("max"), above(t.price_spike, "spike")), (F.col("avg"), below(t.price_low, "low"))], "normal")
    values = {k: fixed_text(F.col(k), 2 if k == "current" else 0) for k in ("current", "avg", "min", "max")}
    return day.select(*_insight(1, *_told(ELECTRICITY, case, values), price_level(F.col("current"), F.col("max"), t), "economy"))


def exchange(rates: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rate = F.col("rate")
    case = first_label([(rate, Ladder([(t.rate_weak, False, "weak"), (t.rate_strong, True, None), (None, True, "strong")]))], "normal")
    return rates.where("currency = 'USD'").select(*_insight(2, *_told(EXCHANGE, case, {"rate": fixed_text(rate, 4)}), rate_level(rate, t), "economy"))


def air(observed: DataFrame) -> DataFrame:
    """From a row of city, aqi and pm25."""
    values = {"city": F.col("city"), "pm25": fixed_text(F.col("pm25"), 1)}
    return observed.select(*_insight(3, *_told(AIR, air_quality(F.col("aqi")), values), air_level(F.col("aqi")), "environment"))


def weather(observed: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """From a row of city, temperature, wind_speed and weather_code."""
    temperature = F.col("temperature")
    case = first_label([(temperature, Ladder([(t.cold, False, "cold"), (t.frost, False, "frost"), (t.heat, True, None), (None, True, "heat")]))], "normal")
    values = {"city": F.col("city"), "temperature": fixed_text(temperature, 0), "sky": describe_weather_short(F.col("weather_code")), "wind": fixed_text(F.col("wind_speed"), 0)}
    return observed.select(*_insight(4, *_told(WEATHER, case, values), weather_level(temperature, F.col("wind_speed"), t), "environment"))


def insights(rules: dict[str, DataFrame], n: int = 5) -> DataFrame:
    return tagged(rules, "rule").orderBy("rank").limit(n)


def ticker(current_price: DataFrame, rates: DataFrame, indicators: DataFrame, businesses: DataFrame) -> DataFrame:
    """label, value and change rows of the ticker, in order."""
    price = current_price.select(F.lit(1).alias("rank"), F.lit("Electricity").alias("label"), F.concat(F.lit("€"), fixed_text(F.col("price"), 2), F.lit("/MWh")).alias("value"), F.lit(None).cast("string").alias("change"))
    rate = rates.orderBy("place").limit(4).select(F.lit(2).alias("rank"), F.concat(F.lit("EUR/"), F.col("currency")).alias("label"), fixed_text(F.col("rate"), 4).alias("value"), F.lit(None).cast("string").alias("change"))
    known = indicators.select(F.lit(3).alias("rank"), "label", "value", "change")
    counted = businesses.select(F.lit(4).alias("rank"), F.lit("VAT businesses").alias("label"), F.format_number("total", 0).alias("value"), F.lit(None).cast("string").alias("change"))
    return price.unionByName(rate).unionByName(known).unionByName(counted)
