from pyspark.sql import functions as F

from tidemark.functions import classify, formats, numbers, periods, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


# fixed values: how values are shown
SHOWN = [
    (None, "%", "N/A"), (1523.0, "EUR/month", "€1,523"), (21.1, "EUR/hour", "€21.1/h"), (1890000.0, "persons", "1.89M"), (605802.0, "persons", "605,802"),
    (2.5e9, "M EUR", "€2.5B"), (1.2e6, "M EUR", "€1M"), (3500.0, "M EUR", "€3,500"), (2.3, "% YoY", "2.3%"), (-1.5, "%", "-1.5%"), (152.4, "index (2020=100)", "152.4"),
    (0.2288, "EUR/kWh", "€0.2288"), (12345.0, "GWh", "12,345 GWh"), (78.5, "years", "78.5"), (-3.2, "balance", "-3.2"), (5e6, "widgets", "5.0M"), (12500.0, "widgets", "12,500"), (3.7, "widgets", "3.7"),
]


def test_format_value(spark):
    got = values(spark, [(v, u, w) for v, u, w in SHOWN], "v double, unit string, want string", formats.format_value(F.col("v"), F.col("unit")), "want")
    assert [g for g, _ in got] == [w for _, w in got]


def test_to_fixed_rounds_the_exact_value(spark):
    rows = [(1.005,), (2.675,), (0.125,), (-2.5,), (None,), (float("nan"),)]
    got = values(spark, rows, "x double", numbers.to_fixed(F.col("x"), 2))
    assert [g[0] for g in got] == [1.0, 2.67, 0.13, -2.5, None, None]


def test_half_up_and_leading_numbers(spark):
    assert values(spark, [(-2.5,), (2.5,), (2.4,)], "x double", numbers.half_up(F.col("x"))) == [(-2,), (3,), (2,)]
    got = values(spark, [("12abc",), ("",), (" -3.5x",), (None,)], "s string", numbers.leading_int(F.col("s")), numbers.leading_double(F.col("s")))
    assert got == [(12, 12.0), (None, None), (-3, -3.5), (None, None)]
    assert values(spark, [(0.25,), (-1.24,), (None,)], "x double", numbers.signed_change(F.col("x"), 1, "pp")) == [("+0.3pp",), ("-1.2pp",), (None,)]


def test_periods(spark):
    rows = [(p,) for p in ("2024Q1", "2024-Q3", "2024M3", "2024-12", "2024", "2024-S2", "week 3", "2024-13", None)]
    p = F.col("p")
    got = values(spark, rows, "p string", periods.frequency(p), periods.period_start(p).cast("string"), periods.format_period(p))
    assert got == [
        ("Q", "2024-01-01", "Q1 2024"), ("Q", "2024-07-01", "Q3 2024"), ("M", "2024-03-01", "Mar 2024"), ("M", "2024-12-01", "Dec 2024"), ("A", "2024-01-01", "2024"),
        ("S", "2024-07-01", "2024-S2"), (None, None, "week 3"), ("M", None, "2024-13"), (None, None, None),
    ]


def test_bands_at_their_ends(spark):
    x = F.col("x")
    assert [r[0] for r in values(spark, [(50.0,), (51.0,), (100.0,), (101.0,)], "x double", classify.air_quality(x))] == ["good", "moderate", "moderate", "unhealthy"]
    assert [r[0] for r in values(spark, [(0.05,), (0.1,), (0.5,), (1.25,), (2.5,)], "x double", classify.sea_state(x))] == ["calm", "slight", "moderate", "rough", "very-rough"]
    codes = [0, 1, 2, 3, 45, 49, 50, 59, 60, 69, 70, 79, 80, 82, 83, 86, 87, 99, 100]
    got = [r[0] for r in values(spark, [(c,) for c in codes], "x int", classify.describe_weather(x))]
    assert got == ["Clear sky", "Partly cloudy", "Partly cloudy", "Overcast", "Foggy", "Foggy", "Drizzle", "Drizzle", "Rain", "Rain", "Snow", "Snow", "Rain showers", "Rain showers", "Snow showers", "Snow showers", "Thunderstorm", "Thunderstorm", "Unknown"]
    assert [r[0] for r in values(spark, [(0.0,), (22.5,), (337.5,), (359.0,), (-45.0,)], "x double", classify.wind_direction(x))] == ["N", "NE", "N", "N", "NW"]
    assert [r[0] for r in values(spark, [(61,), (62,)], "x int", classify.describe_weather_short(x))] == ["rain", "variable"]
    assert [r[0] for r in values(spark, [("Atcelts",), ("REJECTED",), ("",), (None,)], "x string", classify.visit_type(x))] == ["cancelled", "rejected", "completed", "completed"]


def test_texts(spark):
    s = F.col("s")
    assert values(spark, [("9 / 8 / MV A",), ("MV B",), ("9 / 8",)], "s string", text.ship_parts(s)) == [(("9", "8", "MV A"),), (("MV B", "", "MV B"),), (("9", "8", "9 / 8"),)]
    assert [r[0] for r in values(spark, [("RĪGAS BŪVVALDE",), ("Ogres novada",), (None,)], "s string", text.municipality(s))] == ["RĪGAS", "Ogres nov.", "Unknown"]
    assert [r[0] for r in values(spark, [("abcdef",), ("abc; defgh",), ("abcdefghijk",)], "s string", formats.shorten(s, 8))] == ["abcdef", "abc", "abcdefg…"]
    assert [r[0] for r in values(spark, [(1.25e6,), (3400.0,), (12.5,)], "x double", formats.format_tonnes(F.col("x")))] == ["1.3M", "3K", "13"]
    assert values(spark, [("1.1.1.1, 2.2.2.2", None), (None, "3.3.3.3"), ("", "")], "f string, c string", text.client_ip(F.col("f"), F.col("c"))) == [("1.1.1.1",), ("3.3.3.3",), ("unknown",)]
    assert [r[0] for r in values(spark, [("a<Envelope><x:Cube/>",), ("<Envelope>",)], "s string", text.has_envelope(s))] == [True, False]
    assert [r[0] for r in values(spark, [(" SIA 'Rīga', 5! ",)], "s string", text.clean_query(s))] == ["SIA Rīga 5"]
