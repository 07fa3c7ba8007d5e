import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, limiter, lookups, scan, series, unions
from tidemark.plans import insights
from tidemark.streaming import price_windows
from tidemark.streaming.limiter import limit_stream


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_summary_of_odd_series(spark):
    data = [("a", "1", 1.0), ("a", "2", 3.005), ("a", "3", None), ("b", "1", None), ("c", "1", -2.0)]
    frame = spark.createDataFrame(data, "geo string, period string, value double")
    got = {r.geo: tuple(r)[1:] for r in series.summary(frame, ["geo"]).collect()}
    assert got["a"][:2] == (3.005, 1.0) and got["a"][3] == 1.0 and got["a"][-1] == 2
    assert got["b"] == (None, None, None, None, None, None, 0)
    assert got["c"] == (-2.0, None, None, -2.0, -2.0, -2.0, 1)
    assert series.summary(frame.limit(0), ["geo"]).count() == 0


def test_changes_and_last_rows(spark):
    data = [("a", k, None if k == 2 else float(k)) for k in range(1, 8)]
    frame = spark.createDataFrame(data, "geo string, period int, value double")
    assert [r.change for r in series.change(frame, ["geo"]).orderBy("period").collect()] == [None, 2.0, 1.0, 1.0, 1.0, 1.0]
    assert series.change(frame, ["geo"], 4, percent=True).orderBy(F.desc("period")).first().change == pytest.approx(4 / 3 * 100)
    assert [r.period for r in series.last_n(frame, ["geo"], 2).orderBy("period").collect()] == [6, 7]
    assert series.last_n(frame, ["geo"], 0).count() == series.last_years(frame, ["geo"], None, F.lit(1)).count() == 7
    assert series.last_years(frame, ["geo"], 1, series.per_year(F.lit("Q"))).count() == 4
    assert series.last_years(frame, ["geo"], 1, series.per_year(F.lit("Q"), F.lit("population"))).count() == 7
    assert tuple(series.latest_known(frame, ["geo"]).first()) == ("a", 7, 7.0)


def test_align(spark):
    frame = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 2.0), ("a", "2", 3.0)], "geo string, period string, value double")
    assert sorted(rows_of(series.align(frame, ["a", "b"]))) == [("1", 1.0, 2.0), ("2", 3.0, None)]


def test_groups(spark):
    frame = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0), (None, 0.0), ("", 4.0)], "k string, v double")
    assert rows_of(groups.top_counts(frame, "k")) == [("Unknown", 2), ("x", 2), ("y", 1)]
    totals = groups.shares(spark.createDataFrame([("x", 0.5), ("y", 199.5)], "k string, total double"))
    assert [(r.k, r.share, r.bar) for r in totals.orderBy("k").collect()] == [("x", 0.25, 1.0), ("y", 99.75, 100.0)]
    assert groups.shares(spark.createDataFrame([("x", 0.0)], "k string, total double")).first().share is None
    assert groups.statistics(frame.limit(0), "v").first()["avg"] is None
    visits = spark.createDataFrame([("p", "s", "", 1), ("p", "s", "2024-01-01", 2), ("p", "s", "2024-01-01", 3)], "port string, ship string, day string, pos int")
    assert groups.keep_latest(visits, ["port", "ship"], "day", F.asc("pos")).first().pos == 2
    nested = groups.nest(spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), (None, 1, "z")], "company string, ord int, owner string"), "company", ["ord"], ["owner"])
    assert {r.company: [o.owner for o in r.children] for r in nested.collect()} == {"c": ["a", "b"], "unknown": ["z"]}


@pytest.mark.parametrize("up, want", [(6, "healthy"), (5, "degraded"), (3, "degraded"), (2, "unhealthy")])
def test_health(spark, up, want):
    checks = spark.createDataFrame([("healthy" if k < up else "down", True) for k in range(6)] + [("down", False)], "status string, required boolean")
    assert groups.health(checks).first().status == want


def test_lookups_and_unions(spark):
    names = spark.createDataFrame([("1", "one")], "code string, name string")
    codes = spark.createDataFrame([("1",), ("2",)], "code string")
    assert sorted(r.name for r in lookups.name_or(codes, names, "code", "name", F.concat(F.lit("Type "), "code")).collect()) == ["Type 2", "one"]
    linked = spark.createDataFrame([("a", ["b", "gone"]), ("b", [])], "id string, related array<string>")
    assert rows_of(lookups.related(linked, linked.select("id"))) == [("b", "a")]
    empty = codes.limit(0)
    assert unions.first_with_rows(empty, codes).count() == 2 and unions.first_with_rows(codes.limit(1), codes).count() == 1


def test_scan(spark):
    lines = spark.createDataFrame([("# note",), ("",), (" secret  # why",), ("re:[0-9]{3}",), ("secret",)], "value string")
    assert sorted(rows_of(scan.parse_patterns(lines))) == [("[0-9]{3}", True), ("secret", False)]
    texts = spark.createDataFrame([(1, "a\nmy secret 12\n123"), (2, None)], "id int, text string")
    assert sorted(rows_of(scan.scan_lines(texts, [("secret", False), ("[0-9]{3}", True)], "id"))) == [(1, 2, "secret"), (1, 3, "[0-9]{3}")]
    diff = spark.createDataFrame([(1, "+++ f\n+key key\n-key\n key")], "id int, text string")
    assert rows_of(scan.diff_occurrences(diff, "key", "id")) == [(1, 3)]
    assert rows_of(scan.occurrences(texts, "e", "id", regex=False)) == [(1, 2), (2, None)]
    hits = spark.createDataFrame([("p", "c2"), ("p", "c1"), ("p", "c1")], "pattern string, commit string")
    assert rows_of(scan.commits_per_pattern(hits, 1)) == [("p", 2, ["c1"])]
    assert [r[0] for r in spark.createDataFrame([(b"a\x00",), (b"a",)], "content binary").select(scan.is_binary()).collect()] == [True, False]


def hits(seed, n=400):
    chance = random.Random(seed)
    return sorted((t, k, f"ip{k % 3}") for k, t in enumerate(sorted(chance.randrange(0, 300_000) for _ in range(n))))


def model(rows, limit, window=60_000):
    kept, out = {}, {}
    for t, k, key in rows:
        own = kept[key] = [x for x in kept.get(key, []) if x >= t - window]
        out[k] = len(own) < limit
        if out[k]:
            own.append(t)
    return out


def test_limiter_against_a_model(spark):
    rows = hits(1) + [(600_000 + k, 1000 + k, "edge") for k in (0, 1, 2)] + [(660_000, 1003, "edge"), (660_001, 1004, "edge")]
    frame = spark.createDataFrame([(k, key, t) for t, k, key in rows], "id long, key string, ts_ms long")
    got = limiter.limit_hits(frame, limit=3).collect()
    assert {r.id: r.accepted for r in got} == model(rows, 3)
    assert not next(r.accepted for r in got if r.id == 1003)  # exactly one window old still counts
    assert next(r.accepted for r in got if r.id == 1004)
    assert all(r.retry_after >= 0 if r.id == 1003 else r.retry_after > 0 for r in got if not r.accepted)
    assert [limiter.parse_limit(x) for x in ("5", "0", "x", None)] == [5, 60, 60, 60]


def test_limiter_stream(spark, tmp_path):
    rows = hits(2, 200)
    folder = str(tmp_path / "in")
    spark.createDataFrame([(key, t, k) for t, k, key in rows], "key string, ts_ms long, id long").coalesce(1).write.parquet(folder)
    stream = limit_stream(spark.readStream.schema("key string, ts_ms long, id long").parquet(folder), limit=3)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    # time-outs keep a stream busy after its last row, so wait for the rows
    until = time.time() + 120
    while spark.table("limited").count() < len(rows) and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert {r.id: r.accepted for r in spark.table("limited").collect()} == model(rows, 3)


def test_price_windows(spark):
    frame = spark.createDataFrame([("lv", "2024-01-01 00:05:00", 1.0), ("lv", "2024-01-01 00:55:00", 3.0), ("lv", "2024-01-01 01:05:00", 5.0)], "zone string, ts string, price double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r.n, r["avg"]) for r in price_windows.tumbling(frame).collect()) == [(1, 5.0), (2, 2.0)]
    assert price_windows.sliding(frame).count() > 2 and price_windows.sessions(frame).count() == 2


def level(spark, column, **values):
    return spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_rule_levels(spark):
    price = insights.price_level(F.col("now"), F.col("top"))
    assert [level(spark, price, now=n, top=t) for n, t in ((-1, 10), (5, 101), (5, 100), (0, 0))] == ["significant", "significant", "routine", "routine"]
    assert [level(spark, insights.rate_level(F.col("r")), r=r) for r in (1.16, 1.15, 1.03, 1.02)] == ["notable", "routine", "routine", "notable"]
    weather = insights.weather_level(F.col("t"), F.col("w"))
    assert [level(spark, weather, t=t, w=w) for t, w in ((-11, 0), (-10, 0), (35, 80), (36, 0), (0, 81))] == ["significant", "routine", "routine", "significant", "significant"]


def test_insights_skip_missing_inputs(spark):
    prices = spark.createDataFrame([], "ts timestamp, price double")
    rates = spark.createDataFrame([("USD", 1.2)], "currency string, rate double")
    air = spark.createDataFrame([("Riga", 60.0, 4.25)], "city string, aqi double, pm25 double")
    weather = spark.createDataFrame([("Riga", 32.0, 10.0, 3)], "city string, temperature double, wind_speed double, weather_code int")
    got = insights.insights({"p": insights.electricity(insights.price_summary(prices, 9)), "r": insights.exchange(rates), "a": insights.air(air), "w": insights.weather(weather)}).collect()
    assert [(r.rank, r.level) for r in got] == [(2, "notable"), (3, "notable"), (4, "routine")]
    assert got[0].headline == "EUR/USD: 1.2000" and got[1].headline == "Riga air quality: Moderate" and "Heat wave" in got[2].description


def test_window_counts_over_stretches(spark):
    import random

    chance = random.Random(2)
    hits = [(k, chance.choice(["a", "a", "a", "b", None]), chance.randrange(0, 20_000)) for k in range(600)]
    hits += [(1000 + k, "a", 60 * 32 * 5 + d) for k, d in enumerate((-61, -60, -59, -1, 0, 0, 1, 59, 60, 61))]
    frame = spark.createDataFrame(hits, "id int, key string, s int").selectExpr("id", "key", "timestamp_seconds(s) AS ts", "s", "id AS _key", "id AS _at")
    got = {r.id: r.hits for r in limiter.window_counts(frame).collect()}
    assert got == {i: sum(k2 == k and s - 60 <= s2 <= s for _, k2, s2 in hits) for i, k, s in hits}
