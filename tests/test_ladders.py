"""Ladders known to the plan and ladders from tables, against a plain search."""

import math
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.ladders import Ladder, looked_up
from tidemark.plans import insights

STEPS = "ladder string, end double, closed boolean, label string"


def plain(steps, x):
    if x is None:
        return None
    for end, closed, label in sorted(steps, key=lambda s: (s[0] is None, s[0] or 0, s[1], s[2])):
        if end is None or x < end or (closed and x == end):
            return label
    return None


XS = [None, -math.inf, -3.0, -0.5, 0.0, 0.5, 1.0, 2.0, 7.0, math.inf, math.nan]
ENDS = st.one_of(st.none(), st.sampled_from([-3.0, -1.0, 0.0, 0.5, 1.0, 2.0, 7.0]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(ENDS, st.booleans(), st.sampled_from("abcdef")), max_size=9))
def test_ladder_of_the_plan(spark, steps):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(XS)], "k int, x double")
    got = dict(rows.select("k", Ladder(steps).of(F.col("x"))).collect())
    assert [got[k] for k in range(len(XS))] == [plain(steps, x) for x in XS]


def ladders_of_three():
    steps = {"a": [(k / 4, k % 3 > 0, f"{k:04}") for k in range(2_500)], "b": [(None, True, "all")], "c": [(1.0, True, "z"), (1.0, True, "y"), (1.0, False, "x"), (1.0, True, "y"), (2.0, True, "w")]}
    return steps, [(name, *s) for name, all_ in steps.items() for s in all_]


def test_ladders_of_a_table_whole_and_in_blocks(spark):
    steps, rows = ladders_of_three()
    xs = [None, math.nan, -1.0, 0.0, 0.25, 0.75, 1.0, 1.1, 2.0, 2.5, 100.0, 100.1, 624.75, 625.0, math.inf]
    asked = [(k, name, x) for k, (name, x) in enumerate(product(["a", "b", "c", "none", None], xs))] * 2
    values = spark.createDataFrame(asked, "end int, ladder string, label double")  # names that clash with the steps'
    table = spark.createDataFrame(rows[::-1], STEPS)
    expected = sorted((k, str(plain(steps.get(name, []), x))) for k, name, x in asked)
    for given_ in ({}, {"whole": 0}, {"whole": 0, "block": 3}):
        found = looked_up(values, table, "ladder", "label", "band", **given_)
        assert found.columns == ["end", "ladder", "label", "band"]
        assert sorted((r.end, str(r.band)) for r in found.collect()) == expected


def test_empty_tables_and_null_steps(spark):
    values = spark.createDataFrame([("a", 1.0)], "ladder string, x double")
    none = spark.createDataFrame([], STEPS)
    odd = spark.createDataFrame([(None, 5.0, True, "no"), ("a", 1.0, None, "closed"), ("a", 0.5, True, None)], STEPS)
    for whole in (0, 10):
        assert [r.band for r in looked_up(values, none, "ladder", "x", "band", whole=whole if whole else -1).collect()] == [None]
        assert [r.band for r in looked_up(values, odd, "ladder", "x", "band", whole=whole).collect()] == ["closed"]
        assert looked_up(values.limit(0), odd, "ladder", "x", "band", whole=whole).collect() == []


def test_rules_are_the_conditions_they_stand_for(spark):
    t = insights.Thresholds()
    xs = [None, -11.0, -10.0, -1.0, 0.0, 1.02, 1.03, 1.05, 1.12, 1.13, 1.15, 1.2, 30.0, 31.0, 35.0, 36.0, 80.0, 81.0, 101.0]
    rows = spark.createDataFrame(list(product(xs, xs)), "x double, y double")
    x, y = F.col("x"), F.col("y")
    pairs = [
        (insights.price_level(x, y), F.when(x < 0, "significant").when(y > t.price_spike, "significant").otherwise("routine")),
        (insights.rate_level(x), F.when((x > t.rate_high) | (x < t.rate_low), "notable").otherwise("routine")),
        (insights.air_level(x), F.when(x > 100, "significant").when(x > 50, "notable").otherwise("routine")),
        (insights.weather_level(x, y), F.when((x < t.cold) | (x > t.extreme_heat) | (y > t.storm), "significant").otherwise("routine")),
    ]
    assert rows.where(~F.greatest(F.lit(False), *(a != b for a, b in pairs)).eqNullSafe(False)).count() == 0
