import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.operators import word_index
from tidemark.sources import publish


def test_words_against_brute_force(spark, tmp_path):
    chance = random.Random(8)
    words = ["Alpha", "beta", "bet", "Élan", "x1", "the"]
    rows = [(k, " ".join(chance.choices(words, k=chance.randrange(6))), chance.choice(words)) for k in range(300)] + [(None, "beta", "x"), (5, "beta beta", "the"), (301, None, None), (302, "a_b", "c-d")]
    index = word_index.build(spark.createDataFrame(rows, "id long, text string, more string").repartition(3), "id", ["text", "more"], block=40)
    assert index.select("block").distinct().count() > 3 and index.where("keys <> sort_array(array_distinct(keys))").count() == 0
    word_index.save(index, str(tmp_path / "index"))
    saved = word_index.load(spark, str(tmp_path / "index"))
    held = {}
    for k, text, more in rows:
        if k is not None:
            held.setdefault(k, set()).update(f"{text or ''} {more or ''}".lower().replace("_", " ").replace("-", " ").split())
    for query in ("beta", "ALPHA the", "bet*", "bet* élan x1", "b c", "nothing", "x* the alpha"):
        want = sorted(k for k, own in held.items() if all(any(w.startswith(q) if p else w == q for w in own) for q, p in word_index.asked_words(query)))
        assert sorted(r.key for r in word_index.search(saved, query).collect()) == want, query
    assert word_index.search(saved, " *-").count() == 0 and word_index.build(spark.createDataFrame([], "id long, t string"), "id", ["t"]).count() == 0
    plan = word_index.search(saved, "beta")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(word,beta)" in plan


def test_runs_are_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "result")
    with pytest.raises(FileNotFoundError):
        publish.stamp(path)
    publish.publish(spark.range(10).repartition(3), path, "property-x")
    first = publish.stamp(path)
    assert first["rows"] == 10 and first["maxAge"] == 3600 and publish.is_fresh(path) and not publish.is_fresh(path, first["fetchedAt"] + 3601)
    broken = spark.range(20).repartition(4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        publish.publish(broken, path, "property-x")
    assert publish.stamp(path) == first and publish.read(spark, path).count() == 10
    publish.publish(spark.range(3).select("id", F.lit("x").alias("value")), path, "economy")
    assert sorted(map(tuple, publish.read(spark, path).collect())) == [(k, "x") for k in range(3)] and publish.stamp(path)["maxAge"] == 1800
    assert publish.remove_old(path) >= 1 and publish.read(spark, path).count() == 3
    assert len([p for p in (tmp_path / "result").iterdir() if p.name.startswith("run=")]) == 1
    publish.publish(spark.range(3).where("id > 5"), path, "economy")
    assert publish.read(spark, path).columns == ["id"] and publish.read(spark, path).count() == 0


def test_rounding_of_exact_values(spark):
    chance = random.Random(6)
    values = [0.125, -0.125, 2.5, -2.5, 0.5, 1.5, 1.005, 2.675, 1e15 + 0.5, 0.0, -0.0, -0.001, 0.375, 123456.785, 1e20, 8.5e-10]
    values += [chance.uniform(-1e4, 1e4) for _ in range(300)] + [chance.randrange(-4000, 4000) / 2 ** chance.randrange(1, 7) for _ in range(300)]
    rows = [(v, d) for v in values for d in (0, 1, 2, 4)] + [(None, 1), (float("nan"), 1)]
    got = spark.createDataFrame(rows, "x double, d int").select("x", "d", numbers.fixed_text(F.col("x"), F.col("d")).alias("t")).collect()
    for r in got:
        want = None if r.x is None or r.x != r.x else f"{Decimal(r.x).quantize(Decimal(1).scaleb(-r.d), ROUND_HALF_UP):f}"
        assert r.t == want, r
    fixed = spark.createDataFrame([(v,) for v in values] + [(1e22,), (None,)], "x double").select("x", numbers.to_fixed(F.col("x"), 2).alias("y")).collect()
    assert all(r.y == (r.x if r.x is None or abs(r.x) >= 1e21 else float(Decimal(r.x).quantize(Decimal("0.01"), ROUND_HALF_UP))) for r in fixed)
