"""Queries of ladders that are data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ladders
from tidemark.plans.catalogue import _t, query


@query("""WITH s AS (SELECT event_type AS ladder, max(value) AS e, user_id % 50 % 2 = 0 AS closed, 'u' || user_id % 50 AS label FROM events GROUP BY event_type, user_id % 50
UNION ALL SELECT DISTINCT event_type, NULL, true, 'above' FROM events WHERE event_type <> 'click')
SELECT event_id, arg_min(label, (e IS NULL, coalesce(e, 0), closed, label)) AS band FROM events LEFT JOIN s ON event_type = ladder AND (e IS NULL OR value * 1.25 < e OR (closed AND value * 1.25 = e)) GROUP BY event_id
UNION ALL SELECT -event_id - 1, arg_min(label, (e IS NULL, coalesce(e, 0), closed, label)) FROM events LEFT JOIN s ON event_type = ladder AND (e IS NULL OR value < e OR (closed AND value = e)) GROUP BY event_id""")
def q_bands_of_a_table(spark, folder):
    """Each kind of event has a ladder of its own: the highest values of fifty groups of users."""
    events = _t(spark, folder, "events")
    group = F.col("user_id") % 50
    steps = events.groupBy(F.col("event_type").alias("ladder"), group.alias("g")).agg(F.max("value").alias("end"))
    steps = steps.select("ladder", "end", (F.col("g") % 2 == 0).alias("closed"), F.concat(F.lit("u"), F.col("g").cast("string")).alias("label"))
    above = events.where("event_type <> 'click'").select(F.col("event_type").alias("ladder"), F.lit(None).cast("double").alias("end"), F.lit(True).alias("closed"), F.lit("above").alias("label")).distinct()
    raised = events.select("event_id", "event_type", (F.col("value") * 1.25).alias("x"))
    kept = events.select((-F.col("event_id") - 1).alias("event_id"), "event_type", F.col("value").alias("x"))
    return ladders.looked_up(raised.unionByName(kept), steps.unionByName(above), "event_type", "x", "band").select("event_id", "band")


@query("""WITH s AS (SELECT p_retailprice::DOUBLE AS e, min(p_partkey::VARCHAR) AS label FROM part GROUP BY p_retailprice),
v AS (SELECT l_orderkey, l_linenumber, (l_extendedprice / l_quantity)::DOUBLE AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS lines, min(label) AS part FROM v ASOF LEFT JOIN s ON v.x <= s.e GROUP BY l_orderkey, l_linenumber, label""")
def q_bands_of_a_long_ladder(spark, folder):
    """For each line the cheapest part that costs its unit price or more: one ladder of all parts'
    prices, looked up as if it were too long to broadcast."""
    steps = _t(spark, folder, "part").select(F.lit("price").alias("ladder"), F.col("p_retailprice").cast("double").alias("end"), F.lit(True).alias("closed"), F.col("p_partkey").cast("string").alias("label"))
    x = (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    lines = _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.lit("price").alias("ladder"), x.alias("x"))
    found = ladders.looked_up(lines, steps, "ladder", "x", "part", whole=0)
    return found.groupBy("l_orderkey", "l_linenumber", "part").agg(F.count("*").alias("lines"))
