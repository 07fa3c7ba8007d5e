"""Every registered query with its DuckDB counterpart, over whole tables.

The tables hold orders and events instead of indicator feeds: a region's monthly order value
stands for a series, events for prices (zone, ts, price), hits and port visits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import classify, formats, numbers, periods, text
from tidemark.operators import groups, limiter, lookups, scan, series, unions
from tidemark.plans import insights
from tidemark.sources import feeds, jsonstat, probes, registry, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name; {m} and {q} in the SQL are the series' CTEs."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("{m}", _SERIES_M).replace("{q}", _SERIES_Q)
        return f

    return add


_JOINED = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"
_SERIES_M = f"series_m AS (SELECT r_name AS geo, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value {_JOINED})"
_SERIES_Q = f"series_q AS (SELECT r_name AS geo, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value {_JOINED})"


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _series(spark: SparkSession, folder: str, quarterly: bool = False) -> DataFrame:
    day = F.col("o_orderdate")
    period = F.concat(F.year(day), F.lit("-Q"), F.quarter(day)) if quarterly else F.date_format(day, "yyyy-MM")
    orders = _t(spark, folder, "orders").select("o_custkey", period.alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    places = _t(spark, folder, "nation").join(_t(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("geo"))
    owned = _t(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "geo")
    return orders.join(owned, F.col("o_custkey") == F.col("c_custkey")).groupBy("geo", "period").agg(F.sum("price").cast("double").alias("value"))


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "events").select(F.col("event_type").alias("zone"), "ts", F.col("value").alias("price"), "event_id")


# ---- series ----


@query("""WITH {m}, r AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM series_m)
SELECT geo, latest, previous, floor((latest - previous) * 100 + 0.5) / 100 AS change, floor(lo * 100 + 0.5) / 100 AS min, floor(hi * 100 + 0.5) / 100 AS max, floor(s / n * 100 + 0.5) / 100 AS avg, n AS count
FROM (SELECT geo, max(value) FILTER (k = 1) AS latest, max(value) FILTER (k = 2) AS previous, min(value) AS lo, max(value) AS hi, sum(value::DECIMAL(28,2))::DOUBLE AS s, count(value) AS n FROM r GROUP BY geo)""")
def q_series_summary(spark, folder):
    return series.summary(_series(spark, folder), ["geo"])


@query("""WITH {m}, f AS (SELECT geo, arg_min(value, period) AS base FROM series_m GROUP BY geo)
SELECT geo, period, value / base * 100 - 100.0 AS growth FROM series_m JOIN f USING (geo)""")
def q_index_to_growth(spark, folder):
    base = F.first("value").over(Window.partitionBy("geo").orderBy("period"))
    return _series(spark, folder).select("geo", "period", series.index_to_growth(F.col("value") / base * 100).alias("growth"))


_CHANGE = "WITH {%s} SELECT geo, period, value, lag(value, %d) OVER w AS before, %s AS change FROM series_%s WINDOW w AS (PARTITION BY geo ORDER BY period)"


@query(_CHANGE % ("m", 1, "value - lag(value, 1) OVER w", "m"))
def q_period_change(spark, folder):
    return series.change(_series(spark, folder), ["geo"])


@query(_CHANGE % ("q", 4, "value - lag(value, 4) OVER w", "q"))
def q_yoy_quarterly_pp(spark, folder):
    return series.change(_series(spark, folder, True), ["geo"], 4)


@query(_CHANGE % ("q", 4, "(value - lag(value, 4) OVER w) / lag(value, 4) OVER w * 100", "q"))
def q_yoy_quarterly_pct(spark, folder):
    return series.change(_series(spark, folder, True), ["geo"], 4, percent=True)


@query(_CHANGE % ("m", 12, "value - lag(value, 12) OVER w", "m"))
def q_yoy_monthly(spark, folder):
    return series.change(_series(spark, folder), ["geo"], 12)


@query("WITH {q} SELECT geo, period, value, before, change FROM (SELECT geo, period, value, lag(value, 4) OVER w AS before, value - lag(value, 4) OVER w AS change, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM series_q WINDOW w AS (PARTITION BY geo ORDER BY period)) WHERE k = 1")
def q_latest_change(spark, folder):
    return series.latest_change(_series(spark, folder, True), ["geo"], 4)


_LAST = "WITH {m} SELECT geo, period, value FROM (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM series_m) WHERE k <= %d"


@query(_LAST % 20)
def q_last_n_per_series(spark, folder):
    return series.last_n(_series(spark, folder), ["geo"], 20)


@query(_LAST % 12)
def q_last_n_per_series_table(spark, folder):
    return series.last_n(_series(spark, folder), ["geo"], 12)


@query(_LAST % 36)
def q_last_years(spark, folder):
    return series.last_years(_series(spark, folder), ["geo"], 3, series.per_year(F.lit("M")))


@query("WITH {m} SELECT geo, period, value FROM series_m WHERE period >= (SELECT (substr(max(period), 1, 4)::INT - 3)::VARCHAR || '-01' FROM series_m)")
def q_since_years(spark, folder):
    rows = _series(spark, folder).withColumn("period_start", periods.period_start(F.col("period")))
    # the last year is one row of the same plan
    last = rows.agg(F.year(F.max("period_start")).alias("_last"))
    kept = rows.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("period_start") >= F.make_date(F.col("_last") - 3, F.lit(1), F.lit(1))))
    return kept.select("geo", "period", "value")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("WITH {m} SELECT period, " + ", ".join(f"""max(value) FILTER (geo = '{r}') AS "{r}" """ for r in _REGIONS) + " FROM series_m GROUP BY period")
def q_pivot_compare(spark, folder):
    return series.align(_series(spark, folder), _REGIONS)


@query("WITH {m} SELECT geo, max(period) AS period, arg_max(value, period) AS value FROM series_m GROUP BY geo")
def q_latest_per_geo(spark, folder):
    return series.latest_known(_series(spark, folder), ["geo"])


@query("WITH {q} SELECT geo, period, 'Q' || substr(period, 7, 1) || ' ' || substr(period, 1, 4) AS label, 'Q' AS freq, substr(period, 1, 4) || '-' || lpad((3 * substr(period, 7, 1)::INT - 2)::VARCHAR, 2, '0') || '-01' AS start FROM series_q")
def q_format_period(spark, folder):
    period = F.col("period")
    start = periods.period_start(period).cast("string")
    return _series(spark, folder, True).select("geo", "period", periods.format_period(period).alias("label"), periods.frequency(period).alias("freq"), start.alias("start"))


# ---- groups ----


@query("SELECT n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY count DESC, n_name LIMIT 15")
def q_topk_count(spark, folder):
    counted = _t(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("count"))
    named = counted.join(_t(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "n_name").limit(15)


@query("SELECT coalesce(nullif(p_brand, ''), 'Unknown') AS p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, 1 LIMIT 8")
def q_topk_brands(spark, folder):
    return groups.top_counts(_t(spark, folder, "part"), "p_brand", 8)


@query("WITH c AS (SELECT p_type, count(*) AS count FROM part GROUP BY 1) SELECT p_type, count, greatest((SELECT count(*) FROM c) - 8, 0)::BIGINT AS more FROM c ORDER BY count DESC, p_type LIMIT 8")
def q_topk_with_remainder(spark, folder):
    return groups.top_with_rest(_t(spark, folder, "part"), "p_type", 8)


_QUANTITY = "SELECT p_type, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type"


def _quantity(spark, folder):
    sold = _t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))
    return groups.sums(sold.join(_t(spark, folder, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")), ["p_type"], "quantity")


@query(_QUANTITY)
def q_group_sum(spark, folder):
    return _quantity(spark, folder)


@query(f"WITH t AS ({_QUANTITY}) SELECT p_type, total, total * 100 / sum(total::DECIMAL(38,2)) OVER ()::DOUBLE AS share, greatest(total * 100 / max(total) OVER (), 1.0) AS bar FROM t")
def q_share_of_total(spark, folder):
    return groups.shares(_quantity(spark, folder))


@query("SELECT s.n_name AS origin, c.n_name AS destination, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey GROUP BY 1, 2")
def q_route_totals(spark, folder):
    nation = _t(spark, folder, "nation")
    origin = _t(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("origin"))
    buyer = _t(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("destination"))
    orders = _t(spark, folder, "orders").select("o_orderkey", "o_custkey").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    lines = _t(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(origin, F.col("l_suppkey") == F.col("s_suppkey"))
    return groups.sums(joined, ["origin", "destination"], "l_quantity")


@query("SELECT sum(value::DECIMAL(28,2))::DOUBLE AS total, min(value) AS min, max(value) AS max, sum(value::DECIMAL(28,2))::DOUBLE / count(value) AS avg, count(value) AS count FROM events")
def q_global_stats(spark, folder):
    return groups.statistics(_t(spark, folder, "events"), "value")


@query("SELECT CASE WHEN s > 0 THEN s ELSE 605802.0 END AS total FROM (SELECT sum(coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END, l_extendedprice, 0)::DECIMAL(18,2))::DOUBLE AS s FROM lineitem)")
def q_sum_coalesce(spark, folder):
    rows = _t(spark, folder, "lineitem").select(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"))
    return groups.sum_first_known(rows, ["a", "b"], 605802.0)


@query("SELECT count(*) AS visits, count(DISTINCT event_type || '-' || user_id) AS kept, count(DISTINCT event_type) AS ports FROM events")
def q_dedupe_counts(spark, folder):
    pairs = _t(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return pairs.agg(F.sum("n").alias("visits"), F.count("*").alias("kept"), F.count_distinct("event_type").alias("ports"))


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def q_date_range(spark, folder):
    return groups.date_range(_t(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day")


@query("SELECT event_type AS port, user_id AS ship, strftime(ts, '%Y-%m-%d %H:%M:%S') AS visit, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id) AS k FROM events) WHERE k = 1")
def q_dedupe_latest(spark, folder):
    visits = _t(spark, folder, "events").select(F.col("event_type").alias("port"), F.col("user_id").alias("ship"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("visit"), "event_id")
    return groups.keep_latest(visits, ["port", "ship"], "visit", F.asc("event_id"))


@query("SELECT event_type, event_id, value, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 5")
def q_topn_per_group(spark, folder):
    return groups.top_n_per_group(_t(spark, folder, "events").select("event_type", "event_id", "value"), ["event_type"], 5, F.desc("value"), F.asc("event_id"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def q_nested_owners(spark, folder):
    nested = groups.nest(_t(spark, folder, "conversations"), "conv_id", ["turn", "role"], ["turn", "role"], name="turns")
    return nested.select(F.col("conv_id").cast("long").alias("conv_id"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"), "n_turns")


@query("""WITH h AS (SELECT event_type, count(*) AS total, count(*) FILTER (value >= 20) AS healthy, count(*) FILTER (event_id % 3 > 0) AS required, count(*) FILTER (event_id % 3 > 0 AND value >= 20) AS required_healthy, count(*) FILTER (event_id % 3 = 0) AS optional, count(*) FILTER (event_id % 3 = 0 AND value >= 20) AS optional_healthy FROM events GROUP BY 1)
SELECT *, CASE WHEN required_healthy = required THEN 'healthy' WHEN required_healthy >= ceil(required / 2) THEN 'degraded' ELSE 'unhealthy' END AS status FROM h""")
def q_health_rollup(spark, folder):
    checks = _t(spark, folder, "events").select("event_type", F.when(F.col("value") >= 20, "healthy").otherwise("down").alias("status"), (F.col("event_id") % 3 > 0).alias("required"))
    return groups.health(checks, ["event_type"])


@query("SELECT arg_min(event_type, event_id) AS event_type FROM events")
def q_first_value(spark, folder):
    return groups.first_row(_t(spark, folder, "events"), "event_type", "event_id")


# ---- filters, projections, lookups, unions ----


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#11'")
def q_filter_eq(spark, folder):
    return registry.exact(_t(spark, folder, "part"), "p_brand", "Brand#11").select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_filter_in(spark, folder):
    return _t(spark, folder, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT DISTINCT l_shipdate::DATE::VARCHAR AS day FROM lineitem WHERE l_shipdate IS NOT NULL")
def q_distinct_nonempty(spark, folder):
    return groups.distinct_known(_t(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")), "day")


@query("SELECT doc_id::VARCHAR AS id, coalesce(nullif(lang, ''), 'xx') AS language, coalesce(nullif(nullif(source, 'src1'), ''), 'none') AS origin FROM documents")
def q_project_defaults(spark, folder):
    rows = _t(spark, folder, "documents").select("doc_id", "lang", F.nullif("source", F.lit("src1")).alias("source"))
    return registry.with_defaults(rows.withColumn("doc_id", F.col("doc_id").cast("string")), {"id": ("doc_id", ""), "language": ("lang", "xx"), "origin": ("source", "none")})


_FLAGS = [("A", "Accepted"), ("R", "Returned")]


@query("SELECT l_returnflag AS code, coalesce(f.name, 'Type ' || l_returnflag) AS name, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem LEFT JOIN (VALUES ('A', 'Accepted'), ('R', 'Returned')) f(code, name) ON l_returnflag = f.code GROUP BY 1, 2")
def q_lookup_left_default(spark, folder):
    names = F.broadcast(spark.createDataFrame(_FLAGS, "code string, name string"))
    totals = groups.sums(_t(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "code"), ["code"], "l_quantity")
    return lookups.name_or(totals, names, "code", "name", F.concat(F.lit("Type "), F.col("code"))).select("code", "name", "total")


@query("SELECT l_returnflag AS code, name, count(*) AS count FROM lineitem JOIN (VALUES ('A', 'Accepted'), ('R', 'Returned')) f(code, name) ON l_returnflag = f.code GROUP BY 1, 2")
def q_lookup_inner(spark, folder):
    names = F.broadcast(spark.createDataFrame(_FLAGS, "code string, name string"))
    counted = _t(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("count"))
    return lookups.named_only(counted, names, "code").select("code", "name", "count")


@query("SELECT n_nationkey AS nation, n_name, c AS customers, s AS suppliers FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) a ON n_nationkey = a.k JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON n_nationkey = b.k")
def q_three_way_inner(spark, folder):
    customers = _t(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    suppliers = _t(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return lookups.three_way(_t(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"), customers, suppliers, "nation")


@query("""SELECT a.n_nationkey AS "from", o AS id, b.n_name AS name FROM (SELECT n_nationkey, unnest([(n_nationkey + 1), (n_nationkey + 20)]) AS o FROM nation) a JOIN nation b ON a.o = b.n_nationkey""")
def q_related(spark, folder):
    nation = _t(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    linked = nation.withColumn("related", F.array(F.col("id") + 1, F.col("id") + 20))
    return lookups.related(linked, nation)


@query("SELECT n_nationkey AS id, coalesce(m.s, CASE WHEN n_regionkey = 3 THEN 'national' END) AS source FROM nation LEFT JOIN (VALUES (0, 'compared'), (7, 'compared'), (12, 'compared')) m(k, s) ON n_nationkey = m.k")
def q_source_fallback(spark, folder):
    mapped = F.broadcast(spark.createDataFrame([(k, "compared") for k in (0, 7, 12)], "id int, source string"))
    nation = _t(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey")
    return lookups.first_source(nation, mapped, "id", F.when(F.col("n_regionkey") == 3, "national")).select("id", "source")


@query("SELECT event_id, event_type, '2024-01-05' AS snapshot FROM events WHERE day(ts) = 5 UNION ALL SELECT event_id, event_type, '2024-01-06' FROM events WHERE day(ts) = 6")
def q_union_snapshots(spark, folder):
    events = _t(spark, folder, "events")
    parts = [(events.where(F.dayofmonth("ts") == d).select("event_id", "event_type"), f"2024-01-0{d}") for d in (5, 6)]
    return registry.snapshots(parts).select("event_id", "event_type", F.col("snapshot_date").cast("string").alias("snapshot"))


@query("SELECT o_orderkey, 'IN' AS tag FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'OUT' FROM orders WHERE o_orderstatus = 'O'")
def q_union_tagged(spark, folder):
    orders = _t(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return unions.tagged({t: orders.where(F.col("o_orderstatus") == s).select("o_orderkey") for t, s in (("IN", "F"), ("OUT", "O"))}, "tag")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period FROM orders UNION SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem")
def q_union_distinct(spark, folder):
    a, b = (_t(spark, folder, t).select(F.date_format(c, "yyyy-MM").alias("period")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))
    return unions.distinct(a.distinct(), b.distinct())


@query("""SELECT 1 AS rank, 'Electricity' AS label, '€' || printf('%.2f', max(value)) || '/MWh' AS value, NULL::VARCHAR AS change FROM events
UNION ALL SELECT * FROM (SELECT 2, 'EUR/' || substr(n_name, 1, 3), printf('%.4f', 1 + n_nationkey / 7), NULL FROM nation ORDER BY n_nationkey LIMIT 4)
UNION ALL SELECT 3, r_name, r_regionkey::VARCHAR, '+' || r_regionkey FROM region
UNION ALL SELECT 4, 'VAT businesses', format('{:,}', count(*)), NULL FROM customer""")
def q_ticker_union(spark, folder):
    price = _t(spark, folder, "events").agg(F.max("value").alias("price"))
    rates = _t(spark, folder, "nation").select(F.substring("n_name", 1, 3).alias("currency"), (1 + F.col("n_nationkey") / 7).alias("rate"), F.col("n_nationkey").alias("place"))
    known = _t(spark, folder, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").cast("string").alias("value"), F.concat(F.lit("+"), F.col("r_regionkey")).alias("change"))
    return insights.ticker(price, rates, known, registry.total(_t(spark, folder, "customer")))


_SEARCH = """WITH parts AS (SELECT p_partkey::VARCHAR AS number, p_name FROM part), exact AS (SELECT * FROM parts WHERE number = '{0}' AND regexp_full_match('{0}', '[0-9]+'))
SELECT * FROM exact UNION ALL SELECT * FROM parts WHERE contains(lower(number || ' ' || p_name), lower('{0}')) AND NOT EXISTS (SELECT 1 FROM exact)"""


def _search(spark, folder, text: str) -> DataFrame:
    """Digits ask for the number first; other texts, and numbers that there aren't, for any text."""
    parts = _t(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("number"), "p_name")
    parts = parts.withColumn("all", F.concat_ws(" ", "number", "p_name"))
    return registry.search(parts, "number", ["all"], text).drop("all")


@query(_SEARCH.format("7"))
def q_search_exact_then_text(spark, folder):
    return _search(spark, folder, "7")


@query(_SEARCH.format("077"))
def q_search_falls_back_to_text(spark, folder):
    return _search(spark, folder, "077")


@query(_SEARCH.format("RED wid"))
def q_search_text_only(spark, folder):
    return _search(spark, folder, "RED wid")


@query("SELECT max(n_name) FILTER (n_regionkey <> 2) AS id FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_regionkey <> 2)")
def q_latest_active_resource(spark, folder):
    nation = _t(spark, folder, "nation")
    return registry.latest_active(nation.select(F.col("n_name").alias("id"), (F.col("n_regionkey") != 2).alias("datastore_active"), F.col("n_nationkey").alias("pos")))


@query("SELECT count(*) AS total FROM lineitem")
def q_total(spark, folder):
    return registry.total(_t(spark, folder, "lineitem"))


# ---- prices and rules ----

_DAY, _HOUR = "2024-01-10", 9


@query("SELECT event_type AS zone, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, hour(ts)::INT AS hour, hour(ts) = 9 AS is_current, value AS price FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def q_hourly_prices(spark, folder):
    start = F.lit(_DAY).cast("timestamp_ntz")
    day = _prices(spark, folder).where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    return day.select("zone", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.hour("ts").alias("hour"), (F.hour("ts") == _HOUR).alias("is_current"), "price")


_FIRST_N = "WITH d AS (SELECT event_id, value AS price FROM events WHERE ts >= TIMESTAMP '{0}' AND ts < TIMESTAMP '{0}' + INTERVAL 1 DAY) SELECT * FROM d UNION ALL SELECT * FROM (SELECT event_id, value FROM events ORDER BY event_id LIMIT 24) WHERE NOT EXISTS (SELECT 1 FROM d)"


@query(_FIRST_N.format(_DAY))
def q_day_or_first_n(spark, folder):
    return unions.day_or_first(_prices(spark, folder), _DAY, 24, F.asc("event_id")).select("event_id", "price")


@query(_FIRST_N.format("2031-01-01"))
def q_day_or_first_n_empty(spark, folder):
    return unions.day_or_first(_prices(spark, folder), "2031-01-01", 24, F.asc("event_id")).select("event_id", "price")


@query("SELECT event_type AS zone, coalesce(arg_min(value, ts) FILTER (hour(ts) = 9), 0.0) AS price FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1")
def q_current_hour_price(spark, folder):
    start = F.lit(_DAY).cast("timestamp_ntz")
    day = _prices(spark, folder).where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    return day.groupBy("zone").agg(F.coalesce(F.min_by("price", F.when(F.hour("ts") == _HOUR, F.col("ts"))), F.lit(0.0)).alias("price"))


@query("""WITH d AS (SELECT ts, value AS price FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'),
p AS (SELECT coalesce(arg_min(price, ts) FILTER (hour(ts) = 9), sum(price::DECIMAL(28,2))::DOUBLE / count(price)) AS current, sum(price::DECIMAL(28,2))::DOUBLE / count(price) AS avg, min(price) AS min, max(price) AS max FROM d HAVING count(*) > 0)
SELECT 1 AS rank, 'electricity' AS rule, CASE WHEN current < 0 THEN 'Negative electricity price: €' || printf('%.2f', current) || '/MWh' WHEN max > 100 THEN 'Electricity price spike: peak €' || printf('%.0f', max) || '/MWh' ELSE 'Electricity: €' || printf('%.2f', current) || '/MWh (avg €' || printf('%.0f', avg) || ')' END AS headline,
 CASE WHEN current < 0 THEN 'Wind/solar overproduction drives prices below zero. Industrial consumers benefit from flexible scheduling. Range: €' || printf('%.0f', min) || ' to €' || printf('%.0f', max) || '.' WHEN max > 100 THEN 'Today''s peak is significantly above normal. Average €' || printf('%.0f', avg) || '/MWh. Consider shifting energy-intensive tasks to off-peak hours.'
 ELSE 'Day-ahead prices range €' || printf('%.0f', min) || '–€' || printf('%.0f', max) || '/MWh. ' || CASE WHEN avg < 30 THEN 'Below seasonal average — favorable for operations.' ELSE 'Within normal Baltic market range.' END END AS description,
 CASE WHEN current < 0 OR max > 100 THEN 'significant' ELSE 'routine' END AS level, 'economy' AS category FROM p
UNION ALL SELECT 2, 'exchange', 'EUR/USD: ' || printf('%.4f', r), CASE WHEN r > 1.12 THEN 'Euro strengthening against the dollar — favorable for Baltic importers.' WHEN r < 1.05 THEN 'Euro weakening — Baltic exporters benefit from cheaper euro-denominated goods.' ELSE 'Exchange rate within normal range. ECB rates updated daily at 16:00 CET.' END,
 CASE WHEN r > 1.15 OR r < 1.03 THEN 'notable' ELSE 'routine' END, 'economy' FROM (SELECT 1 + n_nationkey / 64 AS r FROM nation WHERE n_nationkey = 15)
UNION ALL SELECT 3, 'air', n_name || ' air quality: ' || CASE WHEN a > 100 THEN 'Unhealthy' WHEN a > 50 THEN 'Moderate' ELSE 'Good' END, 'PM2.5: 4.0 µg/m³. ' || CASE WHEN a > 100 THEN 'Consider limiting outdoor activities. Monitor WHO advisories.' WHEN a > 50 THEN 'Sensitive groups should limit prolonged outdoor exposure.' ELSE 'Well below WHO guidelines. Outdoor activities recommended.' END,
 CASE WHEN a > 100 THEN 'significant' WHEN a > 50 THEN 'notable' ELSE 'routine' END, 'environment' FROM (SELECT n_name, n_nationkey * 3 AS a FROM nation WHERE n_nationkey = 20)
UNION ALL SELECT 4, 'weather', n_name || ': ' || t::VARCHAR || '°C, overcast', 'Wind ' || w::VARCHAR || ' km/h. ' || CASE WHEN t < -10 THEN 'Severe cold — expect elevated heating demand.' WHEN t < 0 THEN 'Below freezing — monitor transport and energy costs.' WHEN t > 30 THEN 'Heat wave — increased cooling demand.' ELSE 'Conditions within seasonal range.' END,
 CASE WHEN t < -10 OR t > 35 OR w > 80 THEN 'significant' ELSE 'routine' END, 'environment' FROM (SELECT n_name, n_nationkey - 25 AS t, n_nationkey AS w FROM nation WHERE n_nationkey = 10)""")
def q_insight_rules(spark, folder):
    start, nation = F.lit(_DAY).cast("timestamp_ntz"), _t(spark, folder, "nation")
    day = _prices(spark, folder).where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    k, city = F.col("n_nationkey"), F.col("n_name").alias("city")
    rules = {
        "electricity": insights.electricity(insights.price_summary(day, _HOUR)),
        "exchange": insights.exchange(nation.where(k == 15).select(F.lit("USD").alias("currency"), (1 + k / 64).alias("rate"))),
        "air": insights.air(nation.where(k == 20).select(city, (k * 3).cast("double").alias("aqi"), F.lit(4.0).alias("pm25"))),
        "weather": insights.weather(nation.where(k == 10).select(city, (k - 25).cast("double").alias("temperature"), k.cast("double").alias("wind_speed"), F.lit(3).alias("weather_code"))),
    }
    return insights.insights(rules).select("rank", "rule", "headline", "description", "level", "category")


# ---- scalars ----


@query("""SELECT event_id, CASE WHEN value > 100 THEN 'unhealthy' WHEN value > 50 THEN 'moderate' ELSE 'good' END AS air,
CASE WHEN value / 20 < 0.1 THEN 'calm' WHEN value / 20 < 0.5 THEN 'slight' WHEN value / 20 < 1.25 THEN 'moderate' WHEN value / 20 < 2.5 THEN 'rough' ELSE 'very-rough' END AS sea,
CASE WHEN event_id % 110 = 0 THEN 'Clear sky' WHEN event_id % 110 <= 2 THEN 'Partly cloudy' WHEN event_id % 110 <= 3 THEN 'Overcast' WHEN event_id % 110 <= 49 THEN 'Foggy' WHEN event_id % 110 <= 59 THEN 'Drizzle' WHEN event_id % 110 <= 69 THEN 'Rain' WHEN event_id % 110 <= 79 THEN 'Snow' WHEN event_id % 110 <= 82 THEN 'Rain showers' WHEN event_id % 110 <= 86 THEN 'Snow showers' WHEN event_id % 110 <= 99 THEN 'Thunderstorm' ELSE 'Unknown' END AS sky,
CASE event_id % 110 WHEN 0 THEN 'clear sky' WHEN 1 THEN 'mainly clear' WHEN 2 THEN 'partly cloudy' WHEN 3 THEN 'overcast' WHEN 45 THEN 'foggy' WHEN 51 THEN 'drizzle' WHEN 61 THEN 'rain' WHEN 71 THEN 'snow' WHEN 80 THEN 'rain showers' WHEN 95 THEN 'thunderstorm' ELSE 'variable' END AS sky_short FROM events""")
def q_classify_bands(spark, folder):
    v, code = F.col("value"), F.col("event_id") % 110
    return _t(spark, folder, "events").select(
        "event_id", classify.air_quality(v).alias("air"), classify.sea_state(v / 20).alias("sea"), classify.describe_weather(code).alias("sky"), classify.describe_weather_short(code).alias("sky_short")
    )


@query("SELECT event_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(floor((event_id % 360) / 45 + 0.5)::INT % 8) + 1] AS wind FROM events")
def q_compass(spark, folder):
    return _t(spark, folder, "events").select("event_id", classify.wind_direction(F.col("event_id") % 360).alias("wind"))


@query("SELECT o_orderkey, CASE WHEN contains(s, 'cancel') THEN 'cancelled' WHEN contains(s, 'reject') THEN 'rejected' ELSE 'completed' END AS type FROM (SELECT o_orderkey, lower(CASE o_orderstatus WHEN 'F' THEN 'Cancelled' WHEN 'P' THEN 'REJECTED' ELSE '' END) AS s FROM orders)")
def q_visit_type(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "Cancelled").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("")
    return _t(spark, folder, "orders").select("o_orderkey", classify.visit_type(status).alias("type"))


@query("""WITH v AS (SELECT c_nationkey % 7 AS k, c_nationkey AS nation, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS v FROM customer GROUP BY 1, 2)
SELECT nation, CASE k
 WHEN 0 THEN CASE WHEN abs(v) >= 1e6 THEN printf('%.2f', v / 1e6) || 'M' ELSE format('{:,}', floor(v + 0.5)::BIGINT) END
 WHEN 1 THEN '€' || format('{:,}', floor(v + 0.5)::BIGINT)
 WHEN 2 THEN format('{:,}', floor(v + 0.5)::BIGINT) || ' GWh'
 WHEN 3 THEN '€' || format('{:,}', floor(v + 0.5)::BIGINT) || 'M'
 WHEN 4 THEN format('{:,}', floor(v + 0.5)::BIGINT)
 WHEN 5 THEN CASE WHEN abs(v) >= 1e6 THEN printf('%.1f', v / 1e6) || 'M' WHEN abs(v) >= 1000 THEN format('{:,}', floor(v + 0.5)::BIGINT) ELSE printf('%.1f', v) END
 ELSE '€' || printf('%.4f', v / 3) END AS shown FROM v""")
def q_format_value(spark, folder):
    totals = groups.sums(_t(spark, folder, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], "c_acctbal")
    units = F.array(*map(F.lit, ["persons", "EUR/month", "GWh", "MIO_EUR", "thousands", "widgets", "EUR/kWh"]))
    k = F.col("nation") % 7
    shown = formats.format_value(F.when(k == 6, F.col("total") / 3).otherwise(F.col("total")), F.get(units, k))
    return totals.select("nation", shown.alias("shown"))


@query("""SELECT p_type, CASE WHEN t >= 1e6 THEN printf('%.1f', t / 1e6) || 'M' WHEN t >= 1e3 THEN printf('%.0f', t / 1e3) || 'K' ELSE printf('%.0f', t) END AS shown
FROM (SELECT p_type, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / 7 AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""")
def q_format_tonnes(spark, folder):
    sold = _t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    totals = groups.sums(sold.join(_t(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")), ["p_type"], "price")
    return totals.select("p_type", formats.format_tonnes(F.col("total") / 7).alias("shown"))


_SHORT = "CASE WHEN length({0}) <= 30 THEN {0} WHEN instr({0}, ';') - 1 > 0 AND instr({0}, ';') - 1 < 30 THEN substr({0}, 1, instr({0}, ';') - 1) ELSE substr({0}, 1, 29) || '…' END"


@query(f"SELECT doc_id, {_SHORT.format('text')} AS short, {_SHORT.format('s')} AS named FROM (SELECT doc_id, text, source || ';' || text AS s FROM documents)")
def q_truncate(spark, folder):
    named = F.concat("source", F.lit(";"), "text")
    return _t(spark, folder, "documents").select("doc_id", formats.shorten(F.col("text"), 30).alias("short"), formats.shorten(named, 30).alias("named"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_nationkey::VARCHAR END AS imo, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'x' END AS mmsi, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN s_nationkey || ' / ' || s_name ELSE s_name END AS name FROM supplier")
def q_parse_split(spark, folder):
    nation, name, kind = F.col("s_nationkey").cast("string"), F.col("s_name"), F.col("s_suppkey") % 3
    ship = F.when(kind == 0, name).when(kind == 1, F.concat_ws(" / ", nation, name)).otherwise(F.concat_ws(" / ", nation, F.lit("x"), name))
    return _t(spark, folder, "supplier").select("s_suppkey", text.ship_parts(ship).alias("p")).select("s_suppkey", "p.*")


@query("SELECT event_id, 'A' || event_id AS raw, NULL::INT AS a, event_id::INT AS b, (event_id / 8)::DOUBLE AS c FROM events")
def q_leading_numbers(spark, folder):
    n = F.col("event_id").cast("string")
    raw, cut = F.concat(F.lit("A"), n), F.concat(F.lit(" "), n, F.lit("abc"))
    eighth = F.concat((F.col("event_id") / 8).cast("decimal(18,3)").cast("string"), F.lit(" t"))
    return _t(spark, folder, "events").select("event_id", raw.alias("raw"), numbers.leading_int(raw).alias("a"), numbers.leading_int(cut).alias("b"), numbers.leading_double(eighth).alias("c"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7 + 0.5)::BIGINT AS whole, floor(l_extendedprice / 7 * 100 + 0.5) / 100 AS cents, (l_extendedprice >= 50000) AS up FROM lineitem")
def q_rounding(spark, folder):
    x = F.col("l_extendedprice") / 7
    return _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", numbers.half_up(x).alias("whole"), numbers.cents(x).alias("cents"), (F.col("l_extendedprice") >= 50000).alias("up"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '10.0.0.' || s_suppkey WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE s_name END AS ip FROM supplier")
def q_client_ip(spark, folder):
    k = F.col("s_suppkey")
    forwarded = F.when(k % 2 == 0, F.concat(F.lit(" 10.0.0."), k, F.lit(" , 10.9.9.9")))
    return _t(spark, folder, "supplier").select("s_suppkey", text.client_ip(forwarded, F.when(k % 5 != 0, F.col("s_name"))).alias("ip"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN n_name || ' nov.' ELSE n_name || ' x' END AS name FROM nation")
def q_municipality(spark, folder):
    name, kind = F.col("n_name"), F.col("n_nationkey") % 3
    raw = F.when(kind == 0, F.concat(name, F.lit(" BŪVVALDE"))).when(kind == 1, F.concat(name, F.lit(" novada"))).otherwise(F.concat(name, F.lit(" x ")))
    return _t(spark, folder, "nation").select("n_nationkey", text.municipality(raw).alias("name"))


@query("SELECT n_nationkey, n_name AS who, 'x' AS provider FROM nation")
def q_principal(spark, folder):
    body = F.to_json(F.struct(F.col("n_name").alias("userDetails"), F.lit("x").alias("identityProvider")))
    rows = _t(spark, folder, "nation").select("n_nationkey", text.principal(F.base64(body.cast("binary"))).alias("p"))
    return rows.select("n_nationkey", F.col("p.userDetails").alias("who"), F.col("p.identityProvider").alias("provider"))


# ---- text, JSON, hits ----


@query("SELECT page_id, regexp_matches(html, '(?i)<\\s*(\\w+:)?article\\b') AND regexp_matches(html, '(?i)<\\s*(\\w+:)?h1\\b') AS has_article, regexp_matches(html, '(?i)<\\s*(\\w+:)?Envelope\\b') AND regexp_matches(html, '(?i)<\\s*(\\w+:)?Cube\\b') AS has_envelope FROM pages")
def q_markup_probe(spark, folder):
    html = F.col("html")
    has = html.rlike(r"(?i)<\s*(\w+:)?article\b") & html.rlike(r"(?i)<\s*(\w+:)?h1\b")
    return _t(spark, folder, "pages").select("page_id", has.alias("has_article"), text.has_envelope(html).alias("has_envelope"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def q_regexp_extract(spark, folder):
    return _t(spark, folder, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line::INT AS line, 'password=' AS pattern FROM l WHERE contains(lower(s), 'password=')
UNION ALL SELECT doc_id, line::INT, 'AKIA[A-Z0-9]{16}' FROM l WHERE regexp_matches(s, 'AKIA[A-Z0-9]{16}', 'i')
UNION ALL SELECT doc_id, line::INT, '[a-z0-9.]+@[a-z0-9.]+' FROM l WHERE regexp_matches(s, '[a-z0-9.]+@[a-z0-9.]+', 'i')""")
def q_scan_patterns(spark, folder):
    return scan.scan_lines(_t(spark, folder, "documents"), [("password=", False), ("AKIA[A-Z0-9]{16}", True), ("[a-z0-9.]+@[a-z0-9.]+", True)], "doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS count FROM documents")
def q_count_occurrences(spark, folder):
    return scan.occurrences(_t(spark, folder, "documents"), "[0-9]+", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_without_ignored(spark, folder):
    return scan.without(_t(spark, folder, "documents").select("doc_id"), _t(spark, folder, "labels"), "doc_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS hits FROM events")
def q_sliding_count_60s(spark, folder):
    return limiter.window_counts(_t(spark, folder, "events").select("event_id", "user_id", "ts"), 60, "user_id").select("event_id", "hits")


@query("SELECT count(DISTINCT user_id) AS tracked FROM events")
def q_tracked_keys(spark, folder):
    return limiter.tracked_keys(_t(spark, folder, "events"), "user_id")


@query()
def q_rate_limiter(spark, folder):
    """Three hits a day and user: acceptance is recursive, and so is its SQL (plans.streams)."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    hits = _t(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), at.alias("ts_ms"))
    return limiter.limit_hits(hits, limit=3, window=86_400_000)


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def q_json_field(spark, folder):
    return _t(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT event_type AS zone, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, min(value) AS min, max(value) AS max, sum(value::DECIMAL(28,2))::DOUBLE / count(value) AS avg FROM events GROUP BY 1, 2""")
def q_price_windows(spark, folder):
    from tidemark.streaming.price_windows import tumbling

    rows = tumbling(_prices(spark, folder))
    return rows.select("zone", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "min", "max", "avg")


# ---- cubes: the series as JSON-stat texts, and back ----


def _cube(spark, folder, sparse: bool = False, turned: bool = False) -> DataFrame:
    """One JSON-stat cube of the monthly series: freq, geo and time (turned: time before geo);
    sparse: without the cells of June. Places follow the reversed names of regions."""
    cells = _series(spark, folder)
    if sparse:
        cells = cells.where(~F.col("period").endswith("-06"))
    axes = _series(spark, folder).agg(F.sort_array(F.collect_set("geo"), False).alias("geos"), F.sort_array(F.collect_set("period")).alias("periods"))
    g, t = F.array_position("geos", F.col("geo")) - 1, F.array_position("periods", F.col("period")) - 1
    at = t * F.size("geos") + g if turned else g * F.size("periods") + t
    flat = cells.crossJoin(F.broadcast(axes)).select("geos", "periods", at.cast("int").alias("at"), "value")
    cube = flat.groupBy("geos", "periods").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "value")))).alias("cells"))

    def category(names: Column, label: Column) -> Column:
        index = F.map_from_arrays(names, F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: k - 1))
        return F.struct(F.struct(index.alias("index"), label.alias("label")).alias("category"))

    geos, periods = F.col("geos"), F.col("periods")
    labels = F.map_from_arrays(F.slice(geos, 1, 2), F.transform(F.slice(geos, 1, 2), lambda x: F.initcap(x)))
    none = F.lit(None).cast("map<string, string>")
    dims = F.create_map(F.lit("freq"), category(F.array(F.lit("M")), none), F.lit("geo"), category(geos, labels), F.lit("time"), category(periods, none))
    names, sizes = (["freq", "time", "geo"], [F.size(periods), F.size(geos)]) if turned else (["freq", "geo", "time"], [F.size(geos), F.size(periods)])
    cells_of = F.col("cells") if sparse else F.transform(F.sequence(F.lit(0), F.size(geos) * F.size(periods) - 1), lambda k: F.try_element_at("cells", k))
    body = F.struct(F.array(*map(F.lit, names)).alias("id"), F.array(F.lit(1), *sizes).alias("size"), dims.alias("dimension"), cells_of.alias("value"))
    return cube.select(F.lit("orders").alias("cube"), F.to_json(body).alias("value"))


_CUBE = """WITH {{m}}, axes AS (SELECT geo, period FROM (SELECT DISTINCT geo FROM series_m), (SELECT DISTINCT period FROM series_m))
SELECT geo, CASE WHEN geo IN ('MIDDLE EAST', 'EUROPE') THEN upper(geo[1]) || lower(geo[2:]) ELSE geo END AS label, period, (dense_rank() OVER (ORDER BY period) - 1)::INT AS place, {0} AS value
FROM axes LEFT JOIN series_m USING (geo, period) {1}"""


def _decoded(cube: DataFrame, **options) -> DataFrame:
    rows = jsonstat.decode(jsonstat.parse_cubes(cube), **options)
    return rows.select("geo", F.when(F.col("label") == "Middle East", "Middle east").otherwise(F.col("label")).alias("label"), "period", "place", "value")


@query(_CUBE.format("value", ""))
def q_cube_dense(spark, folder):
    return _decoded(_cube(spark, folder))


@query(_CUBE.format("CASE WHEN period NOT LIKE '%-06' THEN value END", ""))
def q_cube_sparse(spark, folder):
    return _decoded(_cube(spark, folder, sparse=True, turned=True))


@query(_CUBE.format("value", "WHERE geo IN ('ASIA', 'EUROPE')"))
def q_cube_of_some_places(spark, folder):
    return _decoded(_cube(spark, folder, turned=True), geos=["ASIA", "EUROPE"])


@query("WITH {m}, p AS (SELECT DISTINCT period FROM series_m), one AS (SELECT * FROM series_m WHERE geo = (SELECT max(geo) FROM series_m)) SELECT period, (dense_rank() OVER (ORDER BY period) - 1)::INT AS place, value FROM p LEFT JOIN one USING (period)")
def q_cube_positional(spark, folder):
    return jsonstat.decode_positional(jsonstat.parse_cubes(_cube(spark, folder))).select("period", "place", "value")


# ---- fixed values beside rows, probes, sinks ----


@query("""SELECT n_nationkey, c.city, c.lat, c.lon, c.zone FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'ee' WHEN 1 THEN 'lt' WHEN 2 THEN 'lv' ELSE 'xx' END AS k FROM nation)
JOIN (VALUES ('lv', 'Riga', 56.95::DOUBLE, 24.11::DOUBLE, 'Europe/Riga'), ('ee', 'Tallinn', 59.44, 24.75, 'Europe/Tallinn'), ('lt', 'Vilnius', 54.69, 25.28, 'Europe/Vilnius')) c(country, city, lat, lon, zone) ON c.country = CASE WHEN k = 'xx' THEN 'lv' ELSE k END""")
def q_capital_or_default(spark, folder):
    countries = F.array(*map(F.lit, ["ee", "lt", "lv", "xx"]))
    asked = _t(spark, folder, "nation").select("n_nationkey", F.get(countries, F.col("n_nationkey") % 4).alias("country"))
    return lookups.or_default_row(asked, catalog.capitals(spark), "country", catalog.DEFAULT_COUNTRY).select("n_nationkey", "city", "lat", "lon", "zone")


@query("""SELECT event_id, CASE level WHEN 'routine' THEN 'Routine' WHEN 'notable' THEN 'Notable' ELSE 'Significant' END AS label, CASE level WHEN 'routine' THEN '🟢' WHEN 'notable' THEN '🟡' ELSE '🔴' END AS emoji,
CASE WHEN code = 0 THEN '☀️' WHEN code IN (1, 2) THEN '⛅' WHEN code = 3 THEN '☁️' ELSE '🌡️' END AS icon, CASE status WHEN 'moderate' THEN 'yellow' WHEN 'unhealthy' THEN 'red' ELSE 'emerald' END AS colour
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'routine' WHEN 1 THEN 'notable' ELSE 'significant' END AS level, event_id % 5 AS code, CASE event_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'moderate' WHEN 2 THEN 'unhealthy' ELSE 'none' END AS status FROM events)""")
def q_badges_and_icons(spark, folder):
    def one_of(values: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int"))

    rows = _t(spark, folder, "events").select(
        "event_id", one_of(["routine", "notable", "significant"]).alias("level"), one_of(["Clear sky", "Partly cloudy", "Partly cloudy", "Overcast", "Haze"]).alias("description"),
        one_of(["good", "moderate", "unhealthy", "none"]).alias("status"),
    )
    rows = lookups.or_default_row(rows, catalog.badges(spark), "level", "routine")
    rows = lookups.or_default_row(rows, catalog.air_colours(spark), "status", "good")
    return lookups.name_or(rows, F.broadcast(catalog.icons(spark)), "description", "icon", F.lit(catalog.OTHER_ICON)).select("event_id", "label", "emoji", "icon", "colour")


@query("""SELECT page_id AS name, CASE WHEN page_id % 3 = 0 AND contains(html, '<html') THEN 'unhealthy' WHEN page_id % 3 = 1 THEN 'healthy' WHEN page_id % 3 = 2 THEN 'unhealthy' ELSE 'unhealthy' END AS status, page_id % 2 = 0 AS required,
CASE page_id % 3 WHEN 0 THEN 'missing required elements' WHEN 1 THEN NULL ELSE 'timed out' END AS error FROM pages""")
def q_probe_status(spark, folder):
    k = F.col("page_id") % 3
    body = F.when(k == 0, F.col("html")).when(k == 1, F.to_json(F.struct("url")))
    answers = _t(spark, folder, "pages").select(F.col("page_id").alias("name"), F.when(k == 0, "xml").otherwise("json").alias("kind"), (F.col("page_id") % 2 == 0).alias("required"), body.alias("body"), F.when(k == 2, "timed out").alias("error"))
    return probes.judged(answers)


@query("SELECT event_id, value FROM events WHERE event_id % 7 <> 0")
def q_fulfilled_only(spark, folder):
    answers = _t(spark, folder, "events").select("event_id", "value", F.when(F.col("event_id") % 7 == 0, "no answer").alias("error"))
    return lookups.fulfilled(answers)


@query("SELECT r_regionkey, r_name, 'public, max-age=900' AS cache_control, '2024-01-10T09:00:00.000Z' AS fetched_at FROM region")
def q_json_sink(spark, folder):
    sent = snapshots.as_json(_t(spark, folder, "region").select("r_regionkey", "r_name"), "environment-lv", "row", F.lit("2024-01-10 09:00:00").cast("timestamp_ntz"))
    back = sent.select(F.from_json("value", "row struct<r_regionkey: int, r_name: string>, cacheControl string, fetchedAt string").alias("j"))
    return back.select("j.row.r_regionkey", "j.row.r_name", F.col("j.cacheControl").alias("cache_control"), F.col("j.fetchedAt").alias("fetched_at"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9_\s" + text.LETTERS + r"-]', '', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def q_clean_query(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", text.clean_query(F.col("text")).alias("cleaned"))


# ---- feeds: payloads made of rows, and back ----


def _payload(value: Column, *more: Column):
    return lambda rows: rows.select(*more, F.to_json(value).alias("value"))


@query("SELECT event_type AS zone, 0 AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value AS price FROM events WHERE value IS NOT NULL")
def q_feed_prices(spark, folder):
    point = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("price"))
    sent = _payload(F.struct(F.create_map("event_type", F.array(point)).alias("data")))(_t(spark, folder, "events").where("value IS NOT NULL"))
    return feeds.prices(sent).select("zone", "pos", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "price")


_MONEY = ", ".join(f"('{code}', '{name}')" for code, name in catalog.CURRENCIES)


@query(f"SELECT c_custkey, currency, 1 + c_custkey % 64 / 64 AS rate, name FROM (SELECT c_custkey, unnest([['USD', 'GBP', 'SEK', 'XXX'][1 + (c_custkey % 4)::INT], 'PLN']) AS currency FROM customer) JOIN (VALUES {_MONEY}) v(currency, name) USING (currency)")
def q_feed_rates(spark, folder):
    code, rate = F.get(F.array(*map(F.lit, ["USD", "GBP", "SEK", "XXX"])), (F.col("c_custkey") % 4).cast("int")), (1 + F.col("c_custkey") % 64 / 64).cast("string")
    body = F.concat(F.lit("<Cube><Cube currency='"), code, F.lit("' rate='"), rate, F.lit("'/><Cube currency='PLN' rate='"), rate, F.lit("'/></Cube>"))
    sent = _t(spark, folder, "customer").select("c_custkey", body.alias("value"))
    return feeds.exchange_rates(sent, catalog.currencies(spark), "c_custkey").select("c_custkey", "currency", "rate", "name")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 OR value IS NULL THEN 0 ELSE value END AS temperature, CASE WHEN event_id % 5 = 0 OR event_id % 2 = 1 THEN 0 ELSE event_id END::DOUBLE AS wind_speed,
CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 100 END::INT AS weather_code FROM events""")
def q_feed_weather(spark, folder):
    k = F.col("event_id")
    now = F.struct(F.col("value").alias("temperature_2m"), F.when(k % 2 == 0, k.cast("double")).alias("wind_speed_10m"), (k % 100).cast("int").alias("weather_code"))
    sent = _t(spark, folder, "events").select("event_id", k.alias("city"), F.when(k % 5 == 0, "no answer").otherwise(F.to_json(F.struct(now.alias("current")))).alias("value"))
    return feeds.weather(sent).select(F.col("city").alias("event_id"), "temperature", "wind_speed", "weather_code")


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / 4 END AS pm25, CASE WHEN event_id % 5 = 0 OR value IS NULL THEN 0 ELSE value END AS aqi, CASE WHEN event_id % 5 = 0 OR value IS NULL OR value <= 50 THEN 'good' WHEN value <= 100 THEN 'moderate' ELSE 'unhealthy' END AS status FROM events WHERE value IS NOT NULL")
def q_feed_air(spark, folder):
    now = F.struct((F.col("value") / 4).alias("pm2_5"), F.col("value").alias("european_aqi"))
    rows = _t(spark, folder, "events").where("value IS NOT NULL")
    sent = rows.select(F.when(F.col("event_id") % 5 == 0, "no answer").otherwise(F.to_json(F.struct(now.alias("current")))).alias("value"))
    return feeds.air(sent).select("pm25", "aqi", "status")


@query("SELECT s_suppkey AS port_code, h AS time, CASE WHEN h = 'b' THEN s_acctbal ELSE s_acctbal / 2 END AS wave_height, CASE WHEN h = 'a' THEN s_nationkey END::DOUBLE AS sea_surface_temperature FROM supplier, (VALUES ('a'), ('b')) v(h)")
def q_feed_marine(spark, folder):
    hourly = F.struct(
        F.array(F.lit("a"), F.lit("b")).alias("time"), F.array(F.col("s_acctbal") / 2, F.col("s_acctbal")).alias("wave_height"), F.array(F.col("s_nationkey").cast("double")).alias("sea_surface_temperature")
    )
    return feeds.marine_forecast(_payload(F.struct(hourly.alias("hourly")), F.col("s_suppkey").alias("port_code"))(_t(spark, folder, "supplier")))


@query("SELECT sum(CASE WHEN c_nationkey <> 0 THEN c_nationkey ELSE 3 END + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS population FROM customer")
def q_feed_population(spark, folder):
    people = F.array(F.struct(F.col("c_nationkey").cast("long").alias("PersonCount"), F.lit(3).cast("long").alias("Count")), F.struct(F.lit(None).cast("long").alias("PersonCount"), F.when(F.col("c_custkey") % 2 == 0, 2).cast("long").alias("Count")))
    value = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.struct(people.alias("results")).alias("d")))).otherwise(F.to_json(F.struct(people.alias("value"))))
    return feeds.population(_t(spark, folder, "customer").select(value.alias("value")), catalog.POPULATION["lv"])


# ---- labels, times to live, pattern files ----


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS day, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d %b %Y') ELSE strftime(o_orderdate, '%d %b %Y') || ' – ' || strftime(o_orderdate + INTERVAL 3 DAY, '%d %b %Y') END AS days FROM orders")
def q_day_labels(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return _t(spark, folder, "orders").select("o_orderkey", formats.day_label(day).alias("day"), formats.day_range(day, F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.date_add(day, 3))).alias("days"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0 THEN '+' ELSE '' END || printf('%.2f', x) || 'pp' AS change FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 7 AS x FROM lineitem)")
def q_signed_change(spark, folder):
    return _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", numbers.signed_change((F.col("l_quantity") - 25) / 7, 2, "pp").alias("change"))


@query("""WITH k AS (SELECT event_id, ts, ['economy-lv', 'property', 'environment-ee', 'other'][1 + (event_id % 4)::INT] AS cache_key FROM events)
SELECT event_id, cache_key FROM k WHERE floor(epoch(TIMESTAMP '2024-01-10 12:00:00')) - floor(epoch(ts)) < 60 * CASE WHEN starts_with(cache_key, 'economy') THEN 30 WHEN starts_with(cache_key, 'environment') THEN 15 ELSE 60 END""")
def q_fresh_results(spark, folder):
    keys = F.get(F.array(*map(F.lit, ["economy-lv", "property", "environment-ee", "other"])), (F.col("event_id") % 4).cast("int"))
    stamped = _t(spark, folder, "events").select("event_id", keys.alias("cache_key"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return snapshots.fresh(stamped, F.lit("2024-01-10 12:00:00").cast("timestamp")).select("event_id", "cache_key")


@query("""WITH p AS (SELECT split_part(p_name, ' ', 1) AS n, p_partkey % 4 AS k FROM part), both_sets AS (SELECT n, k = 1 AS is_regex FROM p WHERE k IN (1, 2) UNION ALL SELECT upper(n), k = 0 FROM p WHERE k IN (0, 3))
SELECT min(n) AS pattern, is_regex FROM both_sets GROUP BY lower(n), is_regex""")
def q_pattern_set(spark, folder):
    """A base file and a local one that holds the same names in capitals."""
    k, name = F.col("p_partkey") % 4, F.element_at(F.split("p_name", " "), 1)
    base = F.when(k == 0, F.concat(F.lit("  # "), name)).when(k == 1, F.concat(F.lit(" re:"), name, F.lit("  # why"))).when(k == 2, F.concat(name, F.lit(" "))).otherwise("  ")
    local = F.when(k == 0, F.concat(F.lit("re:"), F.upper(name))).when(k == 3, F.upper(name)).otherwise("")
    part = _t(spark, folder, "part")
    return scan.pattern_set(*[scan.parse_patterns(part.select(lines.alias("value"))) for lines in (base, local)])


@query("SELECT doc_id, doc_id % 4 = 0 AND strlen(text) < 8192 AS is_binary FROM documents")
def q_binary_sniff(spark, folder):
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.col("text").cast("binary"))
    return _t(spark, folder, "documents").select("doc_id", content.alias("content")).select("doc_id", scan.is_binary("content").alias("is_binary"))


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS pattern, 'c' || l_orderkey AS commit FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY commit) AS k FROM d)
SELECT pattern, count(*) AS commits, string_agg(commit, ',' ORDER BY commit) FILTER (k <= 8) AS first FROM r GROUP BY pattern""")
def q_commits_per_pattern(spark, folder):
    hits = _t(spark, folder, "lineitem").select(F.col("l_returnflag").alias("pattern"), F.concat(F.lit("c"), "l_orderkey").alias("commit"))
    return scan.commits_per_pattern(hits).select("pattern", "commits", F.array_join("first", ",").alias("first"))
