"""Queries through the data sources: registries by pages, statistics by cells, cubes of many
dimensions. What a service would hold is written from the tables first, into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.catalogue import _cube, _t, query
from tidemark.sources import cells, jsonstat, publish, registry, registry_pages, snapshots
from tidemark.storage import new_folder


def _parts(spark, folder, schema: str, **options) -> DataFrame:
    """The parts through a registry's pages, five a task, or more for many parts."""
    mirror = new_folder(spark, "registry")
    registry_pages.write_pages(_t(spark, folder, "part"), mirror, F.col("p_partkey"), 100)
    return registry_pages.read(spark, schema, folder=mirror, page_size="100", pages="5", **options)


@query("SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part WHERE p_brand IN ('Brand#12', 'Brand#3') AND p_size = 7")
def q_registry_filtered(spark, folder):
    return _parts(spark, folder, "p_partkey long, p_brand string, p_size long").where("p_brand IN ('Brand#12', 'Brand#3') AND p_size = 7")


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY p_brand")
def q_registry_pages(spark, folder):
    return _parts(spark, folder, "p_brand string, p_size long").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("SELECT p_partkey::VARCHAR AS number, p_name FROM part WHERE p_partkey = 150 OR (contains(lower(p_name), 'red') AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = 150))")
def q_registry_search(spark, folder):
    # the key as a text, so that the search for it goes into the request
    rows = _parts(spark, folder, "p_partkey string, p_name string").withColumnRenamed("p_partkey", "number")
    return registry.search(rows, "number", ["p_name"], "150")


def _statistics(spark, folder) -> str:
    """A service's folder with the monthly series dense and sparse, time before geo."""
    mirror = new_folder(spark, "statistics")
    both = [_cube(spark, folder, turned=True).withColumn("dataset", F.lit("all")), _cube(spark, folder, sparse=True).withColumn("dataset", F.lit("no_june"))]
    both[0].unionByName(both[1]).select("dataset", "value").write.partitionBy("dataset").text(mirror)
    return mirror


@query("""WITH {m} SELECT dataset, geo, period AS time, value FROM series_m, (VALUES ('all'), ('no_june')) d(dataset)
WHERE period >= '1996-03' AND period < '1998-01' AND geo IN ('ASIA', 'EUROPE') AND (dataset = 'all' OR period NOT LIKE '%-06')""")
def q_statistics_cells(spark, folder):
    rows = cells.read(spark, folder=_statistics(spark, folder), datasets="all,no_june")
    return rows.where("time >= '1996-03' AND time < '1998-01' AND geo IN ('ASIA', 'EUROPE')")


@query("WITH {m} SELECT period AS time, value FROM series_m WHERE geo = 'AFRICA' AND period LIKE '%-06'")
def q_statistics_one_dataset(spark, folder):
    rows = cells.read(spark, "dataset string, freq string, geo string, time string, value double", folder=_statistics(spark, folder), datasets="all,no_june")
    return rows.where("dataset = 'all' AND geo = 'AFRICA' AND freq = 'M' AND time LIKE '%-06'").select("time", "value")


_AXES = {"status": ["F", "O", "P"], "geo": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "month": [f"{m:02d}" for m in range(1, 13)]}


def _yearly_cubes(spark, folder) -> DataFrame:
    """A cube for each priority and year, of status, geo, segment and month; every other one
    sparse. Order values by cell."""
    orders = _t(spark, folder, "orders")
    by_customer = orders.groupBy("o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MM").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))
    places = _t(spark, folder, "customer").join(F.broadcast(_t(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(_t(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = by_customer.join(places, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "year", "o_orderstatus", "r_name", "c_mktsegment", "month").agg(F.sum("price").cast("double").alias("value"))
    segments = [r[0] for r in _t(spark, folder, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a handful
    axes = {"status": _AXES["status"], "geo": _AXES["geo"], "segment": segments, "month": _AXES["month"]}
    columns, at = {"status": "o_orderstatus", "geo": "r_name", "segment": "c_mktsegment", "month": "month"}, F.lit(0).cast("long")
    for name, keys in axes.items():
        at = at * len(keys) + F.array_position(F.array(*map(F.lit, keys)), F.col(columns[name])) - 1
    filled = rows.groupBy("o_orderpriority", "year").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("at"), "value"))).alias("cells"))
    size = F.array(*[F.lit(len(keys)) for keys in axes.values()])
    count = 1
    for keys in axes.values():
        count *= len(keys)
    index = [F.struct(F.struct(F.create_map(*[F.lit(x) for k, key in enumerate(keys) for x in (key, k)]).alias("index")).alias("category")).alias(name) for name, keys in axes.items()]
    head = [F.array(*map(F.lit, axes)).alias("id"), size.alias("size"), F.struct(*index).alias("dimension")]
    dense = F.to_json(F.struct(*head, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.try_element_at("cells", k)).alias("value")), {"ignoreNullFields": "false"})
    sparse = F.to_json(F.struct(*head, F.col("cells").alias("value")))
    named = F.concat_ws("/", "o_orderpriority", F.col("year").cast("string"))
    return filled.select(named.alias("cube"), F.when(F.col("year") % 2 == 0, dense).otherwise(sparse).alias("value"))


@query("""SELECT o_orderpriority || '/' || year(o_orderdate) AS cube, o_orderstatus AS status, r_name AS geo, c_mktsegment AS segment, strftime(o_orderdate, '%m') AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def q_cubes_of_many_dimensions(spark, folder):
    return jsonstat.decode_all(jsonstat.parse_cubes(_yearly_cubes(spark, folder)), ["status", "geo", "segment", "month"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 130")
def q_registry_bounded(spark, folder):
    """The first rows of a service, as its own order has them."""
    return _parts(spark, folder, "p_partkey long, p_name string", limit="130")


@query("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS price FROM orders GROUP BY 1")
def q_published_result(spark, folder):
    """Published twice; the second run is what readers find."""
    path, orders = new_folder(spark, "published"), _t(spark, folder, "orders")
    publish.publish(orders.groupBy("o_orderstatus").count(), path, "economy-orders")
    totals = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))
    publish.publish(totals, path, "economy-orders")
    return publish.read(spark, path)


@query("SELECT 'property-' || n_regionkey AS cache_key, n_name FROM nation WHERE n_regionkey = 2")
def q_cached_result(spark, folder):
    """A result for each region, kept under its key and read while it's fresh."""
    path, nation = new_folder(spark, "results"), _t(spark, folder, "nation")
    for region in (1, 2):
        snapshots.write(nation.where(F.col("n_regionkey") == region).select("n_name"), path, f"property-{region}")
    return snapshots.read_fresh(spark, path, "property-2").select("cache_key", "n_name")
