"""JSON-stat cubes to long rows, by strides over the flat value array.

``decode`` takes all dimensions but two at their first category. The grid of the two drives the
join, so cells that a sparse cube leaves out come as nulls. ``decode_all`` gives all dimensions of
the cells that are there: a cell's place, taken apart by the sizes (mixed radix), tells all its
coordinates within the row, so nothing is joined and nothing shuffled; a table of many cubes, or
of slices of one, is decoded where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUBE = "id array<string>, size array<int>, dimension map<string, struct<category: struct<index: map<string, int>, label: map<string, string>>>>"


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """One cube per file: cube (its path), the parsed header and the value as a variant."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("cube"), "value")
    return parse_cubes(text)


def parse_cubes(text: DataFrame) -> DataFrame:
    """cube, value (JSON text) to cube, id, size, dimension and cells (variant)."""
    header = F.from_json("value", CUBE)
    cells = F.try_variant_get(F.try_parse_json("value"), "$.value", "variant")
    return text.select("cube", header.alias("h"), cells.alias("cells")).select("cube", "h.*", "cells")


def _categories(cubes: DataFrame, dimension: str) -> DataFrame:
    """Categories of the named dimension with their place and its stride."""
    at = F.array_position("id", dimension).cast("int") - 1
    later = F.slice("size", at + 2, F.greatest(F.size("size") - at - 1, F.lit(0)))
    stride = F.aggregate(later, F.lit(1).cast("long"), lambda a, b: a * b)
    found = cubes.where(F.array_contains("id", dimension))
    category = F.try_element_at("dimension", F.lit(dimension))["category"]
    return found.select("cube", stride.alias("stride"), category["label"].alias("labels"), F.explode(category["index"]).alias("key", "place"))


def _cells(cubes: DataFrame) -> DataFrame:
    """cube, at (place in the flat array) and value of each cell, dense or sparse."""
    flat = cubes.select("cube", "cells").where("cells IS NOT NULL")
    each = flat.lateralJoin(flat.sparkSession.tvf.variant_explode(F.col("cells").outer()))
    return each.select("cube", F.coalesce(F.expr("try_cast(key AS bigint)"), F.col("pos")).alias("at"), F.try_variant_get("value", "$", "double").alias("value"))


def decode(cubes: DataFrame, geo: str = "geo", time: str = "time", geos: list[str] | None = None) -> DataFrame:
    """cube, geo, label, period, place (order of the period) and value. A cube without either
    dimension gives no rows; a geo without a label is its own."""
    g = _categories(cubes, geo).select("cube", F.col("key").alias("geo"), F.coalesce(F.try_element_at("labels", F.col("key")), F.col("key")).alias("label"), (F.col("place") * F.col("stride")).alias("_g"))
    t = _categories(cubes, time).select("cube", F.col("key").alias("period"), F.col("place"), (F.col("place") * F.col("stride")).alias("_t"))
    grid = (g.where(F.col("geo").isin(geos)) if geos else g).join(t, "cube")
    cells = _cells(cubes).withColumnRenamed("at", "_at")
    joined = grid.withColumn("_at", F.col("_g") + F.col("_t")).join(cells, ["cube", "_at"], "left")
    return joined.select("cube", "geo", "label", "period", "place", "value")


def decode_positional(cubes: DataFrame) -> DataFrame:
    """cube, period, place and value where time is the last dimension: value i belongs to the
    i-th period."""
    last = F.element_at("id", -1)
    category = F.try_element_at("dimension", last)["category"]["index"]
    times = cubes.where(F.size("id") > 0).select("cube", F.explode(category).alias("period", "place"))
    cells = _cells(cubes).select("cube", F.col("at").cast("int").alias("place"), "value")
    return times.join(cells, ["cube", "place"]).select("cube", "period", "place", "value")


def decode_all(cubes: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """cube, coordinates (dimension -> key), value of each cell with a value; with dimensions, a
    column for each of these instead of the map. A category without an index takes the order of
    its labels; a dimension that a cube lacks is null; places beyond the sizes aren't cells."""
    category = lambda d: F.try_element_at("dimension", d)["category"]

    def keys_of(d):
        by_place = F.transform(F.map_entries(category(d)["index"]), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("key")))
        return F.coalesce(F.transform(F.sort_array(by_place), lambda e: e["key"]), F.map_keys(category(d)["label"]))

    ones = F.array(F.lit(1).cast("long"))
    # from the last dimension on: the product of the sizes behind, and of all at the end
    strides = F.reverse(F.aggregate(F.reverse("size"), ones, lambda out, n: F.concat(out, F.array(F.element_at(out, -1) * n))))
    dense, sparse = (F.try_variant_get("cells", "$", kind) for kind in ("array<double>", "map<string,double>"))
    placed = F.coalesce(
        F.transform(dense, lambda v, k: F.struct(k.cast("long").alias("at"), v.alias("value"))),
        F.transform(F.map_entries(sparse), lambda e: F.struct(e["key"].try_cast("long").alias("at"), e["value"].alias("value"))),
    )
    known = cubes.where((F.size("id") == F.size("size")) & (F.size("id") > 0))
    ready = known.select("cube", "id", "size", F.transform("id", keys_of).alias("keys"), strides.alias("strides"), placed.alias("placed"))
    there = F.filter("placed", lambda c: c["value"].isNotNull() & (c["at"] < F.get("strides", F.lit(0))))
    places = F.sequence(F.lit(0), F.size("id") - 1)
    key_at = lambda at, k: F.get(F.get("keys", k), F.pmod(F.floor(at / F.get("strides", k + 1)), F.get("size", k)).cast("int"))
    named = F.transform(there, lambda c: F.struct(F.transform(places, lambda k: key_at(c["at"], k)).alias("at"), c["value"].alias("value")))
    each = ready.select("cube", "id", F.inline(named))
    if dimensions is None:
        return each.select("cube", F.map_from_arrays("id", "at").alias("coordinates"), "value")
    place = lambda d: F.array_position("id", d).cast("int")
    return each.select("cube", *[F.when(place(d) > 0, F.get("at", place(d) - 1)).alias(d) for d in dimensions], "value")
