import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan
from pyspark.sql.types import StructType

from tidemark.plans import services
from tidemark.sources import cells, jsonstat, registry_pages

ASKED = []
RECORDS = [{"_id": k, "name": f"n{k % 3}", "size": k, "extra": {"a": k}} for k in range(25)]


def answer(asked):
    """A registry that keeps filters, fields, offset and limit."""
    ASKED.append(asked)
    rows = [r for r in RECORDS if all(r[c] in v for c, v in json.loads(asked.get("filters", "{}")).items())]
    at, fields = int(asked["offset"]), asked["fields"].split(",")
    return json.dumps({"success": True, "result": {"total": len(rows), "records": [{f: r[f] for f in fields if f in r} for r in rows[at : at + int(asked["limit"])]]}})


def refused(asked):
    return json.dumps({"success": False, "error": "no"})


def reader(schema="name string, size long", fetch="answer", **options):
    return registry_pages.RegistryReader({"fetch": f"{__name__}:{fetch}", "resource": "r1", "page_size": "4", "pages": "2", **options}, StructType.fromDDL(schema))


def test_requests_of_a_registry(spark):
    ASKED.clear()
    own = reader()
    kept = list(own.pushFilters([EqualTo(("name",), "n1"), In(("size",), (1, 4, 7, 10, 13, 16, 19, 22)), GreaterThanOrEqual(("size",), 2)]))
    assert len(kept) == 3  # Spark checks all of them again
    parts = own.partitions()
    assert [p.value for p in parts] == [(0, 8)] and ASKED[-1]["limit"] == "0" and json.loads(ASKED[-1]["filters"])["name"] == ["n1"]
    assert [r for p in parts for r in own.read(p)] == [("n1", k) for k in range(1, 25, 3)]
    assert ASKED[-1]["fields"] == "name,size" and ASKED[-1]["offset"] == "4" and ASKED[-1]["sort"] == "_id" and ASKED[-1]["resource_id"] == "r1"
    assert [p.value for p in reader().partitions()] == [(0, 8), (8, 16), (16, 24), (24, 25)]
    assert [p.value for p in reader(limit="9").partitions()] == [(0, 8), (8, 9)]
    assert registry_pages.total({"fetch": f"{__name__}:answer"}, {"name": ["n2"]}) == 8


def test_types_and_answers_of_a_registry(spark):
    rows = list(reader("extra string, name long, missing double, size double").read(registry_pages.InputPartition((2, 4))))
    assert rows == [('{"a": 2}', None, None, 2.0), ('{"a": 3}', None, None, 3.0)]
    with pytest.raises(OSError):
        reader(fetch="refused").partitions()
    with pytest.raises(ValueError):
        reader("a array<int>")
    crossed = reader()
    list(crossed.pushFilters([EqualTo(("name",), "n1"), EqualTo(("name",), "n2")]))
    assert [list(crossed.read(p)) for p in crossed.partitions()] == [[]]


def test_registry_through_pages(spark, tmp_path):
    rows = spark.range(1, 251).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("päge "), "id")).alias("name"), (F.col("id") % 7).alias("page"), (F.col("id") / 4).alias("value"))
    folder = str(tmp_path / "pages")
    registry_pages.write_pages(rows, folder, F.col("id") - 1, 20)
    frame = registry_pages.read(spark, "id long, name string, page long, value double", folder=folder, page_size="15", pages="3")
    assert frame.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, frame.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    some = frame.where("page = 3 AND name IS NOT NULL")
    assert some.count() == rows.where("page = 3 AND name IS NOT NULL").count()
    assert "page" in some._jdf.queryExecution().executedPlan().toString()
    assert registry_pages.read(spark, "id long", folder=str(tmp_path / "none")).count() == 0


def test_a_mirror_of_many_pages(spark, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") * 1000).alias("far"))
    folder = tmp_path / "many"
    registry_pages.write_pages(rows, str(folder), F.col("far"), 2)  # with gaps between the places
    assert len([f for f in folder.rglob("*") if f.is_dir() or f.suffix in (".parquet", ".txt")]) < 60  # a page isn't a file of its own
    own = registry_pages.RegistryReader({"folder": str(folder), "page_size": "2", "pages": "1"}, StructType.fromDDL("id long"))
    parts = [p.value for p in own.partitions()]
    assert len(parts) <= registry_pages.TASKS and parts[0][0] == 0 and parts[-1][1] == 5000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert [r for p in own.partitions() for r in own.read(p)] == [(k,) for k in range(5000)]
    # requests across files, and from within one
    assert [r["id"] for r in own.answer(150, 333)["records"]] == list(range(150, 483)) and own.answer(4999, 9)["records"][0]["id"] == 4999 and own.answer(5000, 9)["records"] == []
    first = registry_pages.read(spark, "id long", folder=str(folder), page_size="2", limit="5")
    assert sorted(r.id for r in first.collect()) == [0, 1, 2, 3, 4]


def test_filtered_parts_of_a_large_table(spark, tmp_path):
    parts = spark.range(150_000).select((F.col("id") * 3).alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"), (F.col("id") % 50).cast("int").alias("p_size"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    found = services.q_registry_filtered(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= registry_pages.TASKS  # 1,500 pages, five a task at least
    want = parts.where("p_brand IN ('Brand#12', 'Brand#3') AND p_size = 37")
    assert found.count() == 0 and want.count() == 3000
    sized = services._parts(spark, str(tmp_path), "p_partkey long, p_brand string, p_size long").where("p_brand IN ('Brand#12', 'Brand#3') AND p_size = 37")
    assert sorted(map(tuple, sized.collect())) == sorted(map(tuple, want.collect()))


def test_a_mirror_of_rows_without_a_place(spark, tmp_path):
    rows = spark.createDataFrame([(None, "none"), (7, "b"), (3, "a")], "id long, name string")
    registry_pages.write_pages(rows, str(tmp_path / "odd"), F.col("id"), 2)
    assert [tuple(r) for r in registry_pages.read(spark, "id long, name string", folder=str(tmp_path / "odd")).collect()] == [(None, "none"), (3, "a"), (7, "b")]
    registry_pages.write_pages(rows.where("name = 'z'"), str(tmp_path / "empty"), F.col("id"), 2)
    assert registry_pages.read(spark, "id long", folder=str(tmp_path / "empty")).count() == 0


CUBE = {"id": ["time", "freq", "geo"], "size": [3, 1, 2], "dimension": {"time": {"category": {"index": {"2024-02": 1, "2024-01": 0, "2024-03": 2}}}, "freq": {"category": {"label": {"M": "monthly"}}}, "geo": {"category": {"index": ["LV", "EE"]}}}}
DENSE, SPARSE = CUBE | {"value": [1, 2, None, 4, 5, 6]}, CUBE | {"value": {"0": 1, "1": 2, "3": 4, "4": 5, "5": 6, "99": 9}}
CELLS = [("2024-01", "LV", 1.0), ("2024-01", "EE", 2.0), ("2024-02", "EE", 4.0), ("2024-03", "LV", 5.0), ("2024-03", "EE", 6.0)]
WANTED = []


def cube(dataset, chosen):
    WANTED.append((dataset, dict(chosen)))
    return json.dumps({"dense": DENSE, "sparse": SPARSE, "odd": [1]}.get(dataset)) if dataset != "broken" else "no"


def test_cells_of_a_cube():
    for form in (DENSE, SPARSE):
        assert [(at["time"], at["geo"], v) for at, v in cells.cells(form)] == CELLS and {at["freq"] for at, _ in cells.cells(form)} == {"M"}
    assert list(cells.cells({})) == []


def test_periods_and_members_in_the_request(spark):
    WANTED.clear()
    own = cells.CellsReader({"fetch": f"{__name__}:cube", "datasets": "dense, sparse,odd,broken", "where": '{"unit": ["a"]}'}, StructType.fromDDL("dataset string, geo string, time string, value double, other string"))
    asked = [In(("geo",), ("LV", "EE")), GreaterThanOrEqual(("time",), "2024-02"), LessThan(("time",), "2024-09"), GreaterThanOrEqual(("time",), "2023-01"), In(("dataset",), ("sparse", "broken", "odd"))]
    assert len(list(own.pushFilters(asked))) == 5
    parts = own.partitions()
    assert [p.value for p in parts] == [(d, "geo", g) for d in ("sparse", "odd", "broken") for g in ("LV", "EE")]
    rows = [r for p in parts for r in own.read(p)]
    assert sorted(rows) == sorted(("sparse", g, t, v, None) for t, g, v in CELLS)
    assert WANTED[0] == ("sparse", {"unit": ["a"], "geo": ["LV"], "sinceTimePeriod": ["2024-02"], "untilTimePeriod": ["2024-09"]})


def test_cells_through_spark(spark, tmp_path):
    (tmp_path / "dense.json").write_text(json.dumps(DENSE))
    rows = cells.read(spark, folder=str(tmp_path), datasets="dense")
    assert sorted(map(tuple, rows.select("time", "geo", "value").collect())) == sorted(CELLS)
    late = rows.where("time >= '2024-02' AND geo IN ('EE', 'LV')")
    assert late.rdd.getNumPartitions() == 2 and sorted(r.value for r in late.collect()) == [4.0, 5.0, 6.0]


def test_cubes_of_all_dimensions(spark):
    texts = [("dense", json.dumps(DENSE | {"dimension": CUBE["dimension"] | {"geo": {"category": {"index": {"LV": 0, "EE": 1}}}}})), ("odd", "no"), ("none", json.dumps(CUBE)), (None, None)]
    texts.append(("sparse", texts[0][1].replace("[1, 2, null, 4, 5, 6]", '{"0": 1, "1": 2, "3": 4, "4": 5, "5": 6, "99": 9}')))
    cubes = jsonstat.parse_cubes(spark.createDataFrame(texts, "cube string, value string"))
    got = jsonstat.decode_all(cubes)
    assert sorted((r.cube, r.coordinates["time"], r.coordinates["geo"], r.value) for r in got.collect()) == sorted((c, *x) for c in ("dense", "sparse") for x in CELLS)
    named = jsonstat.decode_all(cubes, ["geo", "freq", "missing"])
    assert named.columns == ["cube", "geo", "freq", "missing", "value"] and {(r.freq, r.missing) for r in named.collect()} == {("M", None)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
