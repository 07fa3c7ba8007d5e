import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from tidemark import catalog
from tidemark.sources import feeds, jsonstat, probes, registry, rest, snapshots


def cube(ids, size, cats, value, labels=None):
    dims = {d: {"category": {"index": c, **({"label": labels[d]} if labels and d in labels else {})}} for d, c in cats.items()}
    return json.dumps({"id": ids, "size": size, "dimension": dims, "value": value})


CATS = {"freq": {"Q": 0}, "geo": {"EE": 0, "LT": 1, "LV": 2}, "time": {"2024-Q2": 1, "2024-Q1": 0}}
WANT = [("EE", "2024-Q1", 1.0), ("EE", "2024-Q2", 2.0), ("LT", "2024-Q1", 3.0), ("LT", "2024-Q2", None), ("LV", "2024-Q1", 5.0), ("LV", "2024-Q2", 6.0)]


def decoded(spark, text, **options):
    cubes = jsonstat.parse_cubes(spark.createDataFrame([("c", text)], "cube string, value string"))
    return sorted(map(tuple, jsonstat.decode(cubes, **options).select("geo", "period", "value").collect()), key=str)


def test_dense_and_sparse_cubes(spark):
    dense = cube(["freq", "geo", "time"], [1, 3, 2], CATS, [1, 2, 3, None, 5, 6])
    sparse = cube(["freq", "geo", "time"], [1, 3, 2], CATS, {"0": 1, "1": 2, "2": 3, "4": 5, "5": 6})
    assert decoded(spark, dense) == WANT == decoded(spark, sparse)
    assert {g for g, _, _ in decoded(spark, dense, geos=["LV", "EE"])} == {"LV", "EE"}


def test_time_before_geo_and_other_dimensions_at_zero(spark):
    turned = cube(["time", "geo", "freq"], [2, 3, 1], CATS, [1, 3, 5, 2, None, 6])
    assert decoded(spark, turned) == WANT
    cats = {"unit": {"a": 0, "b": 1}, **CATS}
    two = cube(["unit", "geo", "time"], [2, 3, 2], cats, [1, 2, 3, None, 5, 6, *[99] * 6])
    assert decoded(spark, two) == WANT


def test_cubes_without_time_or_label(spark):
    assert decoded(spark, cube(["geo"], [3], {"geo": CATS["geo"]}, [1, 2, 3])) == []
    assert decoded(spark, "not json") == []
    cubes = jsonstat.parse_cubes(spark.createDataFrame([("c", cube(["geo", "time"], [3, 2], CATS, [1, 2, 3, 4, 5, 6], {"geo": {"LV": "Latvia"}}))], "cube string, value string"))
    assert {(r.geo, r.label) for r in jsonstat.decode(cubes).collect()} == {("LV", "Latvia"), ("EE", "EE"), ("LT", "LT")}
    positional = jsonstat.decode_positional(cubes).orderBy("place")
    assert [(r.period, r.value) for r in positional.collect()] == [("2024-Q1", 1.0), ("2024-Q2", 2.0)]


def payloads(spark, *rows, schema="value string"):
    return spark.createDataFrame(list(rows), schema)


def test_prices_and_rates(spark):
    body = json.dumps({"data": {"lv": [{"timestamp": 1704844800, "price": -1.5}, {"timestamp": 1704931200, "price": 120.0}], "ee": []}})
    rows = feeds.prices(payloads(spark, (body,), ("broken",)))
    assert [(r.zone, r.price) for r in rows.orderBy("pos").collect()] == [("lv", -1.5), ("lv", 120.0)]
    assert feeds.prices_of_day(rows, "2024-01-10").count() == 1
    xml = "<Cube currency='USD' rate='1.0812'/><Cube currency='XXX' rate='2'/>"
    assert [tuple(r) for r in feeds.exchange_rates(payloads(spark, (xml,), ("",)), catalog.currencies(spark)).collect()] == [("USD", 1.0812, "US Dollar")]


def test_weather_air_marine_population(spark):
    got = feeds.weather(payloads(spark, ("Riga", '{"current": {"temperature_2m": 3.5, "weather_code": 61}}'), ("X", "{}"), schema="city string, value string")).collect()
    assert [tuple(r) for r in got] == [("Riga", 3.5, 0.0, 0.0, 61, "Rain"), ("X", 0.0, 0.0, 0.0, 0, "Clear sky")]
    assert tuple(feeds.air(payloads(spark, ("no",))).first()) == (0.0, 0.0, 0.0, "good")
    sea = payloads(spark, ("LVRIX", '{"current": {"wave_height": 1.2}, "hourly": {"time": ["a", "b"], "wave_height": [1, 2], "sea_surface_temperature": [3]}}'), schema="port_code string, value string")
    assert feeds.marine(sea).first().wave_height == 1.2
    assert [tuple(r) for r in feeds.marine_forecast(sea).collect()] == [("LVRIX", "a", 1.0, 3.0), ("LVRIX", "b", 2.0, None)]
    assert feeds.port_weather(sea).first().cloud_cover == 0.0
    for body, want in (('{"value": [{"PersonCount": 4}, {"Count": 3}, {}]}', 7), ('{"d": {"results": [{"Count": 2}]}}', 2), ("{}", 605802), ('{"value": []}', 605802)):
        assert feeds.population(payloads(spark, (body,)), 605802).first()[0] == want


def test_registry(spark):
    catalogue = spark.createDataFrame([("a", True, 0), ("b", True, 1), ("c", False, 2)], "id string, datastore_active boolean, pos int")
    assert registry.latest_active(catalogue).first()[0] == "b"
    rows = spark.createDataFrame([(1, "Rīgas iela"), (2, None), (3, "OSTA")], "k int, name string")
    assert [r.k for r in registry.containing(rows, ["name"], "osta").collect()] == [3]
    assert [r.k for r in registry.exact(rows, "k", 2).collect()] == [2]
    assert registry.bounded(rows, 2).count() == 2 and registry.bounded(rows).count() == 3
    both = registry.snapshots([(rows, "2024-01-01"), (rows.drop("name"), "2024-02-01")])
    assert both.where("snapshot_date = '2024-02-01' AND name IS NULL").count() == 3
    assert [r.n for r in registry.with_defaults(rows, {"n": ("name", "-")}).collect()] == ["Rīgas iela", "-", "OSTA"]


def test_rest_source_pushes_the_dataset(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps({"of": name}))
    rest.register(spark)
    rows = spark.read.format("statistics").options(datasets="a,b", folder=str(tmp_path)).load()
    assert sorted(r.value for r in rows.collect()) == ['{"of": "a"}', '{"of": "b"}']
    reader = rest.StatisticsReader({"datasets": "a,b,c"})
    assert len(list(reader.pushFilters([EqualTo(("dataset",), "b")]))) == 1  # Spark checks it again
    assert [p.value for p in reader.partitions()] == ["b"]
    assert rest.selection([("SEX", ["T"])])["query"][0]["selection"] == {"filter": "item", "values": ["T"]}


def answer(dataset, chosen):
    return json.dumps({"of": dataset, "chosen": chosen})


def test_rest_source_pushes_members(spark):
    rest.register(spark)
    rows = spark.read.format("statistics").options(datasets="a,b", fetch="tests.test_sources:answer", where='{"ContentsCode": ["X1"]}').load()
    got = rows.where("dataset = 'a' AND dimension = 'geo' AND member IN ('LV', 'EE')").collect()
    assert sorted(r.member for r in got) == ["EE", "LV"]
    assert {r.value for r in got} == {json.dumps({"of": "a", "chosen": [["ContentsCode", ["X1"]], ["geo", ["LV", "EE"]]]})}


def test_rest_source_asks_by_post_and_get(monkeypatch):
    sent = []
    monkeypatch.setattr(rest, "http_post", lambda url, body, *a: sent.append((url, body)) or "{}")
    monkeypatch.setattr(rest, "http_get", lambda url, *a: sent.append((url, None)) or "{}")
    for method in ("post", "get"):
        reader = rest.StatisticsReader({"datasets": "t", "url": "http://x/", "method": method, "where": '{"SEX": ["T", "F"]}', "since": "2015"})
        assert [list(reader.read(p)) for p in reader.partitions()] == [[("t", "", "", "{}")]]
    assert sent[0] == ("http://x/t", rest.selection([("SEX", ["T", "F"])]))
    assert sent[1][0] == "http://x/t?format=JSON&SEX=T&SEX=F&sinceTimePeriod=2015"


def fetched(kind, url):
    if url == "down":
        raise OSError("no route")
    return {"x": "<Envelope><Cube/></Envelope>", "j": '{"a": 1}', "bad": "<html>"}[url]


def test_probes(spark):
    named = [("rates", "xml", True), ("table", "pxweb", True), ("weather", "json", False), ("broken", "json", True), ("gone", "json", True)]
    asked = probes.probes(spark, {"rates": "x", "table": "j", "weather": "j", "broken": "bad", "gone": "down", "other": "x"}, named)
    got = {r.name: (r.status, r.required, r.error) for r in probes.judged(probes.answers(asked, "tests.test_sources:fetched")).collect()}
    assert got == {"rates": ("healthy", True, None), "table": ("healthy", True, None), "weather": ("healthy", False, None), "broken": ("unhealthy", True, "not JSON"), "gone": ("unhealthy", True, "no route")}
    assert probes.answers(asked, "tests.test_sources:fetched").where("latency_ms >= 0").count() == 5


def test_json_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    snapshots.write_json(spark.range(2), path, "economy-lv")
    sent = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted(s["rows"]["id"] for s in sent) == [0, 1] and {s["cacheControl"] for s in sent} == {"public, max-age=1800"} and all(s["fetchedAt"].endswith("Z") for s in sent)


def test_catalogue(spark):
    assert (catalog.national(spark).count(), catalog.compared(spark).count(), catalog.cargo(spark).count()) == (24, 31, 47)
    assert catalog.lookup(spark, "gdp").selections["INDICATOR"] == "B1GQ"
    assert [r["count"] for r in catalog.compared(spark).groupBy("freq").count().orderBy("freq").collect()] == [8, 13, 9, 1]
    with pytest.raises(catalog.UnknownIndicatorError):
        catalog.lookup(spark, "nothing")
    with pytest.raises(catalog.QueryTooShortError):
        catalog.checked_query("ab")


def test_snapshot_goes_stale(spark, tmp_path):
    path = str(tmp_path / "cache")
    snapshots.write(spark.range(3), path, "environment-lv")
    assert snapshots.read_fresh(spark, path, "environment-lv").count() == 3
    later = lambda minutes: F.current_timestamp() + F.make_dt_interval(mins=F.lit(minutes))
    assert snapshots.read_fresh(spark, path, "environment-lv", later(14)).count() == 3
    assert snapshots.read_fresh(spark, path, "environment-lv", later(16)).count() == 0
