import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import limiter
from tidemark.plans import streams
from tidemark.streaming import event_limiter as e
from tidemark.streaming import freshness


def hits(seed=1, n=400):
    chance = random.Random(seed)
    return [(chance.choice("aab") + chance.choice(["", "x"]), 1_700_000_000_000 + 500 * chance.randrange(n), k) for k in range(n)]


def run(spark, tmp_path, parts, **options):
    """The decisions of a stream that gets the parts one after another."""
    folder, out = tmp_path / "in", tmp_path / "out"
    schema = "key string, ts_ms long, id long"
    query = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = e.limit_event_stream(spark.readStream.schema(schema).parquet(str(folder)), **options)
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(out))


def test_order_across_triggers_is_that_of_time(spark, tmp_path):
    rows = hits()
    chance = random.Random(2)
    late = sorted(rows, key=lambda r: r[1] + chance.randrange(60_000))  # up to a minute out of order
    parts = [late[:150], late[150:280], late[280:], [("end", rows[0][1] + 10**9, None)]]
    got = run(spark, tmp_path, parts, delay="61 seconds", limit=5, window=20_000)
    want = limiter.limit_hits(spark.createDataFrame(rows, "key string, ts_ms long, id long"), limit=5, window=20_000)
    keep = lambda f: sorted((r.id, r.accepted, r.retry_after) for r in f.where("key <> 'end'").collect())
    assert keep(got) == keep(want) and {r[1] for r in keep(got)} == {True, False}


class Store:
    """State of one bucket, which counts how often it is asked."""

    def __init__(self):
        self.asked, self.lists, self.values, self.timers = 0, [], None, set()

    def count(self, result=None):
        self.asked += 1
        return result

    def getListState(self, name, schema):
        return SimpleNamespace(get=lambda: iter(self.count(list(self.lists))), appendList=lambda x: self.count(self.lists.extend(x)), put=lambda x: self.count(setattr(self, "lists", list(x))), clear=lambda: self.count(self.lists.clear()))

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.count(self.values), update=lambda x: self.count(setattr(self, "values", x)), clear=lambda: self.count(setattr(self, "values", None)))

    def listTimers(self):
        return iter(self.count(list(self.timers)))

    def deleteTimer(self, at):
        self.count(self.timers.discard(at))

    def registerTimer(self, at):
        self.count(self.timers.add(at))


def test_state_is_asked_a_few_times_a_trigger():
    store, own = Store(), e.EventLimiter(5, 20_000)
    own.init(store)
    rows = [(f"k{k % 97}", 1_700_000_000_000 + 37 * (k * 7919 % 10_000), k) for k in range(10_000)]
    got = []
    for k, part in enumerate([rows[:4000], rows[4000:]]):
        frame = pd.DataFrame(part, columns=["key", "ts_ms", "id"]).assign(no_id=False)
        own.handleInputRows((0,), iter([frame]), None)
        passed = rows[0][1] - 1 if not k else rows[0][1] + 10**6  # nothing is due at first
        if min(store.timers) < passed:
            got += list(own.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), None))
    assert store.asked < 20 and not store.lists and store.values is None
    want = []
    for key in {k for k, _, _ in rows}:
        one = limiter.Limiter(5, 20_000)
        want += [(i, *one.hit(t)) for t, i in sorted((t, i) for k, t, i in rows if k == key)]
    assert sorted(r for f in got for r in zip(f["id"], f["accepted"], f["retry_after"], strict=True)) == sorted(want)


def test_large_ids_beside_a_null_one(spark, tmp_path):
    start, big = 1_700_000_000_000, 2**53 + 1
    rows = [("a", start, big), ("a", start, None), ("a", start, big + 2), (None, start, big + 4), (None, start + 1, None)]
    got = run(spark, tmp_path, [rows, [("end", start + 10**9, 0)]], delay="10 seconds", limit=2, window=1000)
    assert sorted(((r.key or "", r.id or 0, r.accepted) for r in got.collect())) == [("", 0, True), ("", big + 4, True), ("a", 0, True), ("a", big, True), ("a", big + 2, False)]


def test_arriving_rows_are_staged_once(spark):
    day = 86_400_000
    rows = spark.range(0, 3000).select(F.col("id").cast("string").alias("key"), (F.col("id") * day).alias("ts_ms"), "id")  # over 400 weeks
    parts = streams._arriving(spark, rows, "ts_ms")
    assert 20 < len(parts) <= streams._SPANS + 2
    found = [sorted((r.ts_ms, r.id) for r in p.collect()) for p in parts]
    assert sorted(x for p in found for x in p) == [(k * day, k) for k in range(3000)]
    # a part's rows are no more than two days behind those of all parts before
    assert all(p[0][0] > max(before)[0] - 2 * day for before, p in zip(found, found[1:], strict=False))
    weeks = streams._arriving(spark, rows.where("id < 30"), "ts_ms")
    assert len(weeks) in (5, 6) and streams._arriving(spark, rows.where("id < 0"), "ts_ms") == []


def test_state_as_a_table(spark, tmp_path):
    start = 1_700_000_000_000
    parts = [[("a", start + 1000 * k, k) for k in range(5)] + [("b", start, 9)], [("c", start + 30_000, 20)]]
    got = run(spark, tmp_path, parts, delay="10 seconds", limit=3, window=19_000)
    assert sorted((r.id, r.accepted) for r in got.collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False), (9, True)]
    state = {r.key: list(r.times) for r in e.limiter_state(spark, str(tmp_path / "state")).collect()}
    assert state == {"a": [start, start + 1000, start + 2000]}  # b has been idle for a window and is gone
    assert [tuple(r) for r in e.held_hits(spark, str(tmp_path / "state")).collect()] == [("c", start + 30_000, 20)]
    assert tuple(e.stream_figures(spark, str(tmp_path / "state"), limit=3).first()) == (1, 1)


def test_one_result_a_time_to_live(spark, tmp_path):
    parts = [[("environment-ee", 0), ("environment-ee", 600), ("property", 60), ("property", 0), ("economy-x", 5), (None, 7)], [("property", 4000), ("environment-ee", 6000)], [("property", 9000), ("environment-ee", 6001)], [("property", 9500)]]
    folder, schema = str(tmp_path / "in"), "cache_key string, s long"
    for part in parts:
        frame = spark.createDataFrame(part, schema).select("cache_key", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("fetched_at"), "s")
        frame.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(frame.schema).parquet(folder)
        for query in freshness.write_fresh(source, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True):
            query.awaitTermination()
    by_key = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("s").collect():
        by_key.setdefault((r.cache_key, r.minutes), []).append(r.s)
    assert set(by_key) == {("environment-ee", 15), ("economy-x", 30), ("property", 60), (None, 60)}
    # two results that pass are never within the time to live; once the stream has moved on, a new one passes
    assert all(b - a > 60 * minutes for (_, minutes), s in by_key.items() for a, b in zip(s, s[1:], strict=False))
    assert len(by_key["property", 60]) == 2 and by_key["property", 60][1] == 9500 and len(by_key["environment-ee", 15]) == 2
