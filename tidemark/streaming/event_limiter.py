"""The sliding-window limiter over a stream, in event time.

Hits may come in any order within the watermark's delay: a key's hits wait in the state until the
watermark has passed them, and are then decided in order of time. So the decisions are those of
the batch operator over the same hits, however they are spread over triggers; hits later than the
delay are dropped by Spark and decide nothing.

Keys are dealt into ``BUCKETS`` by their hash, and a bucket's state is read and written as a whole,
so that a trigger asks the state store a few times a bucket and not several times a hit. State of
a bucket, as Arrow tables: ``held``, the hits that still wait, and ``kept``, the accepted times of
the last window of each key (at most ``limit``). A timer fires as the watermark reaches the first
held hit; a key goes a window after its last accepted hit, if nothing of it is held, so a key that
is idle leaves nothing behind. A bucket's waiting hits must fit into a task's memory, as a key's
must; a stream keeps its number of buckets. The state can be read as a table while the stream runs,
or after it, from its checkpoint.

Cases: a null key is a key; hits of one time go by id, null ids first; a null time never comes out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.limiter import LIMIT, WINDOW_MS, Limiter

OUTPUT = "key string, ts_ms bigint, id bigint, accepted boolean, retry_after int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024
#: Hits in one element of a bucket's list.
PIECE = 100_000

_HELD = pa.schema([("key", pa.string()), ("ts_ms", pa.int64()), ("id", pa.int64())])
_KEPT = pa.schema([("key", pa.string()), ("times", pa.list_(pa.int64()))])


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(texts: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(x)).read_all() for x in texts)])


class EventLimiter(StatefulProcessor):
    """The keys of a bucket."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "hits binary")
        self.kept = handle.getValueState("kept", "times binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packed, first = [], []
        for frame in rows:
            ids = pa.array(frame["id"].to_numpy(), pa.int64(), mask=frame["no_id"].to_numpy(dtype=bool))
            packed.append((_packed(pa.table([pa.array(frame["key"], pa.string(), from_pandas=True), pa.array(frame["ts_ms"], pa.int64()), ids], schema=_HELD)),))
            first.append(int(frame["ts_ms"].min()))
        self.held.appendList(packed)
        # one timer a bucket: an earlier one finds the next time itself
        timers, at = list(self.handle.listTimers()), max(min(first), 1)
        if not timers or min(timers) > at:
            self._wake(timers, at)
        return iter(())

    def _wake(self, timers: list[int], at_ms: int) -> None:
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at_ms, 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, timers = timerValues.getCurrentWatermarkInMs(), list(self.handle.listTimers())
        held = _unpacked((x for (x,) in self.held.get()), _HELD)
        is_due = pc.less_equal(held["ts_ms"], passed)
        due, later = held.filter(is_due), held.filter(pc.invert(is_due))
        due = due.take(pc.sort_indices(due, sort_keys=[(c, "ascending") for c in ("key", "ts_ms", "id")], null_placement="at_start"))
        before = self.kept.get()
        kept = _unpacked([before[0]] if before else [], _KEPT)
        times = dict(zip(kept["key"].to_pylist(), kept["times"].to_pylist(), strict=True))
        decided, now, own = [], object(), None
        for k, t in zip(due["key"].to_pylist(), due["ts_ms"].to_pylist(), strict=True):
            if k != now:
                now, own = k, Limiter(self.limit, self.window, times.get(k))
                times[k] = own.kept
            decided.append(own.hit(t))
        self._keep(times, later, passed, timers)
        if decided:
            yield pd.DataFrame({
                "key": due["key"].to_pandas(),
                "ts_ms": due["ts_ms"].to_numpy(),
                "id": pd.arrays.IntegerArray(due["id"].fill_null(0).to_numpy().copy(), due["id"].is_null().to_numpy().copy()),
                "accepted": np.array([a for a, _ in decided]),
                "retry_after": np.array([w for _, w in decided], dtype="int32"),
            })

    def _keep(self, times: dict, later: pa.Table, passed: int, timers: list[int]) -> None:
        """What the bucket still needs goes back into its state, and it wakes as the first of it is due."""
        waiting = set(pc.unique(later["key"]).to_pylist())
        stay = {k: list(x) for k, x in times.items() if x and (k in waiting or x[-1] + self.window > passed)}
        if later:
            self.held.put([(_packed(later.slice(at, PIECE)),) for at in range(0, len(later), PIECE)])
        else:
            self.held.clear()
        if stay:
            self.kept.update((_packed(pa.table([pa.array(list(stay), pa.string()), pa.array(list(stay.values()), pa.list_(pa.int64()))], schema=_KEPT)),))
        else:
            self.kept.clear()
        wake = ([pc.min(later["ts_ms"]).as_py()] if later else []) + [x[-1] + self.window + 1 for k, x in stay.items() if k not in waiting]
        if wake:
            self._wake(timers, min(wake))

    def close(self) -> None:
        pass


def limit_event_stream(hits: DataFrame, delay: str = "10 minutes", limit: int = LIMIT, window: int = WINDOW_MS) -> DataFrame:
    """A stream of key, ts_ms and id to the same with accepted and retry_after, in order of time
    within each key, once the watermark (``delay`` behind the newest hit) has passed."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    # pandas would make fractions of ids among which one is null
    ids = [F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("no_id")]
    timed = hits.where("ts_ms IS NOT NULL").select(bucket, "key", "ts_ms", *ids, F.timestamp_millis("ts_ms").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("bucket").transformWithStateInPandas(EventLimiter(limit, window), OUTPUT, "append", "EventTime")


def _state(spark: SparkSession, checkpoint: str, variable: str, packed: str, schema: pa.Schema, columns: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield from _unpacked([text], schema).to_batches()

    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select(packed).mapInArrow(rows, columns)


def limiter_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key and times (accepted ones of the last window) of each key in a stream's state."""
    return _state(spark, checkpoint, "kept", "value.times", _KEPT, "key string, times array<bigint>")


def held_hits(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, ts_ms and id of the hits that wait for the watermark."""
    return _state(spark, checkpoint, "held", "list_element.hits", _HELD, "key string, ts_ms bigint, id bigint")


def stream_figures(spark: SparkSession, checkpoint: str, limit: int = LIMIT) -> DataFrame:
    """tracked keys, and how many of them have no hit left, as the running stream knows them."""
    return limiter_state(spark, checkpoint).agg(F.count("*").alias("tracked"), F.count_if(F.size("times") >= limit).alias("exhausted"))
