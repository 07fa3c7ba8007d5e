"""Sliding-window limiter over a table of hits.

A hit is accepted if fewer than ``limit`` accepted hits of its key lie within the window before
it (a hit exactly one window old still counts). Rejected hits aren't recorded, so acceptance
depends on all decisions before and no window frame can give it. Keys are independent; a key's
hits pass through in order with a state of at most ``limit`` times, whatever their number.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

WINDOW_MS = 60_000
LIMIT = 60


def parse_limit(text: str | None, default: int = LIMIT) -> int:
    """A positive whole number, else the default."""
    try:
        n = int(text or "")
    except ValueError:
        return default
    return n if n > 0 else default


class Limiter:
    """The state of one key."""

    def __init__(self, limit: int, window: int = WINDOW_MS, kept: list[int] | None = None):
        self.limit, self.window, self.kept = limit, window, deque(kept or [])

    def hit(self, now: int) -> tuple[bool, int]:
        """(accepted, seconds to wait)"""
        while self.kept and self.kept[0] < now - self.window:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False, -(-(self.kept[0] + self.window - now) // 1000)
        self.kept.append(now)
        return True, 0


def limit_hits(hits: DataFrame, limit: int = LIMIT, window: int = WINDOW_MS, key: str = "key", ts_ms: str = "ts_ms", tie: str = "id") -> DataFrame:
    """hits with accepted and retry_after. Rows are dealt by key and sorted, then read as they
    come, so a key's hits are never gathered in memory. Each decision hangs on all before it, so
    one key is one task, however many hits it has."""
    schema = StructType([*hits.schema.fields, StructField("accepted", BooleanType()), StructField("retry_after", IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, state = object(), Limiter(limit, window)
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[ts_ms], strict=True):
                if k != now_key:
                    now_key, state = k, Limiter(limit, window)
                out.append(state.hit(int(t)))
            yield frame.assign(accepted=[a for a, _ in out], retry_after=pd.Series([w for _, w in out], index=frame.index, dtype="int32"))

    dealt = hits.repartition(key).sortWithinPartitions(key, ts_ms, tie)
    return dealt.mapInPandas(run, schema)


#: Lengths of the window that one task counts for a key.
STRETCH = 32


def window_counts(hits: DataFrame, seconds: int = 60, key: str = "key", ts: str = "ts") -> DataFrame:
    """Hits of the key within the seconds up to each hit, by a range frame. Time is cut into
    stretches, and hits within a window of the next stretch count there too, so that a key with a
    large share of the hits is spread over tasks."""
    at, width = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    row = hits.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), at.alias("_at")).withColumn("_own", F.floor(F.col("_at") / (STRETCH * width)))
    late = F.col("_at") >= (F.col("_own") + 1) * (STRETCH * width) - width
    copied = row.withColumn("_in", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    frame = Window.partitionBy("_key", "_in").orderBy("_at").rangeBetween(-width, Window.currentRow)
    counted = copied.withColumn("hits", F.count("*").over(frame)).where(F.col("_in").eqNullSafe(F.col("_own")))
    return counted.select(*[F.col("_row").getField(c).alias(c) for c in hits.columns], "hits")


def tracked_keys(hits: DataFrame, key: str = "key") -> DataFrame:
    return hits.agg(F.count_distinct(key).alias("tracked"))
