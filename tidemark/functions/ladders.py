"""Ladders: bands and thresholds as rows of end, whether the end belongs to the step, and label.

A value gets the label of the first step that it doesn't pass. A step without an end takes all that
is left, NaN too. Nulls, and values above the last end, get null. Of equal steps the one with the
smaller label counts; steps may come in any order.

`Ladder` is for a ladder known when the plan is built: the search is a balanced tree of conditions,
compiled with the rest of the stage. `looked_up` is for ladders that are data: many of them, or long
ones, as rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import new_folder

WHOLE = 1_000_000  # steps of all ladders, up to which they are broadcast whole
BLOCK = 1_024  # steps of a block of a longer ladder


class Ladder:
    """Steps (end or None, closed, label or None)."""

    def __init__(self, steps: Iterable[tuple[float | None, bool, str | None]]):
        self.steps = sorted(steps, key=lambda s: (s[0] is None, s[0] or 0, s[1], s[2] or ""))

    @classmethod
    def upto(cls, ends: Iterable[tuple[float, str]], above: str | None = None, closed: bool = True) -> Ladder:
        return cls([*((end, closed, label) for end, label in ends), (None, True, above)])

    def of(self, x: Column) -> Column:
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(self.steps[lo][2] if lo < len(self.steps) else None).cast("string")
            mid = (lo + hi) // 2
            end, closed, _ = self.steps[mid]
            if end is None:
                return search(lo, mid)
            return F.when(x <= end if closed else x < end, search(lo, mid)).otherwise(search(mid + 1, hi))

        return F.when(x.isNotNull(), search(0, len(self.steps)))


def first_label(ladders: Iterable[tuple[Column, Ladder]], other: str) -> Column:
    """Rules in order: the label of the first ladder that gives one."""
    return F.coalesce(*(ladder.of(x) for x, ladder in ladders), F.lit(other))


def _passed(x: Column, ends: Column, closed: Column, most: int) -> Column:
    """How many steps of the sorted arrays, of at most so many, x passes: their powers of two from
    the largest down, each taken where the step at its end is passed."""
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))))

    def taken(n: Column, power: Column) -> Column:
        k = n + power - 1
        end = F.get(ends, k)  # null behind the last step
        return F.when((end < x) | ((end == x) & ~F.get(closed, k)), n + power).otherwise(n)

    return F.aggregate(powers, F.lit(0), taken)


def _sorted_steps(steps: DataFrame) -> DataFrame:
    """Null ends become NaN, which Spark sorts last and takes as equal to itself."""
    unlimited = F.col("end").isNull()
    end = F.when(unlimited, F.lit(math.nan)).otherwise(F.col("end").cast("double"))
    return steps.where("ladder IS NOT NULL").select("ladder", end.alias("end"), (unlimited | F.coalesce("closed", F.lit(True))).alias("closed"), F.col("label").cast("string").alias("label")).distinct()


def _as_arrays(ranked: DataFrame, *keys: str) -> DataFrame:
    step = F.sort_array(F.collect_list(F.struct("end", "closed", "label")))
    rows = ranked.groupBy(*keys).agg(step.alias("_steps"))
    return rows.select(*keys, *(F.col(f"_steps.{c}").alias(f"_{c}s") for c in ("end", "closed", "label")))


def looked_up(values: DataFrame, steps: DataFrame, ladder: str, value: str, name: str = "label", whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """The values with the label that their ladder gives them, in a column called name.

    steps: ladder, end, closed (null: yes) and label. A value whose ladder is null or has no steps
    gets null. Up to `whole` steps in all, the ladders are broadcast, each as sorted arrays. More are
    sorted by range over all tasks and cut into blocks of consecutive steps; the blocks' last steps
    tell each value its block, and values meet their blocks by shuffle on both. So no ladder stands
    whole in a row, and values of one popular ladder go to as many tasks as it has blocks.
    """
    steps = _sorted_steps(steps)
    x = F.col("_x")
    rows = values.withColumn("_x", F.col(value).cast("double")).withColumn("_ladder", F.col(ladder))
    # one row tells the size of the whole and of the longest ladder
    total, longest = steps.groupBy("ladder").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if total <= whole:
        found = rows.join(F.broadcast(_as_arrays(steps.withColumnRenamed("ladder", "_ladder"), "_ladder")), "_ladder", "left")
        label = F.get("_labels", _passed(x, F.col("_ends"), F.col("_closeds"), longest))
        return found.select(*values.columns, F.when(x.isNotNull(), label).alias(name))

    # numbers within a range's task, whose upper bits are the task: blocks never span two of them
    numbered = steps.repartitionByRange("ladder", "end", "closed", "label").sortWithinPartitions("ladder", "end", "closed", "label").withColumn("_at", F.monotonically_increasing_id())
    folder = new_folder(values.sparkSession, "ladder-blocks")
    _as_arrays(numbered.withColumn("_block", F.expr(f"_at div {block}")).withColumnRenamed("ladder", "_ladder"), "_ladder", "_block").write.parquet(folder)
    blocks = values.sparkSession.read.parquet(folder)
    last = F.struct(F.element_at("_ends", -1).alias("end"), F.element_at("_closeds", -1).alias("closed"), F.col("_block").alias("label"))
    heads = blocks.groupBy("_ladder").agg(F.sort_array(F.collect_list(last)).alias("_heads"))
    heads = heads.select("_ladder", F.col("_heads.end").alias("_tops"), F.col("_heads.closed").alias("_tops_closed"), F.col("_heads.label").alias("_blocks"))
    count, most = heads.agg(F.coalesce(F.sum(F.size("_blocks")), F.lit(0)), F.coalesce(F.max(F.size("_blocks")), F.lit(0))).first()
    at = F.get("_blocks", _passed(x, F.col("_tops"), F.col("_tops_closed"), most))
    placed = rows.join(F.broadcast(heads) if count <= WHOLE else heads, "_ladder", "left").withColumn("_block", F.when(x.isNotNull(), at)).drop("_tops", "_tops_closed", "_blocks")
    label = F.get("_labels", _passed(x, F.col("_ends"), F.col("_closeds"), block))
    return placed.join(blocks, ["_ladder", "_block"], "left").select(*values.columns, F.when(x.isNotNull(), label).alias(name))
