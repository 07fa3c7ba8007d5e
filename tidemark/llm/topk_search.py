"""Exact top-k search by tiled matrix products.

Vectors become whole numbers, floor(256 * x). Queries and shards of vectors are packed into
tiles of at most ``QUERY_TILE`` and ``SHARD_TILE`` rows; each pair of tiles is one matrix
product, from which a query keeps its k best by partial selection. The lists of a query are then
merged as a tree: first within groups of shards, then over the groups.

Shard tiles are dealt into groups, query tiles into others, and each pair of groups is one key of
an equi-join: with g shard groups and h query groups a query tile goes out g times and a shard
tile h times, and g * h keys spread over the tasks. h grows with the root of the partitions, for
queries are ``every`` times fewer than vectors. Spark broadcasts the query side only where its
size is under the session's limit.

Products are exact: they are taken in doubles while no sum can pass 2**53, and otherwise in
Python integers. A score beyond the range of a long is given as the nearest long (the contract's
type); components beyond 2**63 / 256 count as that limit, in size and sign.

Cases: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate; vectors of different lengths aren't compared; a query's own row is left
out, but another row with the same id isn't; ties go to the smaller id, then to the earlier
row; a query with fewer than k candidates returns all; an empty table returns nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

QUERY_TILE = 1024
SHARD_TILE = 8192
LONG = 2**63
TILE = "dim int, tile string, n int, top double, ids binary, rows binary, parts binary"


def _tiler(limit: int):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows, parts = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            made += 1
            top = float(np.abs(parts).max(initial=0))
            small = parts.astype(np.int16 if top < 1 << 15 else np.float64)
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "tile": [f"{task}-{made}"], "n": pa.array([len(ids)], pa.int32()), "top": [top], "ids": [ids.tobytes()], "rows": [rows.tobytes()], "parts": [small.tobytes()]}
            )

        for batch in batches:
            ids, rows, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = vectors.value_lengths().to_numpy()
            values = np.floor(256 * np.clip(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -LONG / 256, LONG / 256))
            at = np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                whole = values[at[mine][:, None] + np.arange(dim)]
                for k in range(0, len(mine), limit):
                    some = mine[k : k + limit]
                    held.setdefault(dim, []).append((ids[some], rows[some], whole[k : k + limit]))
                    if sum(len(x[0]) for x in held[dim]) >= limit:
                        yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return tile


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores in order, ties to smaller ids; all work on the few columns
    that reach the k-th score."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        columns = np.flatnonzero(scores >= kth)
    else:
        columns = np.arange(len(scores))
    return columns[np.lexsort((ids[columns], -scores[columns]))][:k]


def _parts(raw: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.float64 if dim and len(raw) == 8 * n * dim else np.int16
    return np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64)


def _products(k: int):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                dim = pair["dim"]
                q, v = _parts(pair["q_parts"], pair["q_n"], dim), _parts(pair["parts"], pair["n"], dim)
                q_ids, q_rows, ids, rows = (np.frombuffer(pair[c], np.int64) for c in ("q_ids", "q_rows", "ids", "rows"))
                if pair["q_top"] * pair["top"] * dim < 2**53:
                    scores = q @ v.T
                else:
                    scores = np.vectorize(int, otypes=[object])(q).dot(np.vectorize(int, otypes=[object])(v).T)
                out = []
                for a in range(len(q)):
                    # one more than k, for the query's own row may be among them
                    found = [c for c in _best(scores[a], ids, k + 1) if rows[c] != q_rows[a]][:k]
                    out += [(int(q_rows[a]), int(q_ids[a]), int(ids[c]), int(rows[c]), max(-LONG, min(LONG - 1, int(scores[a][c])))) for c in found]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([pair["tile"]] * len(out), pa.string())], names=["q_row", "query_id", "vec_id", "row", "score", "tile"])

    return multiply


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", query_tile: int = QUERY_TILE, shard_tile: int = SHARD_TILE, query_groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each row whose id is divisible by
    ``every``."""
    x = F.col(vector_col)
    # |component| <= the largest double: neither NaN nor infinite
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c) <= 1.7976931348623157e308, F.lit(False)))
    usable = cut(vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), x.alias("x")))
    shards = usable.mapInArrow(_tiler(shard_tile), TILE)
    tiles = cut(usable.where(F.col("id") % every == 0).mapInArrow(_tiler(query_tile), TILE))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = query_groups or max(1, math.isqrt(parts // every))
    g = max(8, -(-parts // h))

    def group(n: int) -> Column:
        return F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")

    def every_group(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = tiles.select("dim", every_group(g).alias("g"), group(h).alias("h"), *[F.col(c).alias(f"q_{c}") for c in ("tile", "n", "top", "ids", "rows", "parts")])
    pairs = shards.select("*", group(g).alias("g")).select("*", every_group(h).alias("h")).join(queries, ["dim", "g", "h"])
    found = pairs.mapInArrow(_products(k), "q_row long, query_id long, vec_id long, row long, score long, tile string")
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    group = F.pmod(F.xxhash64("tile"), F.lit(64))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_row", group).orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
