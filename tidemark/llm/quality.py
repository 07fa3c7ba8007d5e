"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores.

Each whole text becomes a row of statistics (lengths, character classes, repetition of words,
lines and phrases). Statistics, standardised, pass through ``FEATURES`` random cosines, which
approximate a Gaussian kernel. Every partition of the labelled rows sums its part of the normal
equations; the sums are added by groups and then on the driver, where they are a square of fixed
size. A fifth of the learning rows is left out of the ridge fit; on those, the isotonic step
turns ridge scores into probabilities from a histogram of ``BINS`` bins.

Learning looks at about ``SAMPLE`` labelled rows (a share of the ids' hashes; a documented bound),
none of the fold crc32(doc_id as text) mod 3 = 1, so only their statistics are taken twice.
Labels, language, source and id never enter the statistics. Scoring covers every whole text.

Cases: a null text counts as empty and is scored too; labels that are null are left out; a
document with several labels has their mean; with no usable label every score is 0.5 and with
one kind of label it is that label; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY_ROWS, SMALL_PIECE, crc_mod, cut, hash_share, heavy_rows, mix, pieces, texts_of, words_of

FEATURES = 256
SAMPLE = 50_000
SEED = 20
RIDGE = 1e-3
BINS = 2048
GROUPS = 8
FOLDS = 3
HELD_OUT = 1

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:", b"|<>{}[]()", b"#$%&*+=@^_~/\\", b"\"'`-", b"\n"]
_KINDS = np.zeros((256, len(_CLASSES) + 1))
for _k, _members in enumerate(_CLASSES):
    _KINDS[list(_members), _k] = 1
_KINDS[128:, -1] = 1
N_STATS = _KINDS.shape[1] + 14


def statistics(column: pa.Array) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    out = np.zeros((len(column), N_STATS), np.float32)
    for at, part in pieces(texts_of(column), SMALL_PIECE):
        w = words_of(part)
        length = (w.end - w.start).astype(float)
        last = w.data[w.end - 1] if len(w.end) else w.data[:0]
        lettered = ((last >= 97) & (last <= 122)) | (last >= 128)
        for k, text in enumerate(part):
            a, b = w.first[k], w.first[k + 1]
            n, size = b - a, len(text)
            if not n:
                continue
            seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            share = seen[seen > 0] / size
            h = w.hash[a:b]
            _, times = np.unique(h, return_counts=True)
            phrases = mix(h[:-2] + np.uint64(3) * h[1:-1] + np.uint64(7) * h[2:]) if n > 2 else h
            lines = [x for x in text.split(b"\n") if x]
            own = length[a:b]
            out[at + k] = [
                *(seen @ _KINDS / size),
                np.log1p(n),
                own.mean(),
                own.std(),
                np.log1p(own.max()),
                (own <= 3).mean(),
                len(times) / n,
                len(times) / np.sqrt(n),
                times.max() / n,
                len(np.unique(phrases)) / len(phrases),
                len(set(lines)) / max(1, len(lines)),
                np.log1p(size / max(1, len(lines))),
                -(share * np.log(share)).sum(),
                lettered[a:b].mean(),
                np.log1p(text.count(b". ")) - np.log1p(n),
            ]
    return out


def statistics_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and _stats of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * N_STATS), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_id", "_stats"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return picked.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _stats array<float>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(float)


class Kernel:
    """Standardised statistics to random cosines and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.slopes = random.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean))
        self.shifts = random.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.slopes + self.shifts)
        return np.hstack([waves, np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of phi' phi and phi' y over rows of _stats and _y."""
    n = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right, some = np.zeros((n, n)), np.zeros(n), False
        for batch in batches:
            if batch.num_rows:
                phi, some = kernel(_rows(batch.column(0))), True
                left += phi.T @ phi
                right += phi.T @ batch.column(1).to_numpy()
        if some:
            yield pa.RecordBatch.from_pydict({"_group": [TaskContext.get().partitionId() % GROUPS], "_sum": [np.concatenate([left.ravel(), right]).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("_sum").to_pylist():
                total = np.frombuffer(raw).copy() if total is None else total + np.frombuffer(raw)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"_sum": [total.tobytes()]})

    parts = rows.select("_stats", "_y").mapInArrow(part, "_group long, _sum binary")
    sums = parts.repartition(GROUPS, "_group").mapInArrow(add, "_sum binary").collect()
    total = sum((np.frombuffer(r[0]) for r in sums), np.zeros(n * n + n))
    return total[: n * n].reshape(n, n), total[n * n :]


def isotonic(level: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (level, value) with values that never fall."""
    blocks: list[list[float]] = []
    for x, y, w in zip(level, mean, weight, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, kernel=None, weights=None, knots=None, constant: float = 0.5):
        self.kernel, self.weights, self.knots, self.constant = kernel, weights, knots, constant

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.kernel(stats) @ self.weights

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        flat = np.interp(raw, *self.knots)
        # a slight slope keeps the order of scores that share a step
        return np.clip(0.99 * flat + 0.01 / (1 + np.exp(-np.clip(6 * (raw - 0.5), -30, 30))), 0, 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside of the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), folds) != held_out))
    known = cut(known.groupBy(F.col(id_col).alias("_doc")).agg(F.avg(F.col(label_col).cast("double")).alias("_y")))
    few = F.broadcast(cut(known.where(hash_share(F.col("_doc"), sample, known.count())).limit(2 * sample)))  # bounded
    asked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(few.select("_doc"), F.col("_id") == F.col("_doc"), "left_semi")
    stats = statistics_of(asked, "_id", "_text")
    rows = cut(stats.join(few, stats["_id"] == few["_doc"]).select("_stats", "_y", (F.xxhash64("_id") % 5 == 0).alias("_check")))
    each = [F.get("_stats", F.lit(k)).cast("double") for k in range(N_STATS)]
    found = rows.agg(F.count("*"), F.min("_y"), F.max("_y"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not found[0] or found[1] == found[2]:
        return Model(constant=float(found[1]) if found[0] else 0.5)
    moments = np.array(found[3:], float)
    kernel = Kernel(moments[:N_STATS], np.maximum(moments[N_STATS:], 1e-6))
    left, right = normal_equations(rows.where("NOT _check"), kernel)
    weights = np.linalg.solve(left + RIDGE * max(1.0, left[-1, -1]) * np.eye(len(left)), right)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bin(kernel(_rows(batch.column(0))) @ weights)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["_bin", "_y"])

    checked = rows.where("_check").select("_stats", "_y").mapInArrow(to_bins, "_bin long, _y double")
    bins = sorted(map(tuple, checked.groupBy("_bin").agg(F.avg("_y"), F.count("*")).collect()))
    if not bins:
        bins = [(BINS // 3, 0.0, 1), (2 * BINS // 3, 1.0, 1)]
    at, mean, weight = (np.array(c, float) for c in zip(*bins, strict=True))
    return Model(kernel, weights, isotonic((at + 0.5) * 3 / BINS - 1, mean, weight))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Per document: its id, held_out, score and predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(statistics(batch.column(1)).astype(float)))], names=["_id", "score"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    scored = picked.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(
        F.col("_id").alias(id_col), (crc_mod(F.col("_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_rejected(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """The rows of docs that are predicted to be of quality, as they are."""
    with heavy_rows(docs.sparkSession):
        model = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), HEAVY_ROWS):  # so that no second batch of texts goes back whole
                some = batch.slice(k, HEAVY_ROWS)
                yield some.filter(pa.array(model(statistics(some.column(place))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
