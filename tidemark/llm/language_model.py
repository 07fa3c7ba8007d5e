"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are the lower-cased words of a text and one end. The model predicts a token's class from
the ``CONTEXT`` tokens before it. As context each of the ``INPUTS`` most frequent words has a
vector of its own; all other words share ``BUCKETS`` vectors by their last letters. As target each
of the ``TOP`` most frequent words and the end are classes of their own, all other words fall into
``BUCKETS`` classes. Within such a class a word has its smoothed share of the counted tokens, and
one share stands for any unseen word. So P(word | context) = P(class | context) * P(word | class)
sums to one over all words.

1. Counting: every training token is counted, by partition and then by a shuffle on the word's
   64-bit hash.
2. Training: one task makes a start from about ``START_DOCS`` documents; then every partition
   trains from there on every token of its documents, and the partitions' parameters are averaged
   by tokens, summed in pieces by tasks. A batch draws ``NOISE`` classes, against which all its
   tokens are told apart. The driver gets one model, whose size doesn't depend on the rows.
3. Scoring: tasks multiply batches of context vectors with all class vectors and normalise. The
   counts of the ``FREQUENT`` most frequent words are broadcast (a fixed bound); all other words
   are joined with the counts by hash.

Documents with crc32(doc_id as text) mod 5 = 1 are held out of all three counts, sample and
training; everything is scored.

Cases: words that tie for a place among the most frequent ones are taken by a hash of theirs, and
in order of their hashes; a null text counts as empty and has only its end; a null id counts as the empty text in
the fold; rows that repeat are counted and scored each; with nothing to learn from the base score
is 0 and classes are equally likely; an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, crc_mod, cut, hash_share, most_frequent, pieces, signed, texts_of, words_of

INPUTS = 8192
TOP = 191
BUCKETS = 96
CONTEXT = 4
DIM = 16
NOISE = 48
#: How many noise tokens come on a real one; those drawn are weighted to it.
RATIO = 8
START_DOCS = 600
FREQUENT = 1 << 17
FOLDS = 5
HELD_OUT = 1
SEED = 3
BATCH = 8192
SCORED = 1024
#: Parameters that travel together.
CHUNK = 8192


def bucket_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A class for each word by its last three bytes (fewer, if it has fewer)."""
    mixed = np.zeros(len(end), np.int64)
    for k in (1, 2, 3):
        at = end - k
        mixed = mixed * 257 + np.where(at >= start, data[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    return (mixed * 2654435761 >> 12) % BUCKETS


@dataclass
class Classes:
    """The most frequent words, by rank, and where they go. hashes: sorted; rank: of each."""

    hashes: np.ndarray
    rank: np.ndarray

    @classmethod
    def by_rank(cls, hashes: np.ndarray) -> Classes:
        order = np.argsort(hashes)
        return cls(hashes[order], order)

    def __post_init__(self) -> None:
        known = len(self.hashes)
        #: Number of the end: as an input, and as a class.
        self.input_end, self.end = known, min(known, TOP)
        self.inputs, self.n = known + 1 + BUCKETS, min(known, TOP) + 1 + BUCKETS

    def of(self, hashed: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input and the class of each word."""
        inputs, classes = self.input_end + 1 + buckets, self.end + 1 + buckets
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            rank, known = self.rank[at], self.hashes[at] == hashed
            inputs = np.where(known, rank, inputs)
            classes = np.where(known & (rank < self.end), rank, classes)
        return inputs.astype(np.int32), classes.astype(np.int32)


def contexts(classes: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT classes before each token (nearest first); before a text stands its end."""
    out = np.full((len(classes), CONTEXT), end, np.int32)
    for k in range(1, CONTEXT + 1):
        out[k:, k - 1] = classes[:-k]
    for k in range(1, CONTEXT + 1):
        for shift in range(k):  # tokens of the text before don't count
            at = first[:-1] + shift
            out[at[at < first[1:]], k - 1] = end
    return out


def with_ends(classes: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes with an end after each text, and where texts begin among them."""
    return np.insert(classes, first[1:], end).astype(np.int32), first + np.arange(len(first))


class LogBilinear:
    """Context vector: sum over places of scale[place] * left[input]; score: its product with
    right[class], plus bias[class]."""

    def __init__(self, left, right, scale, bias, noise):
        self.left, self.right, self.scale, self.bias, self.noise = left, right, scale, bias, noise

    @classmethod
    def fresh(cls, counts: np.ndarray, inputs: int | None = None) -> LogBilinear:
        random = np.random.default_rng(SEED)
        noise = (counts + 0.5) / (counts + 0.5).sum()
        left, right = (random.normal(0, 0.1, (n, DIM)) for n in (inputs or len(counts), len(counts)))
        scale = np.ones((CONTEXT, DIM)) / np.arange(1, CONTEXT + 1)[:, None] ** 0.5
        return cls(*(x.astype(np.float32) for x in (left, right, scale, np.log(noise))), noise)

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.left, self.right, self.scale, self.bias)])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in (self.left, self.right, self.scale, self.bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out, self.noise)

    def train(self, before: np.ndarray, target: np.ndarray, random: np.random.Generator, rate: float = 0.08, past=None):
        """One pass in batches, with step sizes by AdaGrad. Returns the squared gradients so far."""
        past = past or [np.full(x.shape, 1e-2, np.float32) for x in (self.left, self.right, self.scale, self.bias)]
        edges, shift = np.cumsum(self.noise), np.log(RATIO * self.noise).astype(np.float32)
        for a in range(0, len(target), BATCH):
            c, y = before[a : a + BATCH], target[a : a + BATCH]
            n = len(y)
            inputs = self.left[c]
            vector = np.einsum("nkd,kd->nd", inputs, self.scale)
            drawn = np.minimum(np.searchsorted(edges, random.random(NOISE)), len(edges) - 1)
            real, false = self.right[y], self.right[drawn]
            push = sigmoid(shift[y] - np.einsum("nd,nd->n", vector, real) - self.bias[y])
            pull = sigmoid(vector @ false.T + (self.bias[drawn] - shift[drawn])) * np.float32(-RATIO / NOISE)
            toward = push[:, None] * real + pull @ false
            right, bias = summed(y, push[:, None] * vector, len(self.right)), np.bincount(y, push, len(self.bias)).astype(np.float32)
            np.add.at(right, drawn, pull.T @ vector)
            np.add.at(bias, drawn, pull.sum(0))
            left = summed(c.ravel(), (toward[:, None] * self.scale).reshape(-1, DIM), len(self.left))
            scale = np.einsum("nd,nkd->kd", toward, inputs)
            for x, g, s in zip((self.left, self.right, self.scale, self.bias), (left, right, scale, bias), past, strict=True):
                g /= np.float32(n**0.5)
                s += g * g
                x += np.float32(rate) * g / np.sqrt(s)
        return past

    def log10(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the targets."""
        right, out = np.ascontiguousarray(self.right.T), np.empty(len(target))
        for a in range(0, len(target), SCORED):
            c, y = before[a : a + SCORED], target[a : a + SCORED]
            score = np.einsum("nkd,kd->nd", self.left[c], self.scale) @ right
            score += self.bias
            score -= score.max(1, keepdims=True)
            own = score[np.arange(len(y)), y].astype(float)
            np.exp(score, out=score)
            out[a : a + SCORED] = own - np.log(score.sum(1, dtype=np.float32))
        return out / np.log(10)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n rows with the sums of the values that belong to each."""
    width = values.shape[1]
    places = (rows[:, None] * width + np.arange(width, dtype=rows.dtype)).ravel()
    return np.bincount(places, values.ravel(), n * width).astype(np.float32).reshape(n, width)


def count_words(rows: DataFrame) -> DataFrame:
    """_hash, _bucket and _n of every word in the _text of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, buckets, size = [], [], 0

        def flush() -> pa.RecordBatch:
            h, b = np.concatenate(hashes), np.concatenate(buckets)
            unique, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(unique)), pa.array(b[at]), pa.array(n)], names=["_hash", "_bucket", "_n"])

        for batch in batches:
            for _, part in pieces(texts_of(batch.column(0))):
                w = words_of(part)
                hashes.append(w.hash)
                buckets.append(bucket_of(w.data, w.start, w.end))
                size += len(w.hash)
                if size > 2_000_000:
                    yield flush()
                    hashes, buckets, size = [], [], 0
        if size:
            yield flush()

    parts = rows.select("_text").mapInArrow(run, "_hash long, _bucket long, _n long")
    return parts.groupBy("_hash").agg(F.max("_bucket").alias("_bucket"), F.sum("_n").alias("_n"))


def tokens_of(w: Words, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and classes of all tokens, ends included; where texts begin; the words' buckets."""
    buckets = bucket_of(w.data, w.start, w.end)
    inputs, own = classes.of(w.hash, buckets)
    inputs, first = with_ends(inputs, w.first, classes.input_end)
    return contexts(inputs, first, classes.input_end), with_ends(own, w.first, classes.end)[0], first, buckets


def _taught(batches: Iterator[pa.RecordBatch], model: LogBilinear, classes: Classes, rate: float, seed: list[int]) -> int:
    """Trains the model on all tokens of the batches; how many they are."""
    seen, past, chance = 0, None, np.random.default_rng(seed)
    for batch in batches:
        for _, part in pieces(texts_of(batch.column(0))):
            before, target, _, _ = tokens_of(words_of(part), classes)
            past = model.train(before, target, chance, rate=rate, past=past)
            seen += len(target)
    return seen


def train(rows: DataFrame, classes: Classes, counts: np.ndarray, n_rows: int) -> LogBilinear:
    """The model for rows of _id and _text."""
    model = LogBilinear.fresh(counts, classes.inputs)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.unpack(model.pack())
        if _taught(batches, own, classes, 0.08, [SEED]):
            yield pa.RecordBatch.from_pydict({"_flat": [own.pack().tobytes()]})

    # picked in all tasks; only the few meet in one, in an order of their own
    few = rows.where(hash_share(F.col("_id"), START_DOCS, n_rows)).repartition(1).sortWithinPartitions("_id", F.xxhash64("_text")).select("_text")
    for (flat,) in few.mapInArrow(begin, "_flat binary").collect():  # one model
        model = model.unpack(np.frombuffer(flat, np.float32))
    start = model.pack()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = model.unpack(start)
        if seen := _taught(batches, own, classes, 0.03, [SEED, TaskContext.get().partitionId()]):
            flat = own.pack()
            parts = [flat[a : a + CHUNK].tobytes() for a in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_pydict({"_at": np.arange(len(parts)), "_part": parts, "_seen": np.full(len(parts), float(seen))})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, float] = {}
        for batch in batches:
            for at, part, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(part.as_buffer(), np.float32) * float(n)
                sums[at], seen[at] = sums.get(at, 0) + own, seen.get(at, 0.0) + n
        if sums:
            yield pa.RecordBatch.from_pydict({"_at": list(sums), "_part": [(sums[k] / seen[k]).astype(np.float32).tobytes() for k in sums]})

    parts = rows.select("_text").mapInArrow(run, "_at long, _part binary, _seen double").repartition("_at")
    for at, part in parts.mapInArrow(mean, "_at long, _part binary").collect():  # one model, in parts
        start[at * CHUNK : at * CHUNK + len(part) // 4] = np.frombuffer(part, np.float32)
    return model.unpack(start)


@dataclass
class Trained:
    """All that scoring needs. hashes (sorted) and logs: log10 of count + 0.5 of the most frequent
    words; shares: the same of each class of words; counts: every word's, by hash."""

    classes: Classes
    model: LogBilinear
    hashes: np.ndarray
    logs: np.ndarray
    shares: np.ndarray
    ends: int
    total: int
    kinds: int
    counts: DataFrame


def learn(rows: DataFrame, frequent: int = FREQUENT) -> Trained:
    """The model and counts of rows of _id and _text."""
    counts = cut(count_words(rows))
    ends = rows.count()
    kinds, total = counts.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    known = most_frequent(counts, frequent, "_n", "_hash").select("_hash", "_n").toPandas().sort_values(["_n", "_hash"], ascending=[False, True])
    hashes, n = known["_hash"].to_numpy(np.int64).view(np.uint64), known["_n"].to_numpy(np.int64)
    classes = Classes.by_rank(hashes[:INPUTS])
    own, shares = np.zeros(classes.n), np.full(BUCKETS, 0.5)
    own[: classes.end], own[classes.end] = n[: classes.end], ends
    rest = counts.where(~F.col("_hash").isin([int(h) for h in hashes[: classes.end].view(np.int64)]) if classes.end else F.lit(True))
    for b, words, tokens in rest.groupBy("_bucket").agg(F.count("*"), F.sum("_n")).collect():  # BUCKETS rows
        own[classes.end + 1 + b], shares[b] = tokens, tokens + 0.5 * words + 0.5
    model = train(rows, classes, own, ends)
    order = np.argsort(hashes)
    return Trained(classes, model, hashes[order], np.log10(n[order] + 0.5), np.log10(shares), ends, total + ends, kinds + (ends > 0), counts)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, frequent: int = FREQUENT) -> DataFrame:
    """Per document: its id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    known = learn(rows.where(crc_mod(F.col("_id"), folds) != held_out), frequent)
    classes, model, hashes, logs, share_logs, ends = known.classes, known.model, known.hashes, known.logs, known.shares, known.ends
    total, end_log = known.total, np.log10(known.ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found, logged, scored, rare = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float, object))
            for at, part in pieces(texts_of(batch.column(1))):
                w = words_of(part)
                before, seq, first, buckets = tokens_of(w, classes)
                spot = np.minimum(np.searchsorted(hashes, w.hash), max(0, len(hashes) - 1))
                common = hashes[spot] == w.hash if len(hashes) else np.zeros(len(w.hash), bool)
                log = np.where(common, logs[spot], 0.0) if len(hashes) else np.zeros(len(w.hash))
                words = np.delete(np.arange(len(seq)), first[1:] - 1)
                inner = np.where(seq[words] > classes.end, log - share_logs[buckets], 0.0)
                chances = model.log10(before, seq)
                chances[words] += inner
                for k in range(len(part)):
                    a, b = w.first[k], w.first[k + 1]
                    size[at + k], found[at + k] = b - a + 1, common[a:b].sum() + (ends > 0)
                    logged[at + k] = log[a:b].sum() + end_log
                    scored[at + k] = chances[first[k] : first[k + 1]].sum()
                    rare[at + k] = signed(w.hash[a:b][~common[a:b]])
            lists = pa.array(list(rare), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (size, found, logged, scored)), lists], names=["_id", "_size", "_found", "_logs", "_score", "_rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    half = rows.select("_id", "_text").mapInArrow(run, f"_id {kind}, _size long, _found long, _logs double, _score double, _rare array<long>")
    half = cut(half.withColumn("_row", F.monotonically_increasing_id()))
    # words beyond the broadcast ones: a row for each word of a document, joined by hash
    asked = half.select("_row", F.explode("_rare").alias("_hash"))
    counted = asked.join(known.counts.select("_hash", "_n"), "_hash", "left")
    log = F.log10(F.coalesce(F.col("_n"), F.lit(0)) + 0.5)
    sums = counted.groupBy("_row").agg(F.sum(log).alias("_more"), F.count("_n").alias("_more_found"))
    joined = half.drop("_rare").join(sums, "_row", "left")
    more = F.coalesce(F.col("_more"), F.lit(0.0))
    unit = float(np.log10(total + 0.5 * (known.kinds + 1)))
    return joined.select(
        F.col("_id").alias(id_col),
        (crc_mod(F.col("_id"), folds) == held_out).alias("held_out"),
        F.col("_size").alias("n_tokens"),
        (F.col("_found") + F.coalesce(F.col("_more_found"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_logs") + more - F.col("_size") * unit).alias("base_score"),
        (F.col("_score") + more).alias("score"),
    )
