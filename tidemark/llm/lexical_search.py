"""Ranked lexical search: postings traversed in fixed windows, scatter-added and harvested.

A term is a run of A-Z (lower-cased), a-z, 0-9 and non-ASCII characters. The items' terms are the
vocabulary; every whole document becomes a row of its length and, for the vocabulary's terms that
it holds, their numbers and frequencies. From these rows come the counts (documents, their terms,
documents a term) and so the weights.

Scoring: rows are dealt by ranges of doc_id and sorted, so a task sees its documents in ascending
order and cuts them into windows of ``WINDOW`` documents. A window's postings are put in order of
terms once, each with its part of the score. Then item by item the lists of its terms are
scatter-added into one array of ``WINDOW`` scores, which fits a core's cache, while a bitset notes
which buckets of 64 were touched; only those are harvested into the item's heap of k, and cleared.
An item skips a window whose highest possible score can't enter its heap. Each task gives k rows
an item, and these are ranked.

Equal ids may be split between tasks (rows of equal id also go by a hash), and no task needs a
window whole, so no id or term can be hot. The items are broadcast in blocks of about
``BLOCK_TERMS`` terms, or one longer item; each block looks at the texts once.

Whole numbers throughout, but for the logarithm of a weight. A term is told by its 64-bit hash.

Cases: a null text has no terms, and nor has an empty one; rows that repeat are documents of their
own, also under one id; a null doc_id comes last among equal scores; each row of the items is an
item, so repeated ones give their results again; an item without terms, or whose terms no document
holds, gives no rows; a term that every document holds may weigh nothing; empty tables give an
empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, cut, pieces, signed, texts_of, words_of

K = 20
WINDOW = 1 << 13
BUCKET = 64
BLOCK_TERMS = 1_000_000
#: Bytes that no term holds, once A-Z are lower-cased.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """_row (a number of its own), _item, _terms (hashes, repeats included) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(texts_of(batch.column(2))):
                w = words_of(part, BETWEEN)
                lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(signed(w.hash)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), lists], names=["_row", "_item", "_terms"])

    kind = items.schema[id_col].dataType.simpleString()
    picked = items.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_item"), F.col(text_col).cast("binary").alias("_text"))
    return picked.mapInArrow(run, f"_row long, _item {kind}, _terms array<long>")


def postings(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _n (terms of the document), _terms (places in the broadcast, sorted vocabulary) and
    _tfs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = vocabulary.value
        for batch in batches:
            for at, part in pieces(texts_of(batch.column(1))):
                w = words_of(part, BETWEEN)
                n = np.diff(w.first)
                place = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[place] == w.hash) if len(known) else place[:0]
                owner = np.repeat(np.arange(len(part)), n)[hit]
                # in order of document, then term
                pair, tf = np.unique(owner * max(len(known), 1) + place[hit], return_counts=True)
                doc, term = np.divmod(pair, max(len(known), 1))
                offsets = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), *lists], names=["_id", "_n", "_terms", "_tfs"])

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return picked.mapInArrow(run, "_id long, _n long, _terms array<int>, _tfs array<int>")


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def parts_of_score(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of weight 1 adds to a document's score, in whole numbers."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        m = np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)
    else:
        m = 75 + 25 * n * documents // max(length, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Items:
    """Per item: its row's number, places of its distinct terms, and their weights times repeats."""

    rows: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    length: int
    vocabulary: int


class Scorer:
    """The heaps of all items over the windows of one task, in ascending order of documents."""

    def __init__(self, items: Items, k: int = K, window: int = WINDOW):
        self.items, self.k, self.window = items, k, window
        self.scores = np.zeros(-(-window // BUCKET) * BUCKET, np.int64)
        self.buckets = self.scores.reshape(-1, BUCKET)
        self.touched = np.zeros(len(self.buckets), bool)
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in items.terms]
        self.seen = 0

    def add(self, ids: list, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, owner: np.ndarray) -> None:
        """A window: ids and lengths of its documents, and postings with the places of their own."""
        order = np.argsort(terms, kind="stable")
        slots, parts = owner[order], parts_of_score(tfs[order], n[owner[order]], self.items.documents, self.items.length)
        there, start = np.unique(terms[order], return_index=True)
        first, end = np.zeros(self.items.vocabulary, np.int64), np.zeros(self.items.vocabulary, np.int64)
        first[there], end[there] = start, np.append(start[1:], len(slots))
        most = np.zeros(self.items.vocabulary, np.int64)
        if len(start):
            most[there] = np.maximum.reduceat(parts, start)
        for own, weights, heap in zip(self.items.terms, self.items.weights, self.heaps, strict=True):
            low = heap[0][0] if len(heap) == self.k else 0
            if int(most[own] @ weights) <= low:
                continue
            for a, b, w in zip(first[own].tolist(), end[own].tolist(), weights.tolist(), strict=True):
                if a < b and w:
                    at = slots[a:b]
                    self.scores[at] += w * parts[a:b]  # a document is in a list once
                    self.touched[at // BUCKET] = True
            self._harvest(heap, low, ids)
        self.seen += len(ids)

    def _harvest(self, heap: list, low: int, ids: list) -> None:
        blocks = np.flatnonzero(self.touched)
        found = self.buckets[blocks]
        block, inside = np.nonzero(found > low)
        scores, places = found[block, inside], blocks[block] * BUCKET + inside
        if len(scores) > self.k:  # the k best, ties to earlier places
            best = np.lexsort((places, -scores))[: self.k] if len(scores) < 4 * self.k else self._best(scores, places)
            scores, places = scores[best], places[best]
        for score, place in sorted(zip(scores.tolist(), places.tolist(), strict=True), key=lambda x: x[1]):
            entry = (score, -(self.seen + place), ids[place])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif score > heap[0][0]:  # an equal one came earlier, so it stays
                heapq.heapreplace(heap, entry)
        self.buckets[blocks] = 0
        self.touched[blocks] = False

    def _best(self, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        some = np.flatnonzero(scores >= kth)
        return some[np.lexsort((places[some], -scores[some]))][: self.k]

    def rows(self) -> Iterator[tuple[int, int, int | None]]:
        for item, heap in zip(self.items.rows, self.heaps, strict=True):
            for score, _, doc_id in heap:
                yield item, score, doc_id


def _scored(rows: DataFrame, shared, k: int, window: int) -> DataFrame:
    """Per task and item: _row (the item's), score and doc_id of its k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in _windows(batches, window):
            scorer = scorer or Scorer(shared.value, k, window)
            terms, tfs = batch.column(2), batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
            n = batch.column(1).to_numpy()
            scorer.add(batch.column(0).to_pylist(), n, terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), owner)
        found = list(scorer.rows()) if scorer else []
        if found:
            row, score, ids = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["_row", "score", "doc_id"])

    order = [F.col("_id").asc_nulls_last(), F.col("_salt").asc()]
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.where(F.size("_terms") > 0).withColumn("_salt", F.xxhash64("_n", "_terms", "_tfs")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("_id", "_n", "_terms", "_tfs").mapInArrow(run, "_row long, score long, doc_id long")


def _windows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of just so many (the last has the rest)."""
    held: list[pa.RecordBatch] = []
    there = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - there)
            batch = batch.slice(part.num_rows)
            held.append(part)
            there += part.num_rows
            if there == rows:
                yield pa.concat_batches(held)
                held, there = [], 0
    if held:
        yield pa.concat_batches(held)


def _block(docs: DataFrame, asked: DataFrame, scratch: Scratch, k: int, window: int, id_col: str, text_col: str) -> DataFrame | None:
    """_row, score and doc_id for the items of one block, k a task and item."""
    rows = asked.orderBy("_row").collect()  # bounded: a block
    if not rows:
        return None
    hashes = [np.array(r["_terms"], np.int64).view(np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(hashes))
    own = scratch.keep(postings(docs, scratch.share(vocabulary), id_col, text_col), "postings")
    documents, length = own.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
    held = dict(map(tuple, own.select(F.explode("_terms").alias("t")).groupBy("t").count().collect()))  # at most the vocabulary
    weights = np.array([weight(held.get(t, 0), documents) for t in range(len(vocabulary))], np.int64)
    terms, each = [], []
    for h in hashes:
        distinct, repeats = np.unique(np.searchsorted(vocabulary, h), return_counts=True)
        terms.append(distinct)
        each.append(weights[distinct] * repeats)
    items = Items([r["_row"] for r in rows], terms, each, documents, length, len(vocabulary))
    return _scored(own, scratch.share(items), k, window)


def search(docs: DataFrame, items: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    scratch = Scratch(docs.sparkSession)
    asked = cut(item_terms(items, item_col, item_text_col).where(F.size("_terms") > 0))
    total = asked.agg(F.coalesce(F.sum(F.size("_terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    found = None
    for b in range(blocks):
        part = _block(docs, asked.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b), scratch, k, window, id_col, text_col)
        if part is not None:
            part = cut(part)
            found = part if found is None else found.unionAll(part)
    scratch.drop()
    if found is None:
        found = docs.sparkSession.createDataFrame([], "_row long, score long, doc_id long")
    best = Window.partitionBy("_row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("_row", "_item"), "_row").select(F.col("_item").alias("item_id"), "rank", "doc_id", "score")


ORACLE = r"""
WITH terms AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS t
  FROM documents),
asked AS (
  SELECT row_number() OVER () AS q, item_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS t
  FROM benchmark),
size AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM terms),
items AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM asked) GROUP BY ALL),
held AS (SELECT r, doc_id, len(t)::BIGINT AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM terms) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, size GROUP BY term, n_docs),
scored AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN held USING (term), size GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
