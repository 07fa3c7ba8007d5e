"""Exact n-gram Jaccard join that skips by set relations.

A document's set are the 64-bit hashes of its distinct shingles. Equal sets are one class, known
by the hash of one of its texts. Two classes link when 100 * intersection >= ``PERCENT`` * union;
components follow the links.

Texts are cut into shingles once. Each row keeps its fingerprint, a parity sketch and the part of
its set that can stand in a prefix: the shingles of the lowest share of all hashes. Then:

1. All sets order their shingles alike: those of the lowest share first, frequent ones last among
   them. Frequencies are exact counts over all documents, kept in a table of fixed size, so two
   shingles may share a slot; this affects the order, never the result. Two linked sets share
   one of their first shingles (prefix filter), and only shingles with two owners go on.
2. Index-level skipping: entries of a shingle's list carry size and position. A pair at positions
   i, j can share min(size - position) shingles at most; lists are kept in blocks, and a block
   whose best entry can't reach the needed overlap is passed over.
3. Answer-level skipping: each list's leader (the set with least rare shingles) is joined first,
   and the exact overlaps of these pairs are kept, with what a linked set has more and less than
   its leader. A set that links with a leader takes over its component. For pairs of different
   components the leader's answers are derived further: with x near its leader L, the distance of
   x and y lies between |d(L, y) - d(L, x)| and d(L, y) + d(L, x); what these bounds leave open
   gets its exact overlap from L's, by the change from L to x alone: add the shingles that x has
   more and y has too, take off those that x lacks and y has. A leader meets y once for all that
   follow it. Only pairs of which neither has a leader are compared as whole sets themselves.
   Before that, each list names only the pairs that would join all its near components, nearest
   first (a forest, at most one pair an entry); a list is looked at in full only if one of these
   pairs does not link and its ends stay apart.
4. Candidates are tested on parity sketches (512 bits; their distance never exceeds the sets'
   distance), in the second round before they leave their list, and then verified on whole sets.
   Lists of one component go before they are gathered anywhere, and long ones are spread over
   tasks as pairs of tiles.

Components come from minimum labels with pointer jumping; links that fit one task
(``LINKS_A_TASK``) are joined there. Copies are never expanded into pairs.

Cases: a null or wordless text has an empty set and links with nothing, not even its like; with
fewer words than a shingle the whole sequence is the one shingle; rows that repeat belong
together; a component whose ids are all null has a null id; an empty table gives an empty
result; other columns are left alone, whatever their names. Sets and texts are told apart by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SMALL_PIECE, Scratch, Words, cut, heavy_rows, mix, pieces, signed, texts_of, words_of

SHINGLE = 4
PERCENT = 85
#: log2 of the slots of the level table (a byte each) and of the ownership bitmap (a bit each).
LEVEL_BITS = 22
OWNER_BITS = 27
#: A shingle counts as frequent from so many documents on.
FREQUENT = 8
SKETCH = 8
BITS = [f"_s{k}" for k in range(SKETCH)]
BLOCK = 256
#: Lists up to this length are compared together, a shift at a time.
SHORT = 64
#: Entries of a list that a task takes at once (a power of two); longer lists go as pairs of tiles.
TILE = 4096
#: Links that one task joins.
LINKS_A_TASK = 200_000
#: Keys that a task counts before it passes them on.
FLUSH = 1_000_000


# ---- sets of texts ----


@dataclass
class Sets:
    """Sets end to end, each sorted; first: where each begins, plus the end."""

    keys: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        """The set each key belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.sizes)

    @property
    def places(self) -> np.ndarray:
        return np.arange(len(self.keys)) - np.repeat(self.first[:-1], self.sizes)


def shingle_sets(w: Words, n: int) -> Sets:
    """The distinct shingle hashes of each text."""
    h, size = w.hash, len(w.hash)
    multipliers = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    whole = np.zeros(max(0, size - n + 1), np.uint64)
    for k in range(n if size >= n else 0):
        whole += h[k : size - n + 1 + k] * multipliers[k]
    whole, out = signed(mix(whole)), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(whole[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = sum((h[a + k : a + k + 1] * multipliers[k] for k in range(b - a)), np.zeros(1, np.uint64))
            out.append(signed(mix(short + np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.int64))
    return Sets(np.concatenate(out or [np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(s) for s in out], dtype=np.int64)]))


def fingerprints(s: Sets) -> np.ndarray:
    """A 64-bit hash of each set."""
    scrambled = mix(s.keys.view(np.uint64) + np.uint64(0xA0761D6478BD642F))
    none = np.zeros(1, np.uint64)
    total = np.concatenate([none, np.cumsum(scrambled, dtype=np.uint64)])[s.first]
    parity = np.concatenate([none, np.bitwise_xor.accumulate(scrambled)])[s.first]
    return signed(mix((total[1:] - total[:-1]) ^ ((parity[1:] ^ parity[:-1]) * np.uint64(3) + s.sizes.astype(np.uint64))))


def sketches(s: Sets) -> np.ndarray:
    """512 parity bits of each set as 8 longs: bit k is the parity of the shingles with place k."""
    places = (mix(s.keys.view(np.uint64) ^ np.uint64(0x589965CC75374CC3)) % np.uint64(64 * SKETCH)).astype(np.int64)
    places += s.rows * (64 * SKETCH)
    out, step = np.zeros((len(s.first) - 1, SKETCH), np.int64), 1024
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        some = places[s.first[a] : s.first[b]] - a * 64 * SKETCH
        bits = np.bincount(some, minlength=(b - a) * 64 * SKETCH) & 1
        out[a:b] = np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bits of one set."""
    return sketches(Sets(shingles, np.array([0, len(shingles)])))[0]


def prefixes(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of sets of n must meet those of any linked set."""
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def low_end(percent: int) -> int:
    """Hashes below this are the share that is counted: twice a prefix's share of a set."""
    return -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100)


def packed(keys: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of longs as one binary column."""
    ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])


def unpacked(column: pa.Array) -> Sets:
    """The longs of such a column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    keys = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].view(np.int64) if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.int64)
    return Sets(keys, (ends - ends[0]) // 8)


def _texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    text = F.col(text_col)
    return docs.select(*more, F.xxhash64(text).alias("_node"), text.cast("binary").alias("_text"))


def _described(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """_id, _node (hash of the text), _set (hash of the set), _n, sketch and _low of each row."""
    end = low_end(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(texts_of(batch.column("_text")), SMALL_PIECE):
                s, rows = shingle_sets(words_of(part), n), batch.slice(at, len(part))
                below = np.concatenate([[0], np.cumsum(s.keys < end)])[s.first]
                most = np.minimum(s.sizes, np.maximum(prefixes(s.sizes, percent), below[1:] - below[:-1]))
                low = packed(s.keys[s.places < np.repeat(most, s.sizes)], most)
                bits = [pa.array(c) for c in sketches(s).T.copy()]
                columns = [rows.column("_id"), rows.column("_node"), pa.array(fingerprints(s)), pa.array(s.sizes.astype(np.int32)), *bits, low]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_node", "_set", "_n", *BITS, "_low"])

    kind = docs.schema[id_col].dataType.simpleString()
    sketched = ", ".join(f"{b} long" for b in BITS)
    return _texts(docs, text_col, F.col(id_col).alias("_id")).mapInArrow(run, f"_id {kind}, _node long, _set long, _n int, {sketched}, _low binary")


def first_seen(sets: np.ndarray, seen: set[int]) -> np.ndarray:
    """Where a set stands for the first time in this task."""
    unique, at = np.unique(sets, return_index=True)
    new = np.array([x not in seen for x in unique.tolist()], bool)
    seen.update(unique[new].tolist())
    return np.sort(at[new])


# ---- tables of fixed size ----


def slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Tables:
    """levels: log2 of the highest count in a slot (0 if it isn't frequent); owners: a bit for
    each slot with a key of enough counts."""

    levels: np.ndarray
    owners: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        return self.levels[slots_of(keys, len(self.levels).bit_length() - 1)]

    def owned(self, keys: np.ndarray) -> np.ndarray:
        slots = slots_of(keys, len(self.owners).bit_length() + 2)
        return (self.owners[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def tables_of(rows: DataFrame, keys_in: Callable[[pa.RecordBatch, set[int]], tuple[np.ndarray, np.ndarray | None]], least: int, level_bits: int = LEVEL_BITS, owner_bits: int = OWNER_BITS) -> Tables:
    """Exact counts of all keys, put into tables. Tasks add up their own keys and deal them out
    by slot; each range of slots is filled by one task. The driver gets the tables, whose size
    doesn't depend on the rows. keys_in: keys and counts (None: one each) of a batch."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = max(6, min(12, (parts - 1).bit_length()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size, seen = [], [], 0, set()

        def flush() -> pa.RecordBatch:
            keys, n = totals(np.concatenate(held), np.concatenate(counts))
            edges = np.searchsorted(keys >> np.uint64(64 - deal), np.arange((1 << deal) + 1, dtype=np.uint64)).tolist()
            full = [k for k in range(1 << deal) if edges[k] < edges[k + 1]]
            blobs = [[x[edges[k] : edges[k + 1]].tobytes() for k in full] for x in (keys, n)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["_range", "_keys", "_counts"])

        for batch in batches:
            keys, n = keys_in(batch, seen)
            held.append(mix(keys.view(np.uint64)))
            counts.append(np.ones(len(keys), np.uint32) if n is None else n.astype(np.uint32))
            size += len(keys)
            if size > FLUSH:
                yield flush()
                held, counts, size = [], [], 0
        if size:
            yield flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, counts = None, [], []

        def filled() -> pa.RecordBatch:
            keys, n = totals(np.concatenate(held), np.concatenate(counts))
            levels, owners = np.zeros(1 << (level_bits - deal), np.uint8), np.zeros(1 << (owner_bits - deal), np.uint8)
            often = n >= FREQUENT
            slots = (keys[often] >> np.uint64(64 - level_bits)).astype(np.int64) & (len(levels) - 1)
            np.maximum.at(levels, slots, np.log2(n[often]).astype(np.uint8))
            owners[(keys[n >= least] >> np.uint64(64 - owner_bits)).astype(np.int64) & (len(owners) - 1)] = 1
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (levels, np.packbits(owners)))], names=["_range", "_levels", "_owners"])

        for batch in batches:
            for k, keys, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held and k != own:
                    yield filled()
                    held, counts = [], []
                own = k
                held.append(np.frombuffer(keys.as_buffer(), np.uint64))
                counts.append(np.frombuffer(n.as_buffer(), np.uint32))
        if held:
            yield filled()

    dealt = rows.mapInArrow(add_up, "_range int, _keys binary, _counts binary").repartition(parts, "_range").sortWithinPartitions("_range")
    out = Tables(np.zeros(1 << level_bits, np.uint8), np.zeros(1 << (owner_bits - 3), np.uint8))
    for k, levels, owners in dealt.mapInArrow(fill, "_range int, _levels binary, _owners binary").collect():
        for table, raw in ((out.levels, zlib.decompress(levels)), (out.owners, zlib.decompress(owners))):
            table[k * len(raw) : (k + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts (at most 2**32 - 1)."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.uint64)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edges], np.minimum(np.add.reduceat(counts, edges) if len(edges) else counts, 0xFFFFFFFF).astype(np.uint32)


# ---- candidates ----


def _classes(rows: DataFrame, percent: int, tables) -> DataFrame:
    """A row for each class with a first shingle that has another owner: _node, _set, _n, sketch,
    those shingles (_keys) and their positions (_ats)."""
    end = low_end(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.take(pa.array(first_seen(batch.column("_set").to_numpy(), seen)))
            s, known = unpacked(batch.column("_low")), tables.value
            rank = np.where(s.keys < end, known.level(s.keys).astype(np.int64), 255)
            row, place = s.rows, s.places
            keys = s.keys[np.argsort(row * 256 + rank, kind="stable")]
            keep = (place < np.repeat(prefixes(batch.column("_n").to_numpy().astype(np.int64), percent), s.sizes)) & known.owned(keys)
            many = np.bincount(row[keep], minlength=len(batch))
            some = np.flatnonzero(many)
            ends = pa.array(np.concatenate([[0], np.cumsum(many[some])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys[keep], place[keep].astype(np.int32))]
            rest = batch.select(["_node", "_set", "_n", *BITS]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rest.columns, *lists], names=[*rest.schema.names, "_keys", "_ats"])

    sketched = ", ".join(f"{b} long" for b in BITS)
    parts = rows.where("_n > 0").select("_node", "_set", "_n", *BITS, "_low").mapInArrow(run, f"_node long, _set long, _n int, {sketched}, _keys array<long>, _ats array<int>")
    return parts.dropDuplicates(["_set"])


def _entries(classes: DataFrame, *more: str) -> DataFrame:
    """_key, _at, _node, _n for each first shingle of each class."""
    return classes.select("_node", "_n", *more, F.explode(F.arrays_zip("_keys", "_ats")).alias("_e")).select(
        F.col("_e._keys").alias("_key"), F.col("_e._ats").alias("_at"), "_node", "_n", *more
    )


def _may_link(size: Column, at: Column, other: Column, other_at: Column, percent: int) -> Column:
    """Whether the positions leave room for the needed overlap."""
    both = (size + other).cast("long")
    return (100 + percent) * F.least(size - at, other - other_at).cast("long") >= percent * both


def _pairs_with_leaders(classes: DataFrame, percent: int) -> DataFrame:
    """Each class (_a) with the leaders of its lists (_b), once, if their sketches are near."""
    entries = _entries(classes)
    leaders = entries.groupBy("_key").agg(F.count("*").alias("_owners"), F.min(F.struct("_at", "_n", "_node")).alias("_first"))
    leaders = leaders.where("_owners > 1").select("_key", "_first.*").toDF("_key", "_l_at", "_l_n", "_l_node")
    met = entries.join(leaders, "_key").where(F.col("_node") != F.col("_l_node"))
    met = met.where(_may_link(F.col("_n"), F.col("_at"), F.col("_l_n"), F.col("_l_at"), percent))
    # a class has as many leaders as first shingles at most
    each = met.groupBy(F.col("_node").alias("_a")).agg(F.collect_set("_l_node").alias("_leaders"))
    a, b = (classes.select(F.col("_node").alias(f"_{x}"), F.col("_n").alias(f"_n_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in BITS]) for x in "ab")
    both = each.join(a, "_a").select("*", F.explode("_leaders").alias("_b")).drop("_leaders").join(b, "_b")
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS), F.lit(0))
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("_n_a") + F.col("_n_b"))).select("_a", "_b")


def block_pairs(left: tuple, right: tuple, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of two pieces of a list (same: one piece with itself) and their sketches'
    distance, block by block: components differ, positions leave room and sketches are near
    enough. A piece is its size, at, component and sketches. Blocks that can't reach any entry of
    another block, or hold its one component only, are skipped; pieces sorted by component gain."""

    def blocks(piece: tuple) -> list[tuple]:
        size, at, component, _ = piece
        room, out = size.astype(np.int64) - at, []
        for k in range(0, len(size), BLOCK):
            own = slice(k, k + BLOCK)
            one = component[k] if (component[own] == component[k]).all() else None
            out.append((k, own, int(room[own].max()), int(size[own].min()), one, size[own].astype(np.int64), room[own], component[own]))
        return out

    ours = blocks(left)
    theirs = ours if same else blocks(right)
    for x, (i, _, most, least, one, size, room, component) in enumerate(ours):
        for y, (j, _, most_y, least_y, one_y, size_y, room_y, component_y) in enumerate(theirs):
            if (same and y < x) or (100 + percent) * min(most, most_y) < percent * (least + least_y) or (one is not None and one == one_y):
                continue
            fits = (100 + percent) * np.minimum(room[:, None], room_y[None]) >= percent * (size[:, None] + size_y[None])
            fits &= component[:, None] != component_y[None]
            p, q = np.nonzero(np.triu(fits, 1) if same and x == y else fits)
            apart = np.bitwise_count(left[3][p + i] ^ right[3][q + j]).sum(1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (size[p] + size_y[q])
            if near.any():
                yield p[near] + i, q[near] + j, apart[near]


def list_pairs(size: np.ndarray, at: np.ndarray, component: np.ndarray, sketches: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs that block_pairs finds in one list."""
    piece = (size, at, component, sketches)
    found = [(np.zeros(0, np.int64),) * 2, *((p, q) for p, q, _ in block_pairs(piece, piece, percent, True))]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def pairs_in_lists(key: np.ndarray, size: np.ndarray, at: np.ndarray, component: np.ndarray, sketches: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for many lists, one after another. Short ones are compared together: each entry
    with the one k places on, as long as that is of its list."""
    edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    lengths = np.diff(edges)
    for a, b in zip(edges[:-1][lengths > SHORT].tolist(), edges[1:][lengths > SHORT].tolist(), strict=True):
        piece = tuple(x[a:b] for x in (size, at, component, sketches))
        for p, q, apart in block_pairs(piece, piece, percent, True):
            yield p + a, q + a, apart
    size = size.astype(np.int64)
    room = size - at
    stop = np.repeat(edges[1:], lengths)
    here = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT), lengths))
    for k in range(1, SHORT):
        here = here[here + k < stop[here]]
        if not len(here):
            break
        there = here + k
        fits = (component[here] != component[there]) & ((100 + percent) * np.minimum(room[here], room[there]) >= percent * (size[here] + size[there]))
        p, q = here[fits], there[fits]
        apart = np.bitwise_count(sketches[p] ^ sketches[q]).sum(1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (size[p] + size[q])
        if near.any():
            yield p[near], q[near], apart[near]


class Forest:
    """Pairs of entries that would join all components which their lists' near pairs join."""

    def __init__(self, groups: np.ndarray):
        """groups: of each entry, the first entry of its list and component."""
        self.groups, self.parent = groups, {}

    def _find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def of(self, p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of the pairs that go into the forest, nearest first."""
        a, b = self.groups[p], self.groups[q]
        order = np.argsort(apart, kind="stable")
        both = np.stack([np.minimum(a, b), np.maximum(a, b)])[:, order]
        nearest = np.sort(np.unique(both, axis=1, return_index=True)[1])  # one for two components
        taken: list[int] = []
        for k, x, y in zip(order[nearest].tolist(), *both[:, nearest].tolist(), strict=True):
            x, y = self._find(x), self._find(y)
            if x != y:
                self.parent[y] = x
                taken.append(k)
        return tuple(x[taken] for x in (p, q, apart))


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Of each entry, the first of the run of equal values it belongs to."""
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _found(key, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.minimum(a, b), np.maximum(a, b), apart)], names=["_key", "_a", "_b", "_apart"])


FOUND = "_key long, _a long, _b long, _apart long"


def _near_in_lists(entries: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Near pairs of different components in each list, where no list is long: all of them, or a
    forest. A pair comes from each list that finds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, at, node, size, label = columns[:5]
            bits = np.stack(columns[5:], 1).view(np.uint64)
            trees = Forest(_groups(key, label)) if forest and len(key) else None
            for p, q, apart in pairs_in_lists(key, size, at, label, bits, percent):
                if forest:
                    p, q, apart = trees.of(p, q, apart)
                if len(p):
                    yield _found(key[p], node[p], node[q], apart)

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            begun = int(np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))[-1])
            yield from pairs([c[:begun] for c in columns])
            held = [c[begun:] for c in columns]
        if held is not None:
            yield from pairs(held)

    ordered = entries.select("_key", "_at", "_node", "_n", "_label", *BITS).repartition("_key").sortWithinPartitions("_key", "_label", "_n")
    return ordered.mapInArrow(run, FOUND)


def _tile_pairs(rows: DataFrame, percent: int, tile: int, scratch: Scratch) -> DataFrame:
    """Lists of many entries as pairs of tiles of at most ``tile`` entries of a list: each row
    once for every pair of its tile, with the pair (_p, _q) and its side of it. Tiles follow the
    components, so that most pairs of tiles within a component fall away here."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, last, inside = TaskContext.get().partitionId() << 40, None, 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            tiles = np.empty(len(key), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if key[a] != last:
                    made, last, inside = made + 1, key[a], 0
                place = inside + np.arange(b - a)
                tiles[a:b] = made + place // tile
                made, inside = made + (inside + b - a) // tile, (inside + b - a) % tile
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles)], names=[*batch.schema.names, "_tile"])

    order = ["_key", "_label", "_n", "_node"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tiled = scratch.keep(ranged.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("_tile", T.LongType())])))
    about = tiled.groupBy("_key", "_tile").agg(
        F.min("_label").alias("_low"), F.max("_label").alias("_high"), F.min("_n").alias("_least"), F.max(F.col("_n") - F.col("_at")).alias("_most")
    )
    left, right = (about.select("_key", *[F.col(c).alias(f"{c}_{side}") for c in about.columns[1:]]) for side in "pq")
    one = (F.col("_low_p") == F.col("_high_p")) & (F.col("_low_q") == F.col("_high_q")) & (F.col("_low_p") == F.col("_low_q"))
    reach = (100 + percent) * F.least("_most_p", "_most_q").cast("long") >= percent * (F.col("_least_p") + F.col("_least_q")).cast("long")
    pairs = left.join(right, "_key").where((F.col("_tile_p") <= F.col("_tile_q")) & ~one & reach).select(F.col("_tile_p").alias("_p"), F.col("_tile_q").alias("_q"))
    pairs = scratch.keep(pairs)
    sides = pairs.select("_p", "_q", F.col("_p").alias("_tile"), F.lit(0).alias("_side")).union(
        pairs.where("_p <> _q").select("_p", "_q", F.col("_q").alias("_tile"), F.lit(1).alias("_side"))
    )
    return tiled.join(sides, "_tile").drop("_tile")


def _near_in_parts(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Near pairs of each part (_p, _q) of rows: of its entries, or of those of its two sides; all
    of them, or a forest. A pair comes from each list that finds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nodes, size, at, label, key = rows[3:8]
            piece = (size, at, label, np.stack(rows[8:], 1).view(np.uint64))
            second = int(np.searchsorted(rows[2], 1))
            whole = second == len(nodes)
            left, right = (piece, piece) if whole else (tuple(c[:second] for c in piece), tuple(c[second:] for c in piece))
            trees = Forest(np.unique(label, return_inverse=True)[1]) if forest else None
            for p, q, apart in block_pairs(left, right, percent, whole):
                q = q if whole else q + second
                if forest:
                    p, q, apart = trees.of(p, q, apart)
                if len(p):
                    yield _found(key[p], nodes[p], nodes[q], apart)

        held: list[list[np.ndarray]] = []  # of the part that may go on

        def parts() -> Iterator[list[np.ndarray]]:
            nonlocal held
            for batch in batches:
                columns = [c.to_numpy() for c in batch.columns]
                p, q = columns[:2]
                if not len(p):
                    continue
                if held and (held[-1][0][-1] != p[0] or held[-1][1][-1] != q[0]):
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                edges = np.concatenate([[0], np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1, [len(p)]]).tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    held.append([c[a:b] for c in columns])
                    if b < len(p):
                        yield [np.concatenate(c) for c in zip(*held, strict=True)]
                        held = []
            if held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]

        for rows in parts():
            yield from part(rows)

    columns = ["_p", "_q", "_side", "_node", "_n", "_at", "_label", "_key", *BITS]
    ordered = rows.select(*columns).repartition("_p", "_q").sortWithinPartitions("_p", "_q", "_side", "_label", "_n", "_node")
    return ordered.mapInArrow(run, FOUND)


def _pairs_across(classes: DataFrame, percent: int, scratch: Scratch, tile: int = TILE, *, keys: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """Pairs of classes of different components (_label) that meet in a list (_key), with their
    sketches' distance: all of them, or a forest of each list. A list of fewer than ``tile``
    entries is compared in one task; longer ones are spread over tasks as pairs of tiles, so no
    task holds more than two tiles of a list. keys: the only lists to look at."""
    lists = _entries(classes, "_label").groupBy("_key").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high"), F.count("*").alias("_owners"))
    lists = lists.where("_low <> _high")
    if keys is not None:
        lists = lists.join(keys, "_key", "left_semi")
    # only lists of several components go on; long ones are told by the level of their length
    mixed = tables_of(lists.select("_key", "_owners"), lambda b, _: (b.column(0).to_numpy(), b.column(1).to_numpy()), 1)
    long_from = tile.bit_length() - 1
    tables = scratch.share(mixed)

    def of(long: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("_keys")
                keys, known = lists.flatten().to_numpy(), tables.value
                row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
                at = batch.column("_ats").flatten().to_numpy()
                keep = np.flatnonzero(known.owned(keys) & ((known.level(keys) >= long_from) == long))
                rest = batch.select(["_node", "_n", "_label", *BITS]).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(at[keep]), *rest.columns], names=["_key", "_at", *rest.schema.names])

        sketched = ", ".join(f"{b} long" for b in BITS)
        return classes.mapInArrow(run, f"_key long, _at int, _node long, _n int, _label long, {sketched}")

    found = _near_in_lists(of(False), percent, forest)
    if (mixed.levels >= long_from).any():
        found = found.union(_near_in_parts(_tile_pairs(of(True), percent, tile, scratch), percent, forest))
    return found


# ---- answers ----


def _inside(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which keys are in own (sorted)."""
    return own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys if len(own) else np.zeros(len(keys), bool)


ANSWER = "_a long, _b long, _d long, _both long, _linked boolean, _plus binary, _minus binary"


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, n: int, percent: int, scratch: Scratch, changes: DataFrame | None = None) -> DataFrame:
    """The pairs (_a, _b) with the exact distance _d and overlap _both of their sets, whether they
    link, and for those that do what _a has that _b hasn't (_plus) and the other way (_minus).
    changes: pairs whose overlap comes from their leader's (as _changes gives them); a leader meets
    each _b once, whatever the number of its followers. Only the texts that are asked for are cut
    into shingles again."""
    pairs = pairs.select("_a", "_b")
    nodes = pairs
    if changes is not None:
        pairs = scratch.keep(pairs.union(changes.where("_base IS NULL").select("_leader", "_b")).distinct())
        nodes = pairs.union(changes.select("_b", "_b"))
    # sixteen slots a set; where the bitmap's bound is too small, more texts are cut than asked for
    bits = max(16, min(OWNER_BITS, (32 * nodes.count()).bit_length()))
    wanted = scratch.share(tables_of(nodes, lambda b, _: (np.unique(np.concatenate([c.to_numpy() for c in b.columns])), None), 1, 12, bits))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column("_node").to_numpy()
            take = np.flatnonzero(wanted.value.owned(nodes))
            take = take[first_seen(nodes[take], seen)]
            for at, part in pieces(texts_of(batch.column("_text").take(pa.array(take))), SMALL_PIECE):
                s = shingle_sets(words_of(part), n)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[take[at : at + len(part)]]), packed(s.keys, s.sizes)], names=["_node", "_blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, both = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            plus, minus = [None] * len(batch), [None] * len(batch)
            left, right = (unpacked(batch.column(c)) for c in ("_blob_a", "_blob_b"))
            for k in range(len(batch)):
                p, q = (s.keys[s.first[k] : s.first[k + 1]] for s in (left, right))
                common = _inside(q, p)
                both[k], apart[k] = common.sum(), len(p) + len(q) - 2 * common.sum()
                if 100 * both[k] >= percent * (both[k] + apart[k]):
                    plus[k], minus[k] = p[~_inside(p, q)].tobytes(), q[~common].tobytes()
            yield answers(batch, apart, both, plus, minus)

    def answers(batch: pa.RecordBatch, apart: np.ndarray, both: np.ndarray, plus: list, minus: list) -> pa.RecordBatch:
        linked = pa.array(100 * both >= percent * (both + apart))
        columns = [pa.array(apart), pa.array(both), linked, pa.array(plus, pa.binary()), pa.array(minus, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.select(["_a", "_b"]).columns, *columns], names=["_a", "_b", "_d", "_both", "_linked", "_plus", "_minus"])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("_base").to_numpy().astype(np.int64)
            size, other = batch.column("_n_a").to_numpy().astype(np.int64), unpacked(batch.column("_blob_b"))
            for k, (plus, minus) in enumerate(zip(batch.column("_plus"), batch.column("_minus"), strict=True)):
                own = other.keys[other.first[k] : other.first[k + 1]]
                more, less = (np.frombuffer(x.as_buffer(), np.int64) for x in (plus, minus))
                both[k] += _inside(more, own).sum() - _inside(less, own).sum()
            none = [None] * len(batch)
            yield answers(batch, size + other.sizes - 2 * both, both, none, none)

    blobs = _texts(docs, text_col).mapInArrow(sets_of, "_node long, _blob binary")
    with heavy_rows(docs.sparkSession):
        blobs = scratch.keep(blobs.groupBy("_node").agg(F.first("_blob").alias("_blob")), "sets")
    a, b = (blobs.select(F.col("_node").alias(f"_{x}"), F.col("_blob").alias(f"_blob_{x}")) for x in "ab")
    with heavy_rows(docs.sparkSession):
        found = scratch.keep(pairs.join(a, "_a").join(b, "_b").select("_a", "_b", "_blob_a", "_blob_b").mapInArrow(compare, ANSWER))
    if changes is not None:
        of_leader = found.select(F.col("_a").alias("_leader"), "_b", "_both")
        based = changes.join(of_leader, ["_leader", "_b"], "left").withColumn("_base", F.coalesce("_base", "_both"))
        with heavy_rows(docs.sparkSession):
            found = scratch.keep(found.union(based.join(b, "_b").select("_a", "_b", "_n_a", "_base", "_plus", "_minus", "_blob_b").mapInArrow(change, ANSWER)))
    scratch.forget()
    return found


def joined(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (two rows) and the smallest node that each can reach."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least, was = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == was).all():
            return nodes, nodes[label]


def components(links: DataFrame, scratch: Scratch, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """_node and _label (the smallest node reachable) for each node of the links _a, _b."""
    links, many = links.select("_a", "_b"), links.count()
    if many <= links_a_task:

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
            if held:
                nodes, label = joined(np.concatenate(held, 1))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["_node", "_label"])

        return scratch.keep(links.repartition(1).mapInArrow(at_once, "_node long, _label long"), "labels")
    edges = scratch.keep(links.union(links.select("_b", "_a")).distinct().toDF("_node", "_to"), "links")
    labels = scratch.keep(edges.groupBy("_node").agg(F.least(F.col("_node"), F.min("_to")).alias("_label")), "labels")
    while True:
        reach = labels.select(F.col("_node").alias("_to"), F.col("_label").alias("_reached"))
        nearest = edges.join(reach, "_to").groupBy("_node").agg(F.min("_reached").alias("_reached"))
        lower = labels.join(nearest, "_node").select("_node", F.col("_label").alias("_old"), F.least("_label", "_reached").alias("_mid"))
        jump = labels.select(F.col("_node").alias("_mid"), F.col("_label").alias("_far"))
        moved = scratch.keep(lower.join(jump, "_mid").select("_node", "_old", F.least("_mid", "_far").alias("_label")), "labels")
        labels = moved.select("_node", "_label")
        if moved.where("_label <> _old").isEmpty():
            return labels


def _derived(pairs: DataFrame, answers: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """pairs with _known: true or false where a common leader's answers decide the pair, null
    where they don't. answers: exact distances _d of classes _a and leaders _b."""
    home = answers.where("_linked").groupBy("_a").agg(F.min_by(F.struct("_b", "_d"), F.struct("_d", "_b")).alias("_home"))
    each = pairs.select("_a", "_b").join(home.select(F.col("_a"), F.col("_home._b").alias("_leader"), F.col("_home._d").alias("_near")), "_a")
    other = answers.select(F.col("_a").alias("_b"), F.col("_b").alias("_leader"), F.col("_d").alias("_far"))
    both = each.join(other, ["_b", "_leader"])
    n = [sizes.select(F.col("_node").alias(f"_{x}"), F.col("_n").alias(f"_n_{x}")) for x in "ab"]
    both = both.join(n[0], "_a").join(n[1], "_b")
    most = (100 - percent) * (F.col("_n_a") + F.col("_n_b"))  # of (100 + percent) times the distance
    known = F.when((100 + percent) * F.abs(F.col("_far") - F.col("_near")) > most, False).when((100 + percent) * (F.col("_far") + F.col("_near")) <= most, True)
    return both.select("_a", "_b", known.alias("_known")).where("_known IS NOT NULL")


def _changes(pairs: DataFrame, answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of the pairs, in either order, those where _a links with a leader, once each and by the
    nearest leader: _n_a, _leader, _base (the leader's overlap with _b; null where it isn't known
    yet), and what _a has more (_plus) and less (_minus) than the leader. With these
    |a and b| = _base + |_plus and b| - |_minus and b|, exactly."""
    linked = answers.where("_linked").select("_a", F.col("_b").alias("_leader"), F.col("_d").alias("_near"), "_plus", "_minus")
    home = linked.groupBy("_a").agg(F.min_by(F.struct("_leader", "_near", "_plus", "_minus"), F.struct("_near", "_leader")).alias("_home")).select("_a", "_home.*")
    other = answers.groupBy(F.col("_a").alias("_b"), F.col("_b").alias("_leader")).agg(F.max("_both").alias("_base"))
    both = pairs.select("_a", "_b").union(pairs.select("_b", "_a"))
    met = both.join(home, "_a").where("_leader <> _b").join(other, ["_b", "_leader"], "left").join(sizes.select(F.col("_node").alias("_a"), F.col("_n").alias("_n_a")), "_a")
    row = F.struct(F.col("_base").isNull().alias("_open"), "_near", "_a", "_b", "_n_a", "_leader", "_base", "_plus", "_minus")
    return met.groupBy(F.least("_a", "_b"), F.greatest("_a", "_b")).agg(F.min(row).alias("_row")).select("_row.*").drop("_near", "_open")


def _answered(asked: DataFrame, first: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """_a, _b and _linked of all asked pairs: by the bounds that leaders' answers give, else by a
    leader's answer and the change from the leader, else by whole sets."""
    back = asked.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))
    bounded = _derived(asked, first, classes, percent).union(_derived(back, first, classes, percent).select("_b", "_a", "_known"))
    bounded = scratch.keep(bounded.groupBy("_a", "_b").agg(F.max("_known").alias("_linked")))
    left = asked.join(bounded, ["_a", "_b"], "left_anti")
    changes = scratch.keep(_changes(left, first, classes))
    plain = scratch.keep(left.join(changes.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")), ["_a", "_b"], "left_anti"))
    found = _verified(plain, docs, text_col, n, percent, scratch, changes)
    return bounded.union(found.select(F.least("_a", "_b"), F.greatest("_a", "_b"), "_linked"))


def _links(docs: DataFrame, text_col: str, rows: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The classes that share a first shingle with another, and _node and _label of those that
    link with another."""
    def low(batch: pa.RecordBatch, seen: set[int]) -> tuple[np.ndarray, None]:
        return unpacked(batch.column(1).take(pa.array(first_seen(batch.column(0).to_numpy(), seen)))).keys, None

    with heavy_rows(docs.sparkSession):
        tables = scratch.share(tables_of(rows.where("_n > 0").select("_set", "_low"), low, 2))
        classes = scratch.keep(_classes(rows, percent, tables), "classes")
    scratch.forget()
    first = _verified(scratch.keep(_pairs_with_leaders(classes, percent)), docs, text_col, n, percent, scratch)
    links = first.where("_linked").select("_a", "_b")
    labels = components(links, scratch)
    answered = first.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"), "_linked").groupBy("_a", "_b").agg(F.max("_linked").alias("_linked"))
    # pairs that would join all that a list can join
    trees = scratch.keep(_pairs_across(_named(classes, labels), percent, scratch, forest=True), "pairs")
    if trees.isEmpty():
        return classes, labels
    asked = scratch.keep(trees.select("_a", "_b").distinct().join(answered, ["_a", "_b"], "left_anti"))
    checked = _answered(asked, first, classes, docs, text_col, n, percent, scratch)
    links = scratch.keep(links.union(checked.where("_linked").select("_a", "_b")))
    labels = components(links, scratch)
    # lists with a pair that did not link, and whose ends are still apart, are looked at in full
    failed = scratch.keep(_apart(trees, labels).select("_key").distinct())
    if failed.isEmpty():
        return classes, labels
    rest = _pairs_across(_named(classes, labels), percent, scratch, keys=failed).select("_a", "_b").distinct()
    answered = answered.union(checked.select("_a", "_b", "_linked"))
    rest = scratch.keep(rest.join(answered, ["_a", "_b"], "left_anti"))
    more = _answered(rest, first, classes, docs, text_col, n, percent, scratch).where("_linked").select("_a", "_b")
    return classes, labels if more.isEmpty() else components(links.union(more), scratch)


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    return classes.join(labels, "_node", "left").withColumn("_label", F.coalesce("_label", "_node"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a, b = (labels.select(F.col("_node").alias(side), F.col("_label").alias(f"_label{side}")) for side in ("_a", "_b"))
    return pairs.join(a, "_a", "left").join(b, "_b", "left").where(F.coalesce("_label_a", "_a") != F.coalesce("_label_b", "_b"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """_id, _node, _n, _set and _label of every row (_label: null for empty sets), computed."""
    scratch = Scratch(docs.sparkSession)
    with heavy_rows(docs.sparkSession):
        rows = scratch.keep(_described(docs, id_col, text_col, shingle, percent), "rows")
    classes, labels = _links(docs, text_col, rows, shingle, percent, scratch)
    named = classes.select("_set", "_node").join(labels, "_node").select("_set", "_label")
    out = rows.select("_id", "_node", "_n", "_set").join(named, "_set", "left")
    out = cut(out.select("_id", "_node", "_n", "_set", F.when(F.col("_n") > 0, F.coalesce("_label", "_set")).alias("_label")))
    scratch.drop()
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: its id, n_shingles and component_id."""
    named = _labelled(docs, id_col, text_col, shingle, percent)
    # only components of several rows are looked up again
    lowest = named.where("_n > 0").groupBy("_label").agg(F.min("_id").alias("_low"), F.count("*").alias("_members")).where("_members > 1")
    return named.join(lowest, "_label", "left").select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_shingles"), F.when(F.col("_members") > 1, F.col("_low")).otherwise(F.col("_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with one row of each component: that of the smallest id (a null one only
    if there is no other). Empty texts link with nothing and all stay."""
    named = _labelled(docs, id_col, text_col, shingle, percent).where("_n > 0")
    row = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_node")
    chosen = named.groupBy("_label").agg(F.min(row).alias("_kept"), F.count("*").alias("_members")).where("_members > 1")
    groups = named.join(chosen, "_label").select("_id", "_node", (row == F.col("_kept")).alias("_stays"))
    # per id and text of a group: whether it goes, and how often it stands there
    known = groups.groupBy("_id", "_node").agg(F.first("_stays").alias("_stays"), F.count("*").alias("_times")).where("NOT _stays OR _times > 1")
    known = cut(known)
    # rows as one value, so their columns can't clash
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_own"), F.xxhash64(F.col(text_col)).alias("_hash"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_node"))
    kept = rows.join(known.where("NOT _stays"), same, "left_anti")
    again = known.where("_stays")
    if not again.isEmpty():  # rows that repeat the one that stays
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["_own", "_hash"]))
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
