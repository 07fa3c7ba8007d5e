"""Token ids in Arrow stream files of equal-length sequences.

A shard holds the ids of a range of documents, in ascending id order, one after another and cut
into sequences of ``length``. Its file is an Arrow stream whose record batches have two
fixed-size-list columns, ``ids`` (uint16 where the vocabulary allows, else uint32) and ``mask``
(true for ids, false for the padding of the last sequence). All batches but the last have
``rows`` rows, so sequence k is row k % rows of batch k // rows; memory-mapped, it is read
without a copy. A second stream file lists doc_id, start (within the shard) and n_tokens.

Ranges come from Spark's range partitioning, so no task sees more than its share, and equal ids
may be split. A task begins a new shard after ``ROLL`` ids, so files keep their size however much
a task gets. A shard is written under a name of its own and is listed only once complete, so a
retried task leaves no half file in use.

Tokenising: texts are cut where this vocabulary's own rule always cuts (between a letter run
and anything else, and before a line break or tab that a letter follows), so what a piece is
encoded to never hangs on its neighbours. Texts are cut a block at a time, and a block's pieces
become a dictionary, so each distinct piece is looked up once a block; it is encoded once by the
tokenizers library and kept in a bounded table. Texts with characters for which these cuts are not
certain, or with one of the vocabulary's added tokens (such as an end-of-text mark), are encoded
whole.

Cases: a null text counts as empty and has only the end id; null doc_ids come last; rows that
repeat are all written (order among equal ids by hash of the text, then text); an empty table
writes no shard; columns other than id and text are not read.
"""

from __future__ import annotations

import codecs
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, new_folder, pieces

END = 2
LENGTH = 2048
ROWS = 64
#: Ids after which a task begins a new shard.
ROLL = 1 << 24
#: Distinct pieces kept per worker.
KEPT = 400_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Outside of this set, or with an apostrophe, a text is encoded whole.
_UNSURE = re.compile(r"[^\t-\r !-&(-~¡-©«-´¶-¹»-ɏ‐-‧‰-⁞€]|'")
_NO, _OTHER, _BLANK, _SPACE, _RUN = range(5)
#: The kind of each UTF-16 unit: uncertain, anything else, tab to line break, space, letter.
_KIND = np.full(1 << 16, _NO, np.uint8)
for _kind, _form in ((_OTHER, r"[^\0]"), (_BLANK, r"[\t-\r]"), (_SPACE, " "), (_RUN, f"[{_LETTER}]")):
    _KIND[[ord(c) for c in re.findall(_form, _UNSURE.sub("", "".join(map(chr, range(1 << 16)))))]] = _kind
#: Stands after each text of a block; as a piece it is the end id.
_STOP = b"\0\0"


def _cuts(kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin, and the end. A space goes with the letters after it; another blank right
    before letters stands alone; blanks before those, or before the end, stay together."""
    letters = kind == _RUN
    edge = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    begins = edge[letters[edge]]
    before = kind[begins - 1]
    here = np.zeros(len(kind) + 1, bool)
    here[edge] = True
    here[begins[before == _SPACE]] = False
    here[begins[(before == _SPACE) | (before == _BLANK)] - 1] = True
    here[0] = here[ends] = here[ends + 1] = True
    return np.flatnonzero(here)


class Encoder:
    """Texts to ids of a byte-level BPE file, as little-endian bytes of the given width."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.kept = self.whole.model, kept
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([END], self.dtype).tobytes()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        named = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.shown = "".join(named[b] for b in range(256))

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, units: bytes) -> bytes:
        if units == _STOP:
            return self.end
        piece = units.decode("utf-16-le")
        if piece[-1].isalpha():  # a run of letters is one word to the model
            shown = codecs.charmap_decode(piece.encode(), "strict", self.shown)[0]
            ids = b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in self.model.tokenize(shown)])
        else:
            ids = self._ids(piece)
        if len(piece) <= 40:
            if len(self.memo) >= self.kept:
                self.memo.clear()
            self.memo[units] = ids
        return ids

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        units = [t.encode("utf-16-le") for t in texts]
        data, ends = _STOP.join([*units, b""]), np.cumsum([len(u) // 2 + 1 for u in units], dtype=np.int64) - 1
        kind = _KIND[np.frombuffer(data, "<u2")]
        kind[ends] = _OTHER
        unsure = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        unsure.update(np.searchsorted(ends, np.flatnonzero(kind == _NO)).tolist())
        if unsure:
            rest = self._block([t for k, t in enumerate(texts) if k not in unsure])
            yield from (self._ids(t) + self.end if k in unsure else next(rest) for k, t in enumerate(texts))
            return
        at = _cuts(kind, ends)
        found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 2), pa.py_buffer(data)]).dictionary_encode()
        known, one = self.memo.get, self._piece
        ids = pa.array([known(p) or one(p) for p in found.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary()).take(found.indices)
        _, offsets, held = ids.buffers()
        to, held = np.frombuffer(offsets, np.int64)[np.searchsorted(at, ends) + 1], memoryview(held)
        for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True):
            yield bytes(held[a:b])

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text with the end id, about a megabyte of texts at once."""
        for _, block in pieces(texts):
            yield from self._block(block)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))[: -len(self.end)]


def _store(path: str):
    """(filesystem, path within) for any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Appends documents to a shard; memory holds one record batch."""

    def __init__(self, folder: str, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.files, root = _store(folder)
        self.files.create_dir(root, recursive=True)
        self.name = f"{root}/{uuid.uuid4().hex}"
        self.dtype, self.length, self.rows = dtype, length, rows
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.files.open_output_stream(f"{self.name}.arrow")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held, self.index, self.tokens, self.docs = io.BytesIO(), [], 0, 0
        self.index_out = self.files.open_output_stream(f"{self.name}.index.arrow")
        self.index_stream = pa.ipc.new_stream(self.index_out, self.index_schema)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.index.append((doc_id, self.tokens, n))
        self.tokens, self.docs = self.tokens + n, self.docs + 1
        self.held.write(ids)
        if self.held.tell() >= self.rows * self.length * self.dtype.itemsize:
            self._batches(last=False)
        if len(self.index) >= 10_000:
            self._list()

    def _batches(self, last: bool) -> None:
        held, full = np.frombuffer(self.held.getvalue(), self.dtype), self.rows * self.length
        at = 0
        while len(held) - at >= full or (last and at < len(held)):
            ids = held[at : at + full]
            at += len(ids)
            self._batch(ids)
        self.held = io.BytesIO(held[at:].tobytes())
        self.held.seek(0, io.SEEK_END)

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.length) * self.length
        values, mask = np.zeros(n, self.dtype), np.arange(n) < len(ids)
        values[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
        self.stream.write_batch(pa.record_batch(lists, schema=self.schema))

    def _list(self) -> None:
        columns = [pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)]
        self.index_stream.write_batch(pa.record_batch(columns, schema=self.index_schema))
        self.index = []

    def close(self) -> str:
        self._batches(last=True)
        if self.index:
            self._list()
        for x in (self.stream, self.out, self.index_stream, self.index_out):
            x.close()
        return self.name


class Shard:
    """A written shard: any sequence or document by its place."""

    def __init__(self, name: str, files=None):
        from pyarrow import fs

        self.name, self.files = name, files or fs.LocalFileSystem()
        source = self._open(f"{name}.arrow")
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1

    def _open(self, path: str):
        local = getattr(self.files, "type_name", "") == "local"
        return pa.memory_map(path) if local else self.files.open_input_file(path)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids, as a view of the file, and mask of sequence k."""
        batch, row = self.batches[k // self.rows], k % self.rows
        ids, mask = (c.values.slice((c.offset + row) * self.length, self.length) for c in batch.columns)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place on; they may go over several batches."""
        full, parts = self.rows * self.length, []
        while n > 0:
            b, at = divmod(start, full)
            values = self.batches[b].column(0).values.to_numpy(zero_copy_only=True)
            parts.append(values[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])

    def documents(self) -> Iterator[pa.RecordBatch]:
        yield from pa.ipc.open_stream(self._open(f"{self.name}.index.arrow"))


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rows: int = ROWS, roll: int = ROLL) -> DataFrame:
    """Writes the shards; one row for each: name, place (order), n_docs, n_tokens, start (ids of
    all shards before it). This list is kept in the shared folder, so nothing is written again."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = writer = None
        place = TaskContext.get().partitionId() << 32

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [writer.close()], "place": [place], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                writer = writer or ShardWriter(folder, encoder.dtype, length, rows)
                writer.add(doc_id, ids)
                if writer.tokens >= roll:
                    yield listed()
                    writer, place = None, place + 1
        if writer is not None:
            yield listed()

    text = F.col(text_col)
    order = [F.col("_id").asc_nulls_last(), "_salt", "_text"]
    ranged = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_salt"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ranged.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("_id", "_text")
    shards = cut(ranged.mapInArrow(write, "name string, place long, n_docs long, n_tokens long"))
    # one row a shard, some tens of megabytes each
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(shards: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(name, _store(folder)[0] if folder else None)
                for docs in shard.documents():
                    at, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(shard.ids(s, k).astype("<u4").tobytes()) for s, k in zip(at.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(at + start), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.select("name", "start").repartition(max(2, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "name")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the shards of docs under the shared folder and returns what read_documents says."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_documents(write_shards(docs, tokenizer, folder, **options), folder)
