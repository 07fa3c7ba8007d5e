"""Benchmark decontamination with a hash set of n-grams (DataFrame functions only).

Words are runs of A-Z (lower-cased), a-z, 0-9 and non-ASCII characters. A benchmark item gives
its windows of 13 consecutive words; an item of 1 to 12 words is one window. Every place of a
document is hashed over as many words, looked up among the hashed windows, and each match is
verified against the window's words.

Each word is hashed once; a window's hash is that of its words' hashes. The windows are broadcast
only if their counted number is at most ``broadcast_windows`` and their words' bytes are at most
``BROADCAST_BYTES`` (a word may be of any length); beyond that places meet windows by a shuffle on
the hash, and only documents with a meeting are compared word by word; the result is
the same.

Cases: a null text has no words; equal rows get equal results; a benchmark row with a null id
marks words as hit but isn't listed; an item that repeats counts once; an empty benchmark marks
nothing; an empty document table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut

WINDOW = 13
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 256 << 20
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """The words of a text; splitting at single blanks is much cheaper than finding each word."""
    words = F.split(F.trim(F.regexp_replace(ascii_lower(text), BETWEEN, " ")), " ")
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hash(hashes: Column, at: Column, n: int) -> Column:
    """The hash of n words, from those of each."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _ascending(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _said(at: Column, n: Column) -> Column:
    """The words of a window, joined by spaces."""
    return F.array_join(F.slice("_all", at + 1, n), " ")


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows of _item, _len, _hash, _words (joined by spaces)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_item"), tokens(F.col(text_col)).alias("_all"))
    items = items.where(F.size("_all") > 0).withColumn("_len", F.least(F.size("_all"), F.lit(n))).withColumn("_hashes", _hashes(F.col("_all")))
    placed = items.withColumn("_at", F.explode(_ascending(F.size("_all") - F.col("_len") + 1)))
    kinds = F.lit(None).cast("long")
    for size in range(1, n + 1):
        kinds = F.when(F.col("_len") == size, _hash(F.col("_hashes"), F.col("_at"), size)).otherwise(kinds)
    return placed.select("_item", "_len", kinds.alias("_hash"), _said(F.col("_at"), F.col("_len")).alias("_words")).distinct()


def _window_ids(windows: DataFrame) -> DataFrame:
    """Distinct windows; two of equal hash differ in _nth."""
    return windows.groupBy("_len", "_hash").agg(F.array_sort(F.collect_set("_words")).alias("_texts")).select(
        "_len", "_hash", F.posexplode("_texts").alias("_nth", "_words")
    )


def matches(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, broadcast_windows: int) -> DataFrame:
    """Two kinds of rows from one look at the texts: one for each document, with its n_words and
    _nth null, and one for each window at each place: _id, _text (hash of the text), _at, _len,
    _hash, _nth. known: the distinct windows."""
    n, size_of_words, lengths = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_words")), F.lit(0)), F.sort_array(F.collect_set("_len"))).first()
    text = F.col(text_col)
    split = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), tokens(text).alias("_all"))
    # outer: a document without words has its row too, and no filter is derived that would split texts again
    placed = split.select("*", _hashes(F.col("_all")).alias("_hashes")).select("*", F.size("_all").cast("long").alias("n_words"), F.posexplode_outer("_hashes").alias("_at", "_own"))
    here, size = F.col("_at"), F.size("_all")
    lengths = [int(k) for k in lengths or [WINDOW]]
    kinds = [F.when(here + k <= size, _hash(F.col("_hashes"), here, k)) for k in lengths]
    if len(kinds) == 1:
        hashed = placed.select("*", kinds[0].alias("_key"), F.lit(True).alias("_one"))
    else:
        hashed = placed.select("*", F.inline(F.array(*[F.struct(h.alias("_key"), F.lit(k == lengths[0]).alias("_one")) for k, h in zip(lengths, kinds, strict=True)])))
    same = _said(here, F.col("_len")) == F.col("_words")
    document = F.col("_one") & ((here == 0) | here.isNull())
    out = ["_id", "_text", "n_words", "_at", "_len", "_hash", "_nth"]
    if n <= broadcast_windows and size_of_words <= BROADCAST_BYTES:
        # one long as the key; the length is part of the hash, and of the verified words
        met = hashed.join(F.broadcast(known), (F.col("_key") == F.col("_hash")) & same, "left")
        met = met.where(document | F.col("_nth").isNotNull())
        alone = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in zip(out[3:], ("int", "int", "long", "int"), strict=True)])
        own = F.struct(*out[3:])
        each = F.when(F.col("_nth").isNull(), F.array(alone)).when(document, F.array(own, alone)).otherwise(F.array(own))
        return met.select("_id", "_text", "n_words", F.inline(each))
    # too many to broadcast: places meet windows by hash, then the words of the few that do are compared
    places = hashed.select("_id", "_text", "_at", "_key").join(known.hint("merge"), F.col("_key") == F.col("_hash"))
    where = places.groupBy("_id", "_text").agg(F.collect_set(F.struct("_at", "_len", "_hash", "_nth", "_words")).alias("_places")).alias("p")
    both = split.alias("d").join(where, F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d._text") == F.col("p._text")))
    found = both.select("d._id", "d._text", "_all", F.size("_all").cast("long").alias("n_words"), F.inline("_places")).where(same).select(*out)
    return found.union(split.select("_id", "_text", size.cast("long"), *[F.lit(None).cast(found.schema[c].dataType) for c in out[3:]]))


def _covered(spans: Column) -> Column:
    """Words inside any of the (at, len) spans, given in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(state, span):
        end = span["_at"] + span["_len"]
        return F.struct(
            (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["upto"], span["_at"]))).alias("n"),
            F.greatest(state["upto"], end).alias("upto"),
        )

    return F.aggregate(spans, start, add, lambda s: s["n"].cast("long"))


def hits_by_document(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Per distinct document with a hit: _id, _text, _words (of the document), _spans (places and
    lengths, in order), _hits (words), _items (ids as sorted strings). And a row for each row of
    docs: _id, _text, n_words."""
    windows = cut(windows_of(benchmark, item_col, item_text_col, window))
    known = cut(_window_ids(windows))
    met = cut(matches(docs, known, id_col, text_col, broadcast_windows))
    found = met.where("_nth IS NOT NULL").distinct()
    # a document's places are at most its words, so they fit where the document fits
    spans = cut(
        found.groupBy("_id", "_text").agg(
            F.first("n_words").alias("_words"),
            F.array_sort(F.collect_set(F.struct("_at", "_len"))).alias("_spans"),
            F.collect_set(F.struct("_len", "_hash", "_nth")).alias("_kinds"),
        )
    )
    owners = known.join(windows, ["_len", "_hash", "_words"]).select("_item", "_len", "_hash", "_nth")
    # a window that many documents share would meet them all in one task, so it goes to them
    owners = F.broadcast(owners) if windows.count() <= broadcast_windows else owners
    listed = (
        spans.select("_id", "_text", F.inline("_kinds")).join(owners, ["_len", "_hash", "_nth"])
        .groupBy("_id", "_text").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    )
    both = spans.alias("s").join(listed.alias("l"), F.col("s._id").eqNullSafe(F.col("l._id")) & (F.col("s._text") == F.col("l._text")))
    hits = both.select("s._id", "s._text", "_words", "_spans", _covered(F.col("_spans")).alias("_hits"), "_items")
    return hits, met.where("_nth IS NULL").select("_id", "_text", "n_words")


def _with_hits(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as one value _doc, so their columns can't clash, with their hits if any."""
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_own"), F.xxhash64(F.col(text_col)).alias("_key"))
    return keyed.join(hits, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left")


def _contaminated(hits: Column, words: Column) -> Column:
    return (hits > 0) & (hits * 20 >= words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    hits, counted = hits_by_document(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    joined = counted.alias("d").join(hits.alias("h"), F.col("d._id").eqNullSafe(F.col("h._id")) & (F.col("d._text") == F.col("h._text")), "left")
    n_hit, items = F.coalesce(F.col("_hits"), F.lit(0)).cast("long"), F.coalesce(F.col("_items"), F.array().cast("array<string>"))
    return joined.select(
        F.col("d._id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated documents; all others stay as they are."""
    hits, _ = hits_by_document(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = F.coalesce(_contaminated(F.col("_hits"), F.col("_words")), F.lit(False))
    return _with_hits(docs, hits, id_col, text_col).where(~bad).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the hit words cut out of their texts; the text around them stays as it is."""
    hits, _ = hits_by_document(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    # each piece is a word with what stands before it; the tail after the last word stays
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.col("_doc").getField(text_col)
    parts = F.regexp_extract_all(text, F.lit(piece), 0)
    clear = lambda k: ~F.exists("_spans", lambda s: (s["_at"] <= k) & (k < s["_at"] + s["_len"]))
    indexed = F.transform(parts, lambda word, k: F.when(clear(k), word).otherwise(F.lit("")))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    cleaned = F.when(F.col("_hits") > 0, F.concat(F.array_join(indexed, ""), tail)).otherwise(text)
    return _with_hits(docs, hits, id_col, text_col).select(*[(cleaned if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
kinds AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, kinds WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, item FROM places p JOIN grams USING (n, g)),
words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM found) GROUP BY r),
lists AS (SELECT r, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS items FROM found GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN lists USING (r)
"""
