"""An inverted index over text columns, as a table: words to sorted lists of keys.

Rows of the index are word, block and keys. Rows of the table are dealt into blocks by a hash of
their key, about ``BLOCK`` a block, so the list of a word that every row holds is cut like all
others, and lists of different words meet block by block. The table lies sorted by word, so a
search reads little more than the lists that it asks for: exact words and prefixes reach the files
as filters.

A search takes words that must all be there; one that ends in * is a prefix. Lists of a block are
intersected, those of the words of one prefix joined first. Case doesn't count; words are runs of
letters and digits.

Cases: null texts have no words; a null key is never found; repeated keys count once; a search
without words finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
BLOCK = 100_000


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def build(rows: DataFrame, key: str, columns: list[str], *, block: int = BLOCK) -> DataFrame:
    """word, block and keys (sorted, once each) over the given columns."""
    blocks = max(1, -(-rows.count() // block))
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode(words_of(text)).alias("word"))
    grouped = each.groupBy("word", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("block"))
    return grouped.agg(F.sort_array(F.collect_set("_key")).alias("keys"))


def save(index: DataFrame, path: str) -> None:
    """By ranges of words, so that files tell by their statistics which words they hold."""
    index.repartitionByRange(F.col("word"), F.col("block")).sortWithinPartitions("word", "block").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def asked_words(query: str) -> list[tuple[str, bool]]:
    """(word, whether it is a prefix) of a search."""
    import re

    return list(dict.fromkeys((m[1].lower(), bool(m[2])) for m in re.finditer(r"([^\W_]+)(\*?)", query)))


def search(index: DataFrame, query: str) -> DataFrame:
    """key of every row that holds all words of the search."""
    asked = asked_words(query)
    kind = index.schema["keys"].dataType.elementType.simpleString()
    if not asked:
        return index.sparkSession.createDataFrame([], f"key {kind}")
    tests = [F.col("word").startswith(w) if prefix else F.col("word") == w for w, prefix in asked]
    met = index.where(reduce(Column.__or__, tests))
    # per block: the list of each asked word; a block that lacks one has none in common
    lists = [F.array_distinct(F.flatten(F.collect_list(F.when(t, F.col("keys"))))).alias(f"_{k}") for k, t in enumerate(tests)]
    common = reduce(F.array_intersect, [F.col(f"_{k}") for k in range(len(asked))])
    return met.groupBy("block").agg(*lists).select(F.explode(common).alias("key"))


def frequencies(index: DataFrame) -> DataFrame:
    """word and the number of rows that hold it."""
    return index.groupBy("word").agg(F.sum(F.size("keys")).cast("long").alias("rows"))
