"""From raw documents to token files: five stages, each one of the operators in tidemark.llm.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token files.

A stage gets all rows its predecessor kept. The first four return documents' own columns, extra
ones and those with clashing names included; the last writes the token files and returns what
stands in them, a row per document of the mix.

Cases, by stage: a null text counts as empty everywhere. Quality scores it like any other text.
Near duplicates: empty texts link with nothing and stay; of rows that repeat one stays; of a group
the smallest id stays, a null id only if there is no other. Decontamination: a text without words
stays; rows that repeat share their fate. Mixing: texts of size 0 are never taken; a null source
is a source; ties in the seeded order are taken together. Token files: null ids come last, rows
that repeat are all written. An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard_join, mixing, quality, token_files
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: groups by shingles of five words and a similarity of 0.8,
    the general rule for stages (op10's own query has a contract of four words and 0.85)."""
    return jaccard_join.one_of_each(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole."""
    return mixing.mixed_documents(docs, in_part=False)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files; returns doc_id, start, n_tokens and ids_crc32 read from them."""
    return token_files.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("token_files", tokenise),
]

#: A learned classifier and a tokeniser can't be put into SQL; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again. The token
    files are written when this returns, so the stages' tables go."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    files = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop()
    return files
