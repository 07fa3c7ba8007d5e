"""Text scanning: patterns against the lines of many texts, and their occurrences.

Case never counts. Patterns reach the tasks as one broadcast automaton (functions.matching) for
``BLOCK`` patterns at most; a longer list goes in blocks, and each block looks at the texts once.

Cases: a null text has no lines; a null or empty pattern is left out; patterns that differ in case
alone are one (the spelling that sorts first stays); without patterns nothing is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.matching import Matcher, changed_lines

BLOCK = 50_000
SNIFF = 8192


def parse_patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """pattern and is_regex from lines: blanks and # lines go, as do comments after two blanks;
    're:' marks a regular expression."""
    bare = F.trim(F.regexp_replace(F.trim(column), r"\s{2,}#.*$", ""))
    kept = lines.select(bare.alias("p")).where("p <> '' AND NOT startswith(p, '#')").distinct()
    return kept.select(F.regexp_replace("p", "^re:", "").alias("pattern"), F.col("p").startswith("re:").alias("is_regex"))


def pattern_set(*sources: DataFrame) -> DataFrame:
    """The patterns of all sources, once each whatever their case; of spellings the first in order."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out.groupBy(F.lower("pattern"), "is_regex").agg(F.min("pattern").alias("pattern")).select("pattern", "is_regex")


def is_binary(content: str = "content", sniff: int = SNIFF):
    """Whether a NUL stands in the first bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, sniff)) > 0


def without(files: DataFrame, ignored: DataFrame, key: str = "path") -> DataFrame:
    return files.join(ignored.select(key), key, "left_anti")


def _by_block(texts: DataFrame, patterns: DataFrame | list[tuple[str, bool]], found: Callable[[Matcher, str], list[tuple]], columns: dict[str, str], key: str, text: str, block: int) -> DataFrame:
    """key, pattern and further columns of what found tells of each text (its rows begin with the
    pattern's place in the block)."""
    spark = texts.sparkSession
    if isinstance(patterns, list):
        patterns = spark.createDataFrame(patterns, "pattern string, is_regex boolean")
    wanted = pattern_set(patterns.where("pattern <> ''"))
    blocks = max(1, -(-wanted.count() // block))
    kind = texts.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "pattern string", *(f"{c} {t}" for c, t in columns.items())])
    types = {"int": pa.int32(), "bigint": pa.int64()}

    def scanned(own: list[tuple[str, bool]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Matcher(own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for batch in batches:
                at, rows = [], []
                for k, content in enumerate(batch.column(1)):
                    if (one := content.as_py()) is not None:
                        more = found(matcher, one)
                        at += [k] * len(more)
                        rows += more
                parts = list(zip(*rows, strict=True)) or [[] for _ in range(1 + len(columns))]
                out = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([matcher.patterns[k][0] for k in parts[0]], pa.string())]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(c, types[t]) for c, t in zip(parts[1:], columns.values(), strict=True))], names=[key, "pattern", *columns])

        return texts.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)

    out = None
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).orderBy("pattern", "is_regex")
        part = scanned([(r["pattern"], r["is_regex"]) for r in own.collect()])  # bounded: a block
        out = part if out is None else out.unionAll(part)
    return out


def scan_lines(texts: DataFrame, patterns: DataFrame | list[tuple[str, bool]], key: str, text: str = "text", *, block: int = BLOCK) -> DataFrame:
    """key, line (from 1) and pattern of each line that has one."""

    def found(matcher: Matcher, content: str) -> list[tuple]:
        return [(k, line + 1) for line, k in matcher.lines(content)]

    return _by_block(texts, patterns, found, {"line": "int"}, key, text, block).select(key, "line", "pattern")


def count_patterns(texts: DataFrame, patterns: DataFrame | list[tuple[str, bool]], key: str, text: str = "text", *, diffs: bool = False, block: int = BLOCK) -> DataFrame:
    """key, pattern and count of the occurrences in each text that has some; diffs: only in the
    added and removed lines of unified diffs, told by their hunks' headers."""

    def found(matcher: Matcher, content: str) -> list[tuple]:
        return sorted(matcher.counts("\n".join(changed_lines(content)) if diffs else content).items())

    return _by_block(texts, patterns, found, {"count": "bigint"}, key, text, block)


def occurrences(texts: DataFrame, pattern: str, key: str, text: str = "text", regex: bool = True) -> DataFrame:
    """How often one pattern stands in each text, none included."""
    asked = F.lit("(?i)" + pattern) if regex else F.lit("(?i)\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return texts.select(key, F.regexp_count(text, asked).cast("long").alias("count"))


def diff_occurrences(diffs: DataFrame, pattern: str, key: str, text: str = "text", regex: bool = True) -> DataFrame:
    """Occurrences in added and removed lines of each diff that has some."""
    return count_patterns(diffs, [(pattern, regex)], key, text, diffs=True).select(key, "count")


def scan_files(spark: SparkSession, paths: str | list[str], patterns: DataFrame | list[tuple[str, bool]], *, ignored: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """path, line and pattern over files of any store, each read once: ignored paths (a column
    path) go before any file is opened, and files with a NUL in their head before they're scanned.
    name: a pattern of file names. Bytes that aren't UTF-8 are replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", name) if name else reader).load(paths)
    files = files if ignored is None else without(files, ignored)
    kept = files.where(~is_binary("content")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return scan_lines(kept, patterns, "path")


def commits_per_pattern(hits: DataFrame, n: int = 8) -> DataFrame:
    """Distinct commits of each pattern, and the first n of them; no more than n are gathered."""
    each = hits.groupBy("pattern", "commit").count()
    counts = each.groupBy("pattern").agg(F.count("*").alias("commits"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("commit"))
    first = each.withColumn("_place", place).where(F.col("_place") <= n).groupBy("pattern").agg(F.array_sort(F.collect_list("commit")).alias("first"))
    return counts.join(first, "pattern")
