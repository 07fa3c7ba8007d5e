"""Queries of text scanning with many patterns, of occurrences in diffs, and of word search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan, word_index
from tidemark.plans.catalogue import _t, query
from tidemark.storage import new_folder

_WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def _pattern_file(spark, folder) -> DataFrame:
    """Every longer word of the benchmark as a line of a pattern file: those of eight letters and
    more in capitals, shorter ones as regular expressions that want a mark after them."""
    words = _t(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("w")).distinct()
    return words.select(F.when(F.length("w") >= 8, F.upper("w")).otherwise(F.concat(F.lit("re:"), "w", F.lit("[,.]  # ends a phrase"))).alias("value"))


@query(f"""WITH {_WORDS}, {_LINES}
SELECT doc_id, line::INT AS line, upper(w) AS pattern FROM l JOIN words ON length(w) >= 8 AND contains(lower(s), w)
UNION ALL SELECT doc_id, line::INT, w || '[,.]' FROM l JOIN words ON length(w) < 8 AND (contains(lower(s), w || ',') OR contains(lower(s), w || '.'))""")
def q_scan_many_patterns(spark, folder):
    return scan.scan_lines(_t(spark, folder, "documents"), scan.parse_patterns(_pattern_file(spark, folder)), "doc_id")


@query(f"""WITH {_WORDS}, d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, upper(w) AS pattern, ((length(t) - length(replace(t, w, ''))) / length(w))::BIGINT AS count FROM d JOIN words ON length(w) >= 8 AND contains(t, w)
UNION ALL SELECT doc_id, w || '[,.]', ((length(t) - length(replace(replace(t, w || ',', ''), w || '.', ''))) / (length(w) + 1))::BIGINT FROM d JOIN words ON length(w) < 8 AND (contains(t, w || ',') OR contains(t, w || '.'))""")
def q_count_many_patterns(spark, folder):
    return scan.count_patterns(_t(spark, folder, "documents"), scan.parse_patterns(_pattern_file(spark, folder)), "doc_id")


def _diffs(spark, folder) -> DataFrame:
    """Each document as a diff of one file: its lines are added, removed (as comments, so a removed
    line begins with '--- ') and kept in turn; then a second file with one added line."""
    lines = F.split("text", "\n")
    signed = F.transform(lines, lambda x, k: F.when(k % 3 == 0, F.concat(F.lit("+"), x)).when(k % 3 == 1, F.concat(F.lit("--- "), x)).otherwise(F.concat(F.lit(" "), x)))
    old, new = F.size(F.filter(lines, lambda x, k: k % 3 != 0)), F.size(F.filter(lines, lambda x, k: k % 3 != 1))
    text = F.concat(
        F.lit("diff --git a/the.txt b/the.txt\n--- a/the.txt\n+++ b/the.txt\n@@ -1,"), old, F.lit(" +1,"), new, F.lit(" @@ the head\n"), F.array_join(signed, "\n"),
        F.lit("\n\\ No newline at end of the file\ndiff --git a/the b/the\n--- /dev/null\n+++ b/the\n@@ -0,0 +1 @@\n+THE END"),
    )
    return _t(spark, folder, "documents").select("doc_id", text.alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
changed AS (SELECT doc_id, CASE k % 3 WHEN 0 THEN '+' ELSE '--- ' END || lower(s) AS s FROM l WHERE k % 3 < 2 UNION ALL SELECT doc_id, '+the end' FROM documents),
counted AS (SELECT doc_id, unnest([{'pattern': 'the', 'n': (length(s) - length(replace(s, 'the', ''))) / 3}, {'pattern': '-- ', 'n': (length(s) - length(replace(s, '-- ', ''))) / 3}, {'pattern': 'An[a-z]', 'n': len(regexp_extract_all(s, 'an[a-z]'))}]) AS c FROM changed)
SELECT doc_id, c.pattern AS pattern, sum(c.n)::BIGINT AS count FROM counted GROUP BY ALL HAVING sum(c.n) > 0""")
def q_history_counts(spark, folder):
    return scan.count_patterns(_diffs(spark, folder), [("the", False), ("-- ", False), ("An[a-z]", True)], "doc_id", diffs=True)


# ---- words ----

_HELD = "held AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(source || ' ' || text), '[\\p{L}\\p{N}]+')) AS w FROM documents)"


def _index(spark, folder) -> DataFrame:
    path = new_folder(spark, "words")
    word_index.save(word_index.build(_t(spark, folder, "documents"), "doc_id", ["source", "text"]), path)
    return word_index.load(spark, path)


@query(f"WITH {_HELD} SELECT word, count(*) AS rows FROM (SELECT unnest(w) AS word FROM held) GROUP BY word")
def q_word_frequencies(spark, folder):
    return word_index.frequencies(_index(spark, folder))


@query(f"WITH {_HELD} SELECT doc_id AS key FROM held WHERE list_contains(w, 'the') AND list_contains(w, 'src3') AND len(list_filter(w, lambda x: starts_with(x, 'thing'))) > 0")
def q_word_search(spark, folder):
    return word_index.search(_index(spark, folder), "THE thing* src3")
