import random
import re
import time

import pytest

from tidemark.functions import matching as m
from tidemark.operators import scan


@pytest.mark.parametrize("pattern,parts", [("AKIA[A-Z]{4}", {"akia"}), ("(?:ab|CDE)x", {"ab", "cde"}), ("[0-9]+", None), ("a?", None), ("(key)+=", {"key"}), ("x|[0-9]", None), ("pass(?:word)?=", {"pass"}), ("[a-z]+@ex\\.com", {"@ex.com"}), ("µ", None)])
def test_fixed_parts(pattern, parts):
    assert m.fixed_parts(pattern) == parts


def test_lines_and_counts_against_one_pattern_at_a_time():
    chance = random.Random(3)
    patterns = [("ab", False), ("ABA", False), ("aa", False), ("K1", False), ("a[0-9]b", True), ("(?:x|yz)+", True), ("^b", True), ("[0-9]{3}", True), ("ſ?ab$", True), ("(a)(?!b)", True)]
    matcher = m.Matcher(patterns)
    compiled = [re.compile(p if regex else re.escape(p), re.IGNORECASE) for p, regex in patterns]
    for _ in range(3000):
        text = "".join(chance.choices("aAbBxyzKkſ10 \n", k=chance.randrange(0, 30)))
        lines = text.split("\n")
        assert matcher.lines(text) == sorted((n, k) for n, line in enumerate(lines) for k, c in enumerate(compiled) if c.search(line))
        assert matcher.counts(text) == {k: len(found) for k, c in enumerate(compiled) if (found := c.findall(text))}


def test_time_is_level_in_the_number_of_patterns():
    text = "\n".join(f"line {k} of some text with word{k % 97}" for k in range(4000))

    def seconds(n):
        matcher = m.Matcher([(f"pattern{k:06d}", False) for k in range(n)] + [("WORD13", False), ("word1[0-9]x?", True)])
        began = time.perf_counter()
        assert len(matcher.lines(text)) > 40
        return time.perf_counter() - began

    few, many = min(seconds(5) for _ in range(3)), min(seconds(20_000) for _ in range(3))
    assert many < 4 * few + 0.05


def test_changed_lines():
    diff = "\n".join(["commit 1", "--- a/f", "+++ b/f", "@@ -1,3 +1,2 @@ head", "--- x", " same", "-y", "+++ z", "\\ No newline", "+outside", "@@ -0,0 +1 @@", "+in", "-- ", "2.1"])
    assert list(m.changed_lines(diff)) == ["--- x", "-y", "+++ z", "+in"]
    assert list(m.changed_lines("-a\n+++ b/f\n b\n+c")) == ["-a", "+c"]
    assert list(m.changed_lines("")) == []


def test_scans_in_blocks_and_of_odd_tables(spark):
    texts = spark.createDataFrame([(1, "a Secret\nx SECRETS\n"), (2, None), (None, "secret"), (4, "")], "id long, text string")
    listed = spark.createDataFrame([("secret", False), ("SECRET", False), ("x s", False), ("", False), (None, True), ("s[a-z]+s$", True)], "pattern string, is_regex boolean")
    want = [(None, 1, "SECRET"), (1, 1, "SECRET"), (1, 2, "SECRET"), (1, 2, "s[a-z]+s$"), (1, 2, "x s")]
    for block in (1, 2, 100):
        assert sorted(map(tuple, scan.scan_lines(texts, listed, "id", block=block).collect()), key=repr) == sorted(want, key=repr)
    assert scan.scan_lines(texts, listed.limit(0), "id").count() == 0 and scan.scan_lines(texts.limit(0), listed, "id").count() == 0
    assert sorted(map(tuple, scan.count_patterns(texts, [("e", False)], "id").collect()), key=repr) == [(1, "e", 4), (None, "e", 2)]
    assert [r[1] for r in scan.occurrences(texts, "S\\E", "id", regex=False).collect()] == [0, None, 0, 0]


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.txt": b"x\nkey=1", "sub/b.txt": b"KEY=2\xff", "c.bin": b"key=\x00", "late.txt": b"z" * 9000 + b"\x00\nkey=", "skip.txt": b"key="}.items():
        (tmp_path / name).write_bytes(body)
    ignored = spark.createDataFrame([(f"file:{tmp_path}/skip.txt",)], "path string")
    found = scan.scan_files(spark, str(tmp_path), [("key=", False)], ignored=ignored)
    assert sorted((r.path.rsplit("/", 1)[1], r.line) for r in found.collect()) == [("a.txt", 2), ("b.txt", 1), ("late.txt", 2)]
    assert [r.line for r in scan.scan_files(spark, str(tmp_path), [("key=", False)], name="a.*").collect()] == [2]
