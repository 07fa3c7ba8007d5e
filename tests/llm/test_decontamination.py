import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[k : k + n]:
                        hit |= set(range(at, at + n))
                        found |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    chance = random.Random(3)
    vocabulary = ["Éa", "b", "C3", "d", "straße", "日本"]
    say = lambda n: " ".join(chance.choice(vocabulary) + chance.choice(["", ",", "!"]) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate((20, 13, 14, 5, 1, 30))] + [(7, ""), (8, None), (9, items_text := say(16)), (10, items_text), (None, say(15))]
    docs = [(k, say(chance.randrange(60)) + " | " + (chance.choice(items)[1] or "").upper() if k % 3 == 0 and k % 4 else say(chance.randrange(40)), "x") for k in range(1, 40) if k % 12]
    docs += [(100, None, "x"), (101, "", None), (None, items_text, "y"), docs[0], docs[0], (102, " ".join(say(30) for _ in range(150)) + items_text, "z")]
    return docs, [(i, t) for i, t in items if i != 4]


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_against_brute_force(spark, limit):
    docs, items = data()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, _key string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.contamination(frame, bench, broadcast_windows=limit).collect()), key=str)
    assert got == expected(docs, items)


@pytest.mark.parametrize(("most", "broadcast"), [(d.BROADCAST_BYTES, True), (100_000, False)])
def test_few_windows_of_very_long_words(spark, monkeypatch, most, broadcast):
    monkeypatch.setattr(d, "BROADCAST_BYTES", most)
    long = "é" * 200_000
    docs, items = [(1, f"a {long} b", "x"), (2, long[:-1], "x"), (3, "b c", "x"), (4, None, "x")], [(0, long), (1, "c")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, _key string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, d.contamination(frame, bench).collect()), key=str) == expected(docs, items)
    known = d._window_ids(d.windows_of(bench, "item_id", "text", d.WINDOW))
    plan = d.matches(frame, known, "doc_id", "text", d.BROADCAST_WINDOWS)._jdf.queryExecution().toString()
    assert ("strategy=broadcast" in plan) == broadcast


def test_removal(spark):
    docs, items = data()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, _key string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(r[0], r[1], r[2]): r[5] for r in expected(docs, items)}
    kept = d.without_contaminated(frame, bench).collect()
    assert len(kept) == sum(not e[5] for e in expected(docs, items)) and kept[0].asDict().keys() == {"doc_id", "text", "_key"} and want
    clean = d.without_spans(frame, bench)
    by_id = {r[0]: (r[1], r[2]) for r in expected(docs, items)}
    for r in clean.collect():
        n, hit = by_id[r.doc_id]
        assert len(words(r.text)) == n - hit


def test_nothing(spark):
    docs, items = data()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, _key string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.contamination(frame.limit(0), bench).count() == 0
    assert d.contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0


def test_lower_case_of_every_character(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import ascii_lower

    chars = [(c, chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame(chars, "c int, s string").withColumn("pair", F.concat(F.lit("Zx"), "s", F.lit("Q")))
    got = frame.select("c", "s", ascii_lower(F.col("s")).alias("one"), ascii_lower(F.col("pair")).alias("two"))
    assert got.where(~((F.col("one") == F.when(F.col("c").between(65, 90), F.char(F.col("c") + 32)).otherwise(F.col("s"))) & (F.col("two") == F.concat(F.lit("zx"), "one", F.lit("q"))))).count() == 0


@pytest.mark.parametrize("text", [None, "", " ", "A", " a", "a ", "--A1--b2--", "Éa b", "x" * 10000, "\x00a\x7fb", "a b", "日本 語"])
def test_words_of_a_text(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(d.tokens(F.col("t"))).first()
    assert row[0] == words(text)
