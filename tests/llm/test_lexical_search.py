import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical_search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    out = []
    for item, text in items:
        scored = []
        for i, t in split:
            score = 0
            for term in terms(text):
                df, tf = sum(term in own for _, own in split), t.count(term)
                if tf:
                    m = 100 - 25 + 25 * len(t) * n_docs // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -x) for r, (x, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def tables():
    chance = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "naïve", "x1", "日本", "tea", "Éclair", "of", "the"]
    docs = [(k, "".join(chance.choice(words) + chance.choice([" ", "-", "\n", "_", "@", " . "]) for _ in range(chance.randrange(0, 60)))) for k in range(150)]
    docs += [(None, "beta beta tea"), (3, docs[3][1]), (500, "beta tea"), (501, "beta tea"), (-4, "beta tea"), (77, None), (78, "!!! ..."), (502, "the " * 4000 + "rare")]
    items = [("a", "tea beta"), ("b", "TEA tea, naïve; unknown"), (None, "the of gamma"), ("a", "tea beta"), ("none", "unknown words"), ("empty", ""), ("null", None), ("long", "x1 日本 rare " * 30)]
    return docs, items


def frames(spark):
    docs, items = tables()
    return (
        spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, rank int, _id string").repartition(5),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id string, text string, score int").repartition(3),
    )


@pytest.mark.parametrize("options", [{}, {"window": 4}, {"block_terms": 5, "window": 64}, {"k": 3, "window": 1}])
def test_search_against_brute_force(spark, options):
    docs, items = tables()
    got = s.search(*frames(spark), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, options.get("k", 20))


def test_windows_keep_all_rows_in_order():
    import pyarrow as pa

    parts = [pa.record_batch([pa.array(range(a, b))], names=["x"]) for a, b in ((0, 3), (3, 3), (3, 11), (11, 12))]
    cut = list(s._windows(iter(parts), 5))
    assert [b.num_rows for b in cut] == [5, 5, 2] and [x for b in cut for x in b.column(0).to_pylist()] == list(range(12))


def test_many_equal_scores_in_one_window():
    items = s.Items([0], [np.array([0])], [np.array([7])], 1000, 1000, 1)
    scorer = s.Scorer(items, k=3, window=256)
    for start in (0, 200):
        n = np.ones(200, np.int64)
        scorer.add(list(range(start, start + 200)), n, np.zeros(200, np.int64), n, np.arange(200))
    assert sorted(i for _, _, i in scorer.rows()) == [0, 1, 2] and not scorer.scores.any() and not scorer.touched.any()


def test_lengths_beyond_a_long():
    big = s.parts_of_score(np.array([1, 2]), np.array([10**9, 5]), 10**12, 10**15)
    assert big.tolist() == [10**9 // (1000 + 12 * (75 + 25 * 10**9 * 10**12 // 10**15)), 2 * 10**9 // (2000 + 12 * 75)]


def test_search_of_nothing(spark):
    docs, items = frames(spark)
    assert s.search(docs.limit(0), items).count() == 0 and s.search(docs, items.limit(0)).count() == 0
    assert s.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
