import random
from collections import defaultdict

import numpy as np

from tidemark.llm import mixing
from tidemark.llm.common import words_of

SCHEMA = "doc_id long, text string, source string, size string"


def test_words_of_splits_like_bytes():
    chance = random.Random(4)
    texts = ["".join(chance.choice("aB \n\té\x0bx") for _ in range(chance.randrange(30))).encode() for _ in range(200)] + [b"", b" ", b"A a"]
    w = words_of(texts)
    for k, t in enumerate(texts):
        assert [w.text(j) for j in range(w.first[k], w.first[k + 1])] == t.lower().split()
    by_word = defaultdict(set)
    for k in range(len(w.hash)):
        by_word[w.text(k)].add(int(w.hash[k]))
    assert all(len(h) == 1 for h in by_word.values()) and len(by_word) == len(np.unique(w.hash))


def corpus(seed=1, n=120):
    chance = random.Random(seed)
    rows = [(k, " ".join("w" for _ in range(chance.randrange(0, 60))), chance.choice(["a", "a", "a", "b", "c", None]), "clash") for k in range(n)]
    return rows + rows[:5] + [(None, "one two", "b", None), (900, None, "c", None), (901, " ".join(["x"] * 5000), "a", "")]


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(frame).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    want, taken = targets(sizes), defaultdict(int)
    source_of = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(frame.repartition(7)).collect()))


def test_mixed_documents_hold_the_words_taken(spark):
    frame = spark.createDataFrame(corpus(2), SCHEMA)
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix_sources(frame).collect())


def test_whole_documents_come_near_the_words_taken(spark):
    rows = corpus(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    texts, largest, taken, got = {(i, t, s) for i, t, s, _ in rows}, defaultdict(int), defaultdict(int), defaultdict(int)
    source_of = {}
    for i, t, s, _ in rows:
        largest[s] = max(largest[s], len((t or "").split()))
        source_of.setdefault((i, len((t or "").split())), s)
    for r in mixing.mix_sources(frame).collect():
        taken[source_of[r.doc_id, r.size]] += r.taken
    for r in mixing.mixed_documents(frame, in_part=False).collect():
        assert (r.doc_id, r.text, r.source) in texts
        got[r.source] += len((r.text or "").split())
    assert all(2 * abs(got[s] - taken[s]) <= largest[s] * sum(1 for x in rows if x[2] == s) ** 0.5 + largest[s] for s in taken)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (2, " ", "a", None)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sources(blank).collect()] == [(0, 0, 0.0)] * 2
