import random
from collections import Counter

import numpy as np

from tidemark.llm import jaccard_join as j


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def corpus(seed=7):
    chance, rows = random.Random(seed), []
    say = lambda n: [f"w{chance.randrange(4000)}" for _ in range(n)]
    common = say(40)
    for k in range(160):
        kind = k % 4
        if kind == 0:
            rows.append(say(chance.randrange(1, 200)))
        elif kind == 1:
            rows.append(common + say(chance.randrange(40, 90)))
        else:
            copy = list(chance.choice(rows))
            for _ in range(chance.randrange(0, 4)):
                copy[chance.randrange(len(copy))] = f"w{chance.randrange(4000)}"
            rows.append(copy + say(chance.randrange(0, 6)))
    docs = [(1000 - k, " ".join(r), "x") for k, r in enumerate(rows)]
    return docs + [(5, None, "x"), (6, " \n", ""), (7, "A b", ""), (8, "a  B", ""), (None, docs[3][1], ""), docs[4], (9, "", "")]


def groups(docs):
    sets, parent = [shingles(t) for _, t, _ in docs], list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _, _) in enumerate(docs):
        if i is not None:
            lowest[find(k)] = min(i, lowest.get(find(k), i))
    return sets, [find(k) for k in range(len(docs))], lowest


def test_against_brute_force(spark):
    docs = corpus()
    sets, root, lowest = groups(docs)
    want = sorted((str(i), len(sets[k]), lowest[root[k]] if sets[k] else i) for k, (i, _, _) in enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string, _set string").repartition(3)
    assert sorted((str(r[0]), r[1], r[2]) for r in j.near_duplicates(frame).collect()) == want
    kept = j.one_of_each(frame).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "_set"}
    assert Counter(r.doc_id for r in kept) == Counter([*{lowest[root[k]] for k in range(len(docs)) if sets[k]}, *[i for k, (i, _, _) in enumerate(docs) if not sets[k]]])


def test_no_rows(spark):
    assert j.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_list_pairs_keep_all_that_can_link():
    chance = np.random.default_rng(1)
    for _ in range(20):
        n = int(chance.integers(1, 700))
        size = np.sort(chance.integers(5, 60, n)).astype(np.int32)
        at, component = (chance.integers(0, 6, n) % size).astype(np.int32), chance.integers(0, 4, n)
        sketches = np.zeros((n, j.SKETCH), np.uint64)
        p, q = j.list_pairs(size, at, component, sketches, 85)
        room = (size - at).astype(int)
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if component[a] != component[b] and 185 * min(room[a], room[b]) >= 85 * (int(size[a]) + int(size[b]))}
        assert {(min(a, b), max(a, b)) for a, b in zip(p.tolist(), q.tolist(), strict=True)} == want


def test_sketch_never_exceeds_the_distance():
    chance = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(chance.integers(0, 300, int(chance.integers(1, 200)))) for _ in range(2))
        apart = int(np.bitwise_count((j.sketch(a) ^ j.sketch(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_many_lists_at_once_keep_all_that_can_link():
    chance = np.random.default_rng(4)
    lengths = [*chance.integers(1, 9, 40), 63, 64, 65, 150, 1, 2]
    key = np.repeat(np.arange(len(lengths)), lengths)
    size = chance.integers(5, 60, len(key)).astype(np.int32)
    at, component = (chance.integers(0, 6, len(key)) % size).astype(np.int32), chance.integers(0, 4, len(key))
    found = [np.stack(x) for x in j.pairs_in_lists(key, size, at, component, np.zeros((len(key), j.SKETCH), np.uint64), 85)]
    got = [tuple(sorted(x)) for x in np.concatenate(found, 1)[:2].T.tolist()]
    room = (size - at).astype(int)
    want = {(a, b) for a in range(len(key)) for b in range(a + 1, len(key)) if key[a] == key[b] and component[a] != component[b] and 185 * min(room[a], room[b]) >= 85 * (int(size[a]) + int(size[b]))}
    assert len(got) == len(set(got)) and set(got) == want


def joined_by(pairs, labels):
    parent = list(range(len(labels)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b, *_ in pairs:
        parent[find(labels[a])] = find(labels[b])
    out = {}
    for k, label in enumerate(labels):
        out.setdefault(find(label), set()).add(k)
    return out.values()


def test_long_lists_are_spread_in_tiles(spark):
    chance = np.random.default_rng(3)
    labels = [0 if k < 30 else k for k in range(60)]  # one large component, and strays
    size, at = chance.integers(20, 24, 60).tolist(), chance.integers(0, 3, 60).tolist()
    keys = [[key for key in (5, 6) if key == 5 or k < 4 or k > 55] for k in range(60)]
    named = spark.createDataFrame([(k, size[k], labels[k], *[0] * j.SKETCH, keys[k], [at[k]] * len(keys[k])) for k in range(60)], "_node long, _n int, _label long, " + ", ".join(f"{b} long" for b in j.BITS) + ", _keys array<long>, _ats array<int>")
    scratch = j.Scratch(spark)
    got = [tuple(r) for r in j._pairs_across(named, 85, scratch, tile=8).drop("_key").distinct().collect()]
    room = [s - a for s, a in zip(size, at, strict=True)]
    want = {(a, b, 0) for a in range(60) for b in range(a + 1, 60) if labels[a] != labels[b] and 185 * min(room[a], room[b]) >= 85 * (size[a] + size[b])}
    assert len(got) == len(set(got)) and set(got) == want
    for some in (j._pairs_across(named, 85, scratch, tile=8, forest=True), j._pairs_across(named, 85, scratch, tile=256, forest=True)):
        trees = some.where("_key = 5").select("_a", "_b").collect()
        assert {tuple(t) for t in trees} <= {w[:2] for w in want}
        ends = {frozenset(c) for c in joined_by(want, labels)}
        assert {frozenset(c) for c in joined_by(trees, labels)} == ends
    assert len(trees) <= 31  # one less than components
    rows = j._entries(named, "_label").where("_key = 5")
    parts = j._tile_pairs(rows, 85, 8, scratch).groupBy("_p", "_q", "_side").count().collect()
    assert max(r["count"] for r in parts) <= 8 and len({(r._p, r._q) for r in parts}) > 10
    scratch.drop()


def test_components_in_one_task_and_over_many(spark):
    chance = random.Random(5)
    links = [(chance.randrange(400), chance.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    frame, scratch = spark.createDataFrame(links, "_a long, _b long"), j.Scratch(spark)
    for most in (1000, 10):
        assert {tuple(r) for r in j.components(frame, scratch, most).collect()} == {(x, find(x)) for x in parent}
    scratch.drop()


def test_tables_hold_exact_counts(spark):
    keys = [k % 50 for k in range(300)] + [7] * 100 + [1000]
    frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    tables = j.tables_of(frame, lambda b, _: (b.column(0).to_numpy(), None), 2)
    asked = np.array([*range(50), 1000, 2000])
    assert tables.owned(asked).tolist() == [True] * 50 + [False] * 2
    assert tables.level(asked)[:8].tolist() == [0] * 7 + [6]


def test_a_large_group_of_near_copies_against_brute_force(spark):
    chance = random.Random(11)
    say = lambda n: [f"w{chance.randrange(3000)}" for _ in range(n)]
    base, passage, rows = say(120), say(50), []
    for k in range(420):
        if k % 3:
            copy = list(base) if k % 2 else list(rows[-1] if rows and len(rows[-1]) > 90 else base)
            for _ in range(chance.randrange(0, 6)):  # near 0.85 from both sides
                copy[chance.randrange(len(copy))] = f"v{chance.randrange(10**6)}"
            rows.append(copy)
        else:
            rows.append(passage + say(chance.randrange(5, 25)))
    docs = [(k, " ".join(r), "x") for k, r in enumerate(rows)] + [(1000 + k, " ".join(base), "x") for k in range(100)]
    sets, root, lowest = groups(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    got = {r[0]: (r[1], r[2]) for r in j.near_duplicates(frame).collect()}
    assert got == {i: (len(sets[k]), lowest[root[k]]) for k, (i, _, _) in enumerate(docs)}
    assert 1 < len({c for _, c in got.values()}) < 300


def test_bounds_from_a_leader_never_contradict_the_sets(spark):
    chance = np.random.default_rng(6)
    base = chance.choice(10**6, 100, replace=False)
    sets = []
    for k in range(30):
        own = base.copy()
        swap = chance.choice(100, int(chance.integers(0, 14)), replace=False)
        own[swap] = chance.integers(10**7, 10**8, len(swap))
        sets.append(set(own.tolist()))
    apart = lambda a, b: len(sets[a] ^ sets[b])
    links = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    answers = [(k, 0, apart(k, 0), links(k, 0)) for k in range(1, 30)]
    pairs = [(a, b) for a in range(1, 30) for b in range(1, 30) if a != b]
    found = j._derived(
        spark.createDataFrame(pairs, "_a long, _b long"), spark.createDataFrame(answers, "_a long, _b long, _d long, _linked boolean"),
        spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "_node long, _n int"), 85,
    ).collect()
    assert found and {r._known for r in found} == {True, False} or {r._known for r in found} == {True}
    assert all(r._known == links(r._a, r._b) for r in found)


def test_clashing_columns_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{k % 9973}" for k in range(300_000))
    rows = [(3, long, 1), (2, long + " more", 2), (2, long + " more", 3), (9, "a b c d e", 4), (9, "a b c d e", 5), (8, None, 6), (None, "a b c d e", 7)]
    columns = ["_gone long", "_text string", "_set int"]
    frame = spark.createDataFrame(rows, ", ".join(columns))
    for more in ("_doc", "_own", "_hash", "_node", "_id", "_label", "_gone_set"):
        frame = frame.withColumn(more, frame["_set"])
    got = j.one_of_each(frame, id_col="_gone", text_col="_text").collect()
    assert sorted((str(r._gone), len(r._text or "")) for r in got) == [("2", len(long) + 5), ("8", 0), ("9", 9)]
    assert sorted(r.component_id or -1 for r in j.near_duplicates(frame.withColumnRenamed("_gone", "doc_id").withColumnRenamed("_text", "text")).withColumnRenamed("doc_id", "x").collect()) == [2, 2, 2, 8, 9, 9, 9]


def test_empty_tables_of_groups(spark):
    assert j.one_of_each(spark.createDataFrame([], "doc_id long, text string, _gone int")).count() == 0


def chains(seed, groups=30, length=8):
    """Texts of distinct words in chains: each differs from the one before by a few words, so ends
    don't link with one another, nor all with one leader."""
    chance, out = random.Random(seed), []
    for g in range(groups):
        own = [f"g{g}w{k}" for k in range(60)]
        for step in range(length):
            out.append((len(out), " ".join(own)))
            own = own[:]
            for k in range(chance.randrange(1, 6)):
                own[chance.randrange(60)] = f"g{g}s{step}n{k}"
    return out


def test_derived_answers_decide(spark, monkeypatch):
    docs, asked = chains(3), []
    real = j._verified

    def counted(pairs, *rest):
        asked.append((pairs.count(), rest[5].count() if len(rest) > 5 and rest[5] is not None else None))
        return real(pairs, *rest)

    monkeypatch.setattr(j, "_verified", counted)
    got = {r.doc_id: r.component_id for r in j.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shingle=1).collect()}
    sets = [set(t.split()) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = {min(group): group for group in joined_by(links, list(range(len(docs))))}
    assert got == {k: low for low, group in want.items() for k in group}
    # after the leaders' round, changes from a leader decide the pairs, not whole sets
    by_change, whole = sum(c or 0 for _, c in asked[1:]), sum(p for p, _ in asked[1:])
    assert by_change > 10 and by_change > whole, asked


def test_changes_give_exact_overlaps(spark):
    docs = chains(5, groups=6)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    scratch = j.Scratch(spark)
    nodes = {r.doc_id: r.node for r in frame.selectExpr("doc_id", "xxhash64(text) AS node").collect()}
    pairs = [(a, b) for a in range(len(docs)) for b in range(len(docs)) if a != b and a // 8 == b // 8]
    frame_of = lambda rows: spark.createDataFrame([(nodes[a], nodes[b]) for a, b in rows], "_a long, _b long")
    first = j._verified(frame_of([(a, b) for a, b in pairs if b % 8 == 2]), frame, "text", 1, 85, scratch)
    sizes = spark.createDataFrame([(nodes[k], len(set(t.split()))) for k, t in docs], "_node long, _n int")
    changes = scratch.keep(j._changes(frame_of([p for p in pairs if p[0] < p[1]]), first, sizes))
    found = {(r._a, r._b): (r._both, r._d, r._linked) for r in j._verified(frame_of([]), frame, "text", 1, 85, scratch, changes).collect()}
    sets, back = {nodes[k]: set(t.split()) for k, t in docs}, {v: k for k, v in nodes.items()}
    assert len(found) > 60 and all(back[a] // 8 == back[b] // 8 for a, b in found)
    for (a, b), answer in found.items():
        both = len(sets[a] & sets[b])
        assert answer == (both, len(sets[a] ^ sets[b]), 100 * both >= 85 * len(sets[a] | sets[b]))


def test_rows_with_texts_or_sets_go_in_small_batches(spark, monkeypatch):
    """Every table whose tasks take texts or whole sets is written with few rows an Arrow batch,
    and the session's own limit is back afterwards."""
    from tidemark.llm import common

    key, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, common.Scratch.keep

    def noted(self, frame, label="part"):
        label = "answers" if "_plus" in frame.columns and "_linked" in frame.columns else label
        seen.setdefault(label, set()).add(int(spark.conf.get(key)))
        return keep(self, frame, label)

    monkeypatch.setattr(common.Scratch, "keep", noted)
    before = spark.conf.get(key)
    j.near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string, _set string")).collect()
    assert all(seen[label] == {common.HEAVY_ROWS} for label in ("rows", "classes", "sets", "answers"))
    assert spark.conf.get(key) == before

    def count(batches):
        import pyarrow as pa

        yield from (pa.RecordBatch.from_pydict({"id": [len(b)]}) for b in batches)

    sizes = spark.range(0, 5000, 1, 1).mapInArrow(count, "id long")
    with common.heavy_rows(spark, 700):
        with common.heavy_rows(spark):  # a lower limit stays
            assert max(r.id for r in sizes.select("*").collect()) == 700
    assert spark.conf.get(key) == before
