"""Stages and queries over the small tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = start = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name in ("quality", "near_duplicates", "decontamination"):
            assert docs.columns == start.columns and 0 < docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0
        elif name == "mixing":
            assert docs.columns == start.columns and docs.join(before, "doc_id", "left_anti").count() == 0
        else:
            assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() == before.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SMALL, t)}.parquet'")
    found = con.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in found.fetchall())


def staged(spark, docs, folder, tmp_path):
    """What each stage returns, written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, tmp_path):
    import zlib
    from collections import Counter

    import numpy as np
    import test_decontamination
    from tokenizers import Tokenizer

    from tidemark.llm import mixing, quality
    from tidemark.llm.queries import tokenizer_path

    start, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    good, single, clean, mixed, files = staged(spark, start, SMALL, tmp_path)
    scores = {r.doc_id: r.predicted for r in quality.score_quality(start, labels).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in scores.items() if p)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in sets if find(i) == i or not sets[i])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    fate = test_decontamination.expected([(r.doc_id, r.text) for r in single.collect()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(f[0] for f in fate if not f[5])

    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_sources(clean).collect()}
    copies = {i: n // size + (2 * (n % size) >= size and n % size > 0) for i, (n, size) in taken.items() if size}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    library, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, files.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)


def test_odd_rows_and_no_rows(spark, tmp_path):
    text = "Some sentence that is long enough, with words and a point. " * 8
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, text, "en", None, 5, "x"), (3, None, None, "b", None, None), (4, "", "en", "b", 0, ""), (None, text + " other end", "en", "a", 5, ""), (5, "long " * 60_000 + text, "en", "c", 5, "y"), (6, "x", "de", "c", 1, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _set string")
    for more in ("_doc", "_own", "_hash", "_node", "_key", "_gone", "_source", "_words", "_copy"):
        frame = frame.withColumn(more, frame["_set"])
    out = staged(spark, frame, SMALL, tmp_path / "odd")
    assert all(o.columns == frame.columns for o in out[:4])
    assert out[4].count() == out[3].count() and out[3].exceptAll(out[2].crossJoin(spark.range(3)).select(*frame.columns)).count() == 0
    single = out[1].select("doc_id", "text").collect()
    assert len(single) == len(set(single))
    assert [o.count() for o in staged(spark, frame.limit(0), SMALL, tmp_path / "none")] == [0] * 5


def test_run_gives_what_the_stages_give(spark, tmp_path):
    want = staged(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL, tmp_path)[-1]
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_cluster_without_a_shared_folder_fails_early():
    from types import SimpleNamespace

    from tidemark.llm import common

    lost = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(lost)
