import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_files, topk_search
from tidemark.llm.queries import tokenizer_path

ODD = ["", "a \nb", "a\n\nb  ", "x\n", "  a", "a  b\t\nc", "it's 'sand I'll", "ẞβaγ", "1a2b3", "é b", "a.\n\nB. \n C", ". \n", "a ¼ ² ª", "a\r\n\r\nb", "日本語 text", "<|endoftext|> a", "!!\n A", " \n\n", "a\x1cb", "“quoted” – dash…", " \ta", "€5 £6", "ab ,cd  ,ef"]


def test_pieces_encode_like_the_whole():
    encoder, library = token_files.Encoder(tokenizer_path(), kept=50), Tokenizer.from_file(tokenizer_path())
    for text in ODD + [a + b for a in ODD for b in ODD]:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encoder.encode("x <|endoftext|> y"), encoder.dtype)


def test_blanks_of_any_form():
    """Blanks ending in a line break, before a space and a letter, among all other forms."""
    encoder, library, chance = token_files.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(5)
    texts = ["x\n\n y", "First part.\n\n Second part", "\n\n y", "a \n b", "a\n \nb", "1\t\t x", ".\n\n "]
    texts += ["".join(chance.choices(["\n", " ", "\t", "\r\n", "y", "Zé", ".", "1", "\n\n ", "!?"], k=chance.randrange(1, 14))) for _ in range(40_000)]
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == whole.ids, repr(text)


def test_a_repeated_piece_is_looked_up_once():
    class Counted(dict):
        gets = 0

        def get(self, *key):
            self.gets += 1
            return super().get(*key)

    encoder, library = token_files.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    encoder.memo, text = Counted(), "One word, one word.\n" * 1000
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < encoder.memo.gets < 20


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_blocks_of_texts(size, monkeypatch):
    """Texts that can be cut and texts that can't side by side, in blocks of any size."""
    monkeypatch.setattr("tidemark.llm.common.PIECE", size)
    encoder, library, chance = token_files.Encoder(tokenizer_path(), kept=50), Tokenizer.from_file(tokenizer_path()), random.Random(7)
    odd = [*ODD, "\0", "a\0b", "a 😀 b", "😀", " ", "\n", "ÿ×÷ø ɏ", "x " * 90, "q" * 90, "\u4141\u3c3c"]
    texts = [chance.choice(odd) + chance.choice(["", *odd]) for _ in range(2000)] + ["", ""]
    expected = [[*whole.ids, token_files.END] for whole in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode_all(texts)] == expected
    assert list(encoder.encode_all([])) == []


def test_shards_roll_at_a_size(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"word{k} " * 30 + ("<|endoftext|>" if k % 5 == 0 else "")) for k in range(80)], "doc_id long, text string")
    folders = [str(tmp_path / name) for name in ("one", "many")]
    whole = token_files.write_shards(frame, tokenizer_path(), folders[0], length=16, rows=2)
    rolled = token_files.write_shards(frame, tokenizer_path(), folders[1], length=16, rows=2, roll=200)
    assert rolled.count() > 2 * whole.count() and rolled.agg({"n_tokens": "max"}).first()[0] < 600
    assert sorted(map(tuple, token_files.read_documents(rolled, folders[1]).collect())) == sorted(map(tuple, token_files.read_documents(whole, folders[0]).collect()))


def test_files_round_trip(spark, tmp_path):
    chance = random.Random(1)
    docs = [(k * 3 % 50, " ".join(chance.choice(["alpha", "Βeta", "x"]) for _ in range(chance.randrange(40)))) for k in range(60)] + [(None, "last"), (3, None), (200, "word " * 9000)]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, start int")
    folder = str(tmp_path / "shards")
    shards = token_files.write_shards(frame, tokenizer_path(), folder, length=64, rows=4)
    got = token_files.read_documents(shards, folder).collect()
    library, at = Tokenizer.from_file(tokenizer_path()), 0
    assert len(got) == len(docs)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is None for r in by_start] == [False] * (len(docs) - 1) + [True]
    assert [r.doc_id for r in by_start[:-1]] == sorted(i for i, _ in docs if i is not None)
    texts = {}
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        texts.setdefault(i, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in by_start:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens
    shard = token_files.Shard(shards.orderBy("place").first().name)
    ids, mask = shard.sequence(len(shard) - 1)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and mask[0]
    assert sum(int(shard.sequence(k)[1].sum()) for k in range(len(shard))) == shards.orderBy("place").first().n_tokens


def test_no_documents(spark):
    assert token_files.encode_and_read(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def vectors():
    chance = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in chance.normal(size=4).astype(np.float32)], "s") for k in range(0, 120)]
    rows += [(50, None, ""), (100, [1.0, None, 0.0, 0.0], ""), (150, [math.nan] * 4, ""), (200, [math.inf, 0.0, 0.0, 0.0], ""), (None, [1.0] * 4, ""), (250, [1.0, 2.0], ""), (251, [0.5, 0.5], ""), (50, rows[3][1], "again"), (300, [], "")]
    return rows + [(k, [0.25] * 4, "tie") for k in range(400, 410)]


def expected(rows, k=5, every=50):
    fine = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v, *_) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in fine:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, j, v in fine if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_top_k_against_brute_force(spark, scale, monkeypatch):
    rows = [(i, v and [x and x * (scale if math.isfinite(x) else 1) for x in v], s) for i, v, s in vectors()]
    if scale > 1:  # sums beyond 2**53 are taken in whole numbers
        rows = [(i, v and [x / 2**22 if x is not None and math.isfinite(x) else x for x in v], s) for i, v, s in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    assert sorted(map(tuple, topk_search.top_k(frame).collect())) == expected(rows)


@pytest.mark.parametrize("groups", [1, 3])
def test_many_tiles_and_groups(spark, groups):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    assert sorted(map(tuple, topk_search.top_k(frame, query_tile=2, shard_tile=7, query_groups=groups).collect())) == expected(rows)


def test_components_beyond_a_long(spark):
    rows = [(0, [1e307, 0.0]), (1, [-1e307, 0.0]), (2, [1e307, 0.0]), (3, [0.5, 0.0])]
    got = [tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(0, 1, 2, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 1, -(2**63))]


def test_search_of_nothing(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
