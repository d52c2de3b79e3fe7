"""Token counts and token shards against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberline.llm import token_counts as tc
from emberline.llm import token_shards as ts
from emberline.llm.common import Workspace

PARTS = [
    "a", "B", "é", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "'S", "'ll", "<|endoftext|>", "<|startoftext|>", "1", "23", "İ", "Σ", "ς", "́",
    " ", "　", "\x1c", "\x85", "​", "日本", "🙂", "|", "!!", "the", " the", " of", "ﬁ", " ", "Å", " ", "x.", "\x01", "\x00",
]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def ids_of(encoder, texts):
    values, index, at = encoder.values(pa.array(texts, pa.string()), list)
    return [sum((values[j] for j in index[a:b]), []) for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_tokens_of_whole_texts(name):
    rng = random.Random(3)
    path = public_tokenizers.path(name)
    model, encoder = Tokenizer.from_file(path), tc.Encoder(path)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 24))) for _ in range(4000)]
    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        assert ids_of(encoder, part) == [e.ids for e in model.encode_batch(part, add_special_tokens=False)]


def test_memory_is_bounded_and_does_not_show(monkeypatch):
    monkeypatch.setattr(tc, "MEMORY", 20)
    path = public_tokenizers.path(FILES[0])
    model, encoder = Tokenizer.from_file(path), tc.Encoder(path)
    rng = random.Random(1)
    for _ in range(60):
        texts = [" ".join(f"w{rng.randint(0, 300)}{rng.choice('.,x')}" for _ in range(30)) for _ in range(3)]
        assert ids_of(encoder, texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.young) <= 20 + 300


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 5, 50, 1, 0)])], ["text"])
    assert [b.num_rows for b in tc.batches_by_bytes(batch, 0, 10)] == [2, 1, 2]


ODD = [(1, None, 7), (2, "", 7), (None, "alpha beta", 7), (4, "same text.", 7), (4, "same text.", 7), (5, "word " * 60_000, 7), (6, "\n \n", 7)]


def test_counts_of_odd_rows(spark):
    path = public_tokenizers.path(FILES[1])
    model = Tokenizer.from_file(path)
    df = spark.createDataFrame(ODD, "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in tc.count_tokens(df, path).collect() if r.doc_id is not None)
    want = sorted((i, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in ODD if i is not None)
    assert got == want
    assert tc.count_tokens(df, path).filter("doc_id is null").count() == 1
    assert tc.count_tokens(df.limit(0), path).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, "one two  three"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(df, path).collect()}
    assert got == {1: len(model.encode("one two  three")), 2: 0}


@pytest.mark.parametrize("levels", [1, 7, 16, 20])
def test_wavelet_matrix(levels):
    rng = np.random.default_rng(levels)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 1 << levels, n)
        ids[::3] = 1
        shard = ts.Shard(ts.pack(ids, np.array([0, n]), [None], levels))
        assert shard.doc_ids == [None] and (shard.decode() == ids).all()
        assert (shard.access(np.arange(n)) == ids).all() if n else True
        for token in {1, *(int(x) for x in ids[:5]), (1 << levels) - 1, 1 << levels}:
            assert (shard.occurrences(token) == np.flatnonzero(ids == token)).all()
            assert shard.count(token, n // 3, n) == (ids[n // 3 :] == token).sum()
            part = np.flatnonzero(ids[: n // 2] == token)
            assert (shard.occurrences(token, 3, n // 2) == part[part >= 3]).all()


def test_shards_hold_every_document_in_order(spark):
    path = public_tokenizers.path(FILES[0])
    model = Tokenizer.from_file(path)
    df = spark.createDataFrame([*ODD, (0, "first", 7)], "doc_id long, text string, start int")
    got = sorted(ts.token_table(df, path, shard_ids=16).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 4, 4, 5, 6]
    at = 0
    texts = {r[0]: r[1] for r in [*ODD, (0, "first")]}
    for r in got:
        ids = [*model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert ts.token_table(df.limit(0), path).count() == 0


def test_a_shard_is_one_file_with_lookup(spark, sf_dir):
    path = public_tokenizers.path(FILES[0])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as id", "text")
    shards = ts.write_shards(docs, Workspace(spark, "t"), path, shard_ids=50_000)
    rows = shards.collect()
    assert len(rows) == len({r for (r,) in shards.selectExpr("input_file_name()").collect()}) > 1
    assert sum(r.n_docs for r in rows) == docs.count()
    shard = ts.Shard(rows[0].file)
    assert shard.count(2) == len(shard.occurrences(2)) >= shard.n_docs
    assert (shard.access(shard.starts[1:] - 1) == 2).all()
