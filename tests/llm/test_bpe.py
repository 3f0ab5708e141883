import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foldwright.llm import bpe

from .fixtures import EDGES, edge_table, empty_table, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_positions_and_packs_round_trip():
    x = np.concatenate([np.arange(300), [191, 192, 193, 65535, 65536, 2**21 - 1, 2**21, 2**31]]).astype(np.int64)
    assert np.array_equal(bpe._unpack_positions(bpe._pack_positions(x), len(x)), x)
    assert len(bpe._unpack_positions(bpe._pack_positions(x[:0]), 0)) == 0
    words = [b"", b"a", "ß漢".encode(), b"x" * 1000]
    assert bpe._unpack(bpe._pack(words)) == words


def test_merging(reference):
    ranks = reference._mergeable_ranks
    draw = random.Random(7)
    words = ["a" * 3000, "ab" * 999, "\n" * 200, "漢字かな" * 50, "🇩🇪" * 9, "x", " the", "Donaudampfschifffahrt"]
    words += ["".join(draw.choices("aehilnost ß漢é0", k=draw.randrange(1, 40))) for _ in range(2000)]
    for word in words:
        assert bpe.merge(word.encode(), ranks) == reference._encode_single_piece(word), word
    start = time.time()
    assert len(bpe.merge(b"abc" * 100_000, ranks)) > 1000 and time.time() - start < 10


@pytest.mark.parametrize("bucket", [64 << 20, 200])
def test_buckets_follow_the_input(spark, reference, monkeypatch, bucket):
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    monkeypatch.setattr(bpe, "BUCKET", bucket)
    texts = [prose(i, 60, 90) for i in range(40)]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PATH, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_ids_and_bytes(spark, reference, monkeypatch):
    texts = [t for _, t, _ in EDGES] + ["don't we'll  two  spaces\n\n\ttabs 12345 ½ Ⅷ x²", "a" * 3000, "<|endoftext|> é́ 𝔘𝔫𝔦", " ", "\n \n  x"]
    monkeypatch.setattr(bpe, "BLOCK", 2000)  # several blocks
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == reference.encode_ordinary(text or ""), i
        assert bytes(got[i]["decoded"]) == (text or "").encode()


def test_edges(spark):
    got = bpe.encode(edge_table(spark), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in got) == sorted((str(i), (t or "").encode()) for i, t, _ in EDGES)
    assert bpe.encode(empty_table(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_decoding_joins_the_table(spark, reference):
    table = bpe.token_table(spark, PATH)
    assert table.count() == 50256
    rows = [(1, [0, 255, 300]), (2, []), (3, reference.encode_ordinary("naïve 漢字"))]
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode_ids(spark.createDataFrame(rows, "k int, ids array<int>"), "k", table).collect()}
    assert got == {k: reference.decode_bytes(ids) for k, ids in rows}
    with pytest.raises(Exception, match="no such token"):
        bpe.decode_ids(spark.createDataFrame([(1, [50256])], "k int, ids array<int>"), "k", table).collect()


def test_query(spark, data, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = bpe.op4_byte_level_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
