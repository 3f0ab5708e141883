import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from foldwright.llm import tokens

from .fixtures import EDGES, edge_table, empty_table, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def _records(docs, **sizes):
    rows = tokens.FileRows(3, "int64", **sizes)
    out = [r for key, ids in docs for r in rows.add(key, np.array(ids, "<u4").tobytes())]
    return out + list(rows.close())


def _files(records, frames=tokens.FRAMES):
    """Records as Spark's writer puts them into files."""
    return [b"".join(r + tokens.GAP for r in records[i : i + frames + 1]) for i in range(0, len(records), frames + 1)]


def test_encoding_by_pieces(reference):
    draw = random.Random(3)
    odd = ["a", "ß", "漢", " ", "  ", "\n", "\t", "\r\n", " ", "　", "᠎", "\x1c", "\x85", "'s", "don't", "12", ".", "!?", "<|endoftext|>", "😀", "Ġ", "é́", "x" * 70]
    texts = ["".join(draw.choices(odd, k=draw.randrange(30))) for _ in range(3000)]
    texts += [" ".join(draw.choices(odd, k=draw.randrange(30))) for _ in range(3000)] + [prose(1, 500), "long" * 5000]
    assert all(tokens._cut(t) == tokens.CUT.split(t) for t in texts)
    encoder = tokens.Encoder(PATH)
    for i in range(0, len(texts), 500):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[i : i + 500])] == [reference(t) for t in texts[i : i + 500]]
    assert encoder.encode([]) == [] and max(map(len, encoder.known)) <= tokens.LONGEST


def test_what_a_worker_remembers_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    encoder = tokens.Encoder(PATH)
    for i in range(20):
        assert np.frombuffer(encoder.encode([prose(i, 40)])[0], "<u4").tolist() == reference(prose(i, 40))
        assert len(encoder.known) <= 50 + 40


def test_files_are_zstandard_and_seekable():
    draw = random.Random(5)
    docs = [(i, [draw.randrange(50000) for _ in range(draw.choice([0, 1, 5, 24, 25, 26, 400]))]) for i in range(120)]
    files = _files(_records(docs, frame=100, frames=4), 4)
    assert len(files) > 5
    read, before = [], 0
    for data in files:
        # Any reader of the format can decompress the whole: skippable frames are skipped.
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        file = tokens.File(data, "f")
        assert (file.part, file.before) == (3, before) and 1 <= file.frames <= 4
        got = [(file.index.column("id")[int(r)].as_py(), np.frombuffer(x, "<u4").tolist()) for rows, ids in file.documents() for r, x in zip(rows, ids)]
        assert np.frombuffer(plain, "<u4").tolist() == [x for _, ids in got for x in ids]
        before += sum(len(ids) for _, ids in got)
        read += got
    assert read == docs


def test_only_wanted_frames_are_decompressed(monkeypatch):
    docs = [(i, [i] * 5) for i in range(40)]
    file = tokens.File(_files(_records(docs, frame=40))[0])
    seen, whole = [], tokens.File.frame
    monkeypatch.setattr(tokens.File, "frame", lambda self, k, skip=0: (seen.append(k), whole(self, k, skip))[1])
    got = [(int(r), np.frombuffer(x, "<u4").tolist()) for rows, ids in file.documents({7, 6, 31}) for r, x in zip(rows, ids)]
    assert got == [(6, [6] * 5), (7, [7] * 5), (31, [31] * 5)] and seen == [3, 15]


def test_damage_is_found():
    docs = [(i, list(range(i, i + 300))) for i in range(50)]
    data, found = _files(_records(docs))[0], 0
    for at in [*range(0, len(data) - 8, 97), len(data) - 9, len(data) - 12]:
        bad = bytearray(data)
        bad[at] ^= 0x41
        try:  # a byte between frames means nothing
            same = [bytes(x) for _, ids in tokens.File(bytes(bad), "f").documents() for x in ids]
        except (ValueError, OSError):
            found += 1
        else:
            assert same == [np.array(ids, "<u4").tobytes() for _, ids in docs]
    assert found > 0.9 * len(data) / 97
    for bad in (data[:-1], data[:100], b"", data[20:]):
        with pytest.raises(ValueError):
            tokens.File(bad, "f")


def _by_hand(rows, reference):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for key, text in rows:
        ids = [*reference(text), 2]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_edges(spark, tmp_path, reference):
    at = str(tmp_path / "t")
    tokens.write_tokens(edge_table(spark), at, PATH, end=2)
    got = sorted(map(tuple, tokens.digests(spark, at).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([i for i, _, _ in EDGES], key=lambda i: (i is not None, i or 0))
    assert got == _by_hand([(i, t) for i, t, _ in EDGES], reference)
    assert sorted((str(r["id"]), r["ids"]) for r in tokens.read_tokens(spark, at).collect()) == sorted((str(i), [*reference(t), 2]) for i, t, _ in EDGES)
    for name, docs in (("e", empty_table(spark)), ("n", empty_table(spark).select("doc_id", "text"))):
        tokens.write_tokens(docs, str(tmp_path / name), PATH, end=2)
        assert tokens.digests(spark, str(tmp_path / name)).count() == 0


def test_many_files_and_lookups(spark, tmp_path, reference):
    draw = random.Random(11)
    rows = [(draw.randrange(10**6), prose(i, draw.randrange(400, 9000))) for i in range(150)]
    rows += [(rows[0][0], "another text of the same id"), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    at = str(tmp_path / "t")
    tokens.write_tokens(docs, at, PATH, end=2, frame=20_000, frames=2)
    places = tokens.index(spark, at)
    assert places.select("path").distinct().count() > 4
    got = sorted(map(tuple, tokens.digests(spark, at).collect()), key=lambda r: r[1])
    assert sorted((r[0], *r[2:]) for r in got) == sorted((r[0], *r[2:]) for r in _by_hand(rows, reference))
    assert [r[0] for r in got] == sorted(i for i, _ in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    wanted = [rows[0][0], rows[1][0], rows[40][0], -1]
    found = tokens.read_tokens(spark, at, spark.createDataFrame([(i,) for i in [*wanted, wanted[0]]], "id bigint")).collect()
    assert sorted((r["id"], r["ids"]) for r in found) == sorted((i, [*reference(t), 2]) for i, t in rows if i in wanted)


def test_ids_of_text(spark, tmp_path, reference):
    tokens.write_tokens(spark.createDataFrame([("b", "x y"), (None, "z"), ("a", "w")], "name string, body string"), str(tmp_path / "t"), PATH, id_col="name", text_col="body")
    rows = tokens.digests(spark, str(tmp_path / "t"), "string").orderBy("start").collect()
    assert [(r["id"], r["n_tokens"]) for r in rows] == [(None, len(reference("z"))), ("a", len(reference("w"))), ("b", len(reference("x y")))]


def test_query(spark, data, reference):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = tokens.op12_token_files(spark, data)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == _by_hand(rows, reference)
