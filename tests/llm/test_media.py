import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from foldwright.llm import media

from .fixtures import EDGES, edge_table, empty_table


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 340 * 576, 340 * 576 + 1])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    made = media.thumbnails([media.encode(data)])[0]
    assert b"".join(x[2].tobytes() for x in made) == media.pad(data)
    assert len(media.pad(data)) % 576 == 0 and media.pad(data)[:n] == data and set(media.pad(data)[n:]) <= {255}


def test_runs_of_equal_and_extreme_bytes():
    for data in (b"\xff" * 576, b"\x00" * 576, b"\x00\xff" * 288, bytes(range(256)) * 9):
        assert b"".join(x[2].tobytes() for x in media.thumbnails([media.encode(data)])[0]) == media.pad(data)


class Bits:
    def __init__(self):
        self.bits = ""

    def code(self, table, symbol):
        self.bits += table[symbol]

    def value(self, v):
        s = abs(v).bit_length()
        if s:
            self.bits += format(v if v > 0 else v + (1 << s) - 1, f"0{s}b")
        return s

    def bytes(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def codes(counts, symbols):
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


@pytest.mark.parametrize("every", [0, 2])
def test_a_colour_image_with_ac_terms_and_subsampling(every):
    """A frame of our own making: three components, luminance 2x2, AC terms of all kinds, with and without restarts."""
    draw = random.Random(5)
    dc_counts, dc_symbols = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
    ac_symbols = [0x00, 0x01, 0x02, 0x03, 0x11, 0x12, 0x21, 0x31, 0xF0, 0x05]
    ac_counts = [0, 1, 2, 2, 2, 1, 1, 1] + [0] * 8
    dc, ac = codes(dc_counts, dc_symbols), codes(ac_counts, ac_symbols)
    width, height, across, down = 40, 24, 3, 2  # MCUs of 16 x 16
    want, scan, bits, before, k = np.zeros((down * 2, across * 2), int), b"", Bits(), [0, 0, 0], 0
    for my in range(down):
        for mx in range(across):
            if every and k and k % every == 0:
                scan += bits.bytes() + bytes([0xFF, 0xD0 + (k // every - 1) % 8])
                bits, before = Bits(), [0, 0, 0]
            for comp, spots in ((0, [(0, 0), (0, 1), (1, 0), (1, 1)]), (1, [(0, 0)]), (2, [(0, 0)])):
                for y, x in spots:
                    term = draw.randrange(-60, 60)
                    one = Bits()
                    size = one.value(term - before[comp])
                    bits.code(dc, size)
                    bits.bits += one.bits
                    before[comp] = term
                    if comp == 0:
                        want[my * 2 + y, mx * 2 + x] = term
                    at = 1
                    while at < 64:
                        symbol = draw.choice(ac_symbols)
                        at += (symbol >> 4) + 1
                        if symbol and at > 64:
                            symbol = 0
                        bits.code(ac, symbol)
                        if symbol == 0:
                            break
                        bits.bits += "".join(draw.choice("01") for _ in range(symbol & 15))
            k += 1
    scan += bits.bytes()
    seg = media._segment
    frame = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\x00" + bytes([16] * 64)) + seg(0xDB, b"\x11" + struct.pack(">64H", *[8] * 64))
    frame += seg(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    frame += seg(0xC4, b"\x00" + bytes(dc_counts) + bytes(dc_symbols) + b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    frame += (seg(0xDD, struct.pack(">H", every)) if every else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    w, h, image = media.thumbnails([frame])[0][0]
    assert (w, h) == (width, height)
    assert np.array_equal(image, np.clip((want * 16 + 4) // 8 + 128, 0, 255)[:3, :5])


def test_broken_images_are_errors():
    good = media.encode(b"abc")
    for bad in (b"", b"xx", good[2:], good[:40]):
        with pytest.raises(ValueError):
            media.parse(bad)
    with pytest.raises(ValueError):
        media.parse(good.replace(b"\xff\xc0", b"\xff\xc2"))


def test_query_columns_and_edges(spark):
    got = media.describe(media.store(edge_table(spark))).collect()
    want = sorted(((i, hashlib.sha256(media.pad((t or "").encode())).hexdigest()) for i, t, _ in EDGES), key=str)
    assert sorted(((r["doc_id"], hashlib.sha256(r["payload"]).hexdigest()) for r in got), key=str) == want
    assert all(r["media_bytes"] == len(media.encode((dict((i, t) for i, t, _ in EDGES)[r["doc_id"]] or "").encode())) for r in got)
    assert media.describe(media.store(empty_table(spark))).count() == 0


def test_query(spark, data):
    rows = media.op2_media_jpeg(spark, data).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.pad(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(media.encode(texts[r["doc_id"]])).hexdigest()


def test_what_cannot_be_read_has_an_error_and_spares_the_others(spark):
    good = media.encode(b"some bytes")
    broken = [None, b"", b"no image", good[:40], good[:-2], good[:2] + b"\xff\xc2" + good[4:], b"\xff\xd8\xff\xd9", good[: len(good) // 2] + b"\xff\xd9"]
    rows = [(i, 10, m, "x", "y") for i, m in enumerate([good, *broken, good])]
    got = media.describe(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary, payload string, error string")).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in (got[0], got[-1]):
        assert bytes(r["payload"]) == media.pad(b"some bytes") and r["error"] is None and r["media_sha256"] == hashlib.sha256(good).hexdigest()
    assert all(r["error"] and r["payload"] is None and r["thumbnail_hash"] is None for r in got[1:-1])


def test_average_hash_equals_brute_force():
    draw = np.random.default_rng(3)
    for shape in ((24, 24), (1, 24), (8, 9), (3, 3), (100, 24)):
        image = draw.integers(0, 256, shape).astype(np.uint8)
        areas = []
        for axis in shape:
            starts = [min(k * axis // 8, axis - 1) for k in range(8)]
            areas.append([range(a, max(b, a + 1)) for a, b in zip(starts, [*starts[1:], axis])])
        means = np.array([[np.mean([[int(image[y, x]) for x in xs] for y in ys]) for xs in areas[1]] for ys in areas[0]])
        want = "".join("1" if m > means.mean() else "0" for m in means.ravel())
        assert media.average_hash(image) == f"{int(want, 2):016x}"
