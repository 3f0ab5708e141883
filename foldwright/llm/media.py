"""Payloads in baseline JPEG frames: lossless storage as block means, and DC-only luminance thumbnails.

``encode`` stores bytes as the DC terms of 8x8 blocks: with a quantizer of 8 a block's mean is its byte exactly. A
frame has rows of 24 blocks, one restart interval each; longer payloads become several frames end to end.
``thumbnail`` reads any baseline JPEG (8 bits, Huffman coded, one scan): it parses the markers, decodes the scan's
codes for all restart intervals side by side and keeps the luminance DC terms.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, read

#: Payload bytes come in multiples of this: 24 rows of 24 blocks.
UNIT, ACROSS, PAD = 576, 24, 255
#: Units in one frame, so that its height stays below 65,536 pixels.
FRAME_UNITS = 340

# Huffman tables that we write. DC: category s has a code of 9 - s bits, so a difference takes 9 bits with its extra
# bits whatever its size. AC: only "end of block", one bit.
_DC_COUNTS, _DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
_AC_COUNTS, _AC_SYMBOLS = bytes([1] + [0] * 15), b"\x00"


def _difference_codes() -> np.ndarray:
    """For each difference + 255: its ten bits, prefix, extra bits and end of block."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (9 - s)) - 2) if s else 0b111111110
        out[d + 255] = (prefix << s | (d if d > 0 else d + (1 << s) - 1)) << 1
    return out


_CODES = _difference_codes()


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of UNIT."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame(payload: bytes) -> bytes:
    rows = len(payload) // ACROSS
    dc = np.frombuffer(payload, np.uint8).astype(np.int16).reshape(rows, ACROSS) - 128
    steps = dc.copy()
    steps[:, 1:] -= dc[:, :-1]
    four = _CODES[steps.astype(np.int64) + 255].reshape(rows, ACROSS // 4, 4)
    words = (four[..., 0] << np.uint64(54)) | (four[..., 1] << np.uint64(44)) | (four[..., 2] << np.uint64(34)) | (four[..., 3] << np.uint64(24))
    coded = words.astype(">u8").view(np.uint8).reshape(rows, ACROSS // 4, 8)[..., :5].reshape(rows, -1)
    lines = np.empty((rows, coded.shape[1] + 2), np.uint8)
    lines[:, :-2], lines[:, -2], lines[:, -1] = coded, 0xFF, 0xD0 + np.arange(rows) % 8
    lines[-1, -1] = 0xD9
    flat = lines.ravel()
    full = lines == 0xFF
    full[:, -2] = False
    at = np.flatnonzero(full.ravel())
    scan = np.insert(flat, at + 1, 0) if len(at) else flat
    head = (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ACROSS * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS)
        + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS)
        + _segment(0xDD, struct.pack(">H", ACROSS))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )
    return head + scan.tobytes()


def encode(data: bytes) -> bytes:
    """The padded bytes as one or more JPEG frames, end to end."""
    payload, step = pad(data), FRAME_UNITS * UNIT
    return b"".join(_frame(payload[i : i + step]) for i in range(0, len(payload), step))


@dataclass
class Frame:
    """What the markers of one JPEG say, and its scan as restart intervals."""

    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # (component id, h, v, quantizer)
    tables: dict = field(default_factory=dict)  # (class, id) -> counts + symbols
    quantizers: dict = field(default_factory=dict)
    picks: list = field(default_factory=list)  # of the scan: (component id, DC table, AC table)
    every: int = 0
    intervals: list = field(default_factory=list)


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The frame that begins at ``at`` and the position behind it. ValueError for what isn't baseline JPEG."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    frame, at = Frame(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                frame.quantizers[name] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                frame.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("only 8 bits")
            frame.height, frame.width = struct.unpack(">HH", body[1:5])
            frame.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            frame.every = body[0] << 8 | body[1]
        elif marker == 0xDA:
            frame.picks = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            break
        elif marker == 0xD9:
            raise ValueError("no scan")
    raw = np.frombuffer(data, np.uint8, offset=at)
    # Markers in the scan: 0xFF and neither stuffing nor fill.
    hits = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[hits + 1]
    ends = hits[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))]
    if not len(ends):
        raise ValueError("no end of image")
    end = int(ends[0])
    stops = [*hits[(after >= 0xD0) & (after <= 0xD7) & (hits < end)].tolist(), end]
    stuffed = hits[(after == 0) & (hits < end)] + 1
    kept = np.ones(end, bool)
    kept[stuffed] = False
    for s in stops[:-1]:
        kept[s : s + 2] = False
    shift = np.concatenate(([0], np.cumsum(kept)))
    clean = raw[:end][kept]
    frame.intervals = [(clean, int(shift[a]), int(shift[b])) for a, b in zip([0, *[s + 2 for s in stops[:-1]]], stops)]
    return frame, at + end + 2


def frames(data: bytes) -> list[Frame]:
    out, at = [], 0
    while at < len(data):
        frame, at = parse(data, at)
        out.append(frame)
    return out


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that a code may begin: its length << 8 | symbol; 0 where none begins."""
    out, code, at = np.zeros(1 << 16, np.uint64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _units(frame: Frame) -> list[tuple[int, int, int]]:
    """For each block of an MCU: component's place, DC table, AC table."""
    of = {part[0]: (k, part) for k, part in enumerate(frame.parts)}
    if len(frame.picks) == 1:
        name, dc, ac = frame.picks[0]
        return [(of[name][0], dc, ac)]
    return [(of[name][0], dc, ac) for name, dc, ac in frame.picks for _ in range(of[name][1][1] * of[name][1][2])]


def _scan(group: list[Frame]) -> list[np.ndarray]:
    """The quantized luminance DC terms of frames alike in tables and layout, in scan order."""
    first, units = group[0], _units(group[0])
    luts = {key: _lookup(t) for key, t in first.tables.items()}
    pieces, starts, counts, owner, total = [], [], [], [], 0
    for k, frame in enumerate(group):
        h, v = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
        if len(frame.picks) == 1:
            h = v = 1
        mcus = -(-frame.width // (8 * h)) * -(-frame.height // (8 * v))
        clean = frame.intervals[0][0]
        pieces.append(clean)
        for _, a, _ in frame.intervals:
            n = min(frame.every or mcus, mcus)
            starts.append(total + a)
            counts.append(n)
            owner.append(k)
            mcus -= n
        total += len(clean)
    data = np.concatenate([*pieces, np.full(16, 0xFF, np.uint8)])
    wide = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        wide = wide << np.uint64(8) | data[i : len(data) - 8 + i]
    last = len(wide) - 1
    pos, counts, owner = np.array(starts, np.int64) * 8, np.array(counts), np.array(owner)
    luma = sum(k == 0 for k, _, _ in units)
    offsets = np.concatenate(([0], np.cumsum(counts * luma)))
    out = np.zeros(int(offsets[-1]), np.int32)
    before = {k: np.zeros(len(pos), np.int64) for k in {u[0] for u in units}}
    order = np.argsort(-counts, kind="stable")  # so that those still running are a prefix
    pos, begin, running = pos[order], offsets[:-1][order], counts[order]
    one, sixty_three = np.uint64(1), np.uint64(63)

    def window(p):
        return wide[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)

    def extend(bits, size):
        """The signed value of ``size`` extra bits."""
        value = bits.astype(np.int64)
        half = np.left_shift(1, np.maximum(size.astype(np.int64) - 1, 0))
        return np.where((size > 0) & (value < half), value - 2 * half + 1, value)

    for step in range(int(running[0]) if len(running) else 0):
        live = int(np.searchsorted(-running, -step, side="left"))
        p, seen = pos[:live], 0
        for k, dc, ac in units:
            w = window(p)
            got = luts[0, dc][w >> np.uint64(48)]
            size, length = got & np.uint64(255), got >> np.uint64(8)
            w = w << length
            value = extend((w >> one) >> (sixty_three - size), size)
            before[k][:live] += value
            if k == 0:
                out[begin[:live] + step * luma + seen] = before[k][:live]
                seen += 1
            p = p + (length + size).astype(np.int64)
            w = w << size
            got = luts[1, ac][w >> np.uint64(48)]
            p = p + (got >> np.uint64(8)).astype(np.int64)
            p = _skip(p, got & np.uint64(255), luts[1, ac], window)
        pos[:live] = p
    return [out[offsets[i] : offsets[j]] for i, j in _runs(owner)]


def _skip(p, symbol, lut, window):
    """Positions behind the block's AC terms, of which the first symbol is read already."""
    busy = np.flatnonzero(symbol)
    if not len(busy):
        return p
    index = np.ones(len(busy), np.int64)
    symbol = symbol[busy]
    while len(busy):
        run, size = (symbol >> np.uint64(4)).astype(np.int64), (symbol & np.uint64(15)).astype(np.int64)
        p[busy] += size
        index = index + run + 1
        more = index < 64
        busy, index = busy[more], index[more]
        got = lut[window(p[busy]) >> np.uint64(48)]
        p[busy] += (got >> np.uint64(8)).astype(np.int64)
        symbol = got & np.uint64(255)
        more = symbol != 0
        busy, index, symbol = busy[more], index[more], symbol[more]
    return p


def _runs(owner: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(owner)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(owner)])) if len(owner) else []


def _image(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """DC terms in scan order as rows of block means."""
    part = frame.parts[0]
    h, v = (1, 1) if len(frame.picks) == 1 else part[1:3]
    most = (1, 1) if len(frame.picks) == 1 else (max(p[1] for p in frame.parts), max(p[2] for p in frame.parts))
    across, down = -(-frame.width // (8 * most[0])), -(-frame.height // (8 * most[1]))
    image = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    q = frame.quantizers[part[3]]
    means = np.floor_divide(image * q + 4, 8) + 128
    rows = -(-frame.height * v // (8 * most[1]))
    return np.clip(means, 0, 255).astype(np.uint8)[:rows, : -(-frame.width * h // (8 * most[0]))]


def thumbnails(images: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each byte string, for each of its frames: width, height and the luminance thumbnail, one pixel a block."""
    parsed = [frames(x) for x in images]
    alike: dict = {}
    for i, some in enumerate(parsed):
        for j, frame in enumerate(some):
            key = (tuple(sorted(frame.tables.items())), tuple(p[:3] for p in frame.parts), tuple(frame.picks))
            alike.setdefault(key, []).append((i, j, frame))
    out: list = [[None] * len(x) for x in parsed]
    for group in alike.values():
        for (i, j, frame), dc in zip(group, _scan([g[2] for g in group])):
            out[i][j] = (frame.width, frame.height, _image(frame, dc))
    return out


def average_hash(image: np.ndarray) -> str:
    """64 bits: which of 8x8 areas are brighter than the mean; areas of nearly equal size."""
    rows, cols = (np.arange(8) * n // 8 for n in image.shape)
    rows, cols = np.minimum(rows, image.shape[0] - 1), np.minimum(cols, image.shape[1] - 1)
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, 0), cols, 1)
    size = np.outer(np.diff([*rows, image.shape[0]]).clip(1), np.diff([*cols, image.shape[1]]).clip(1))
    means = sums / size
    return np.packbits(means > means.mean()).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, media)``: each whole text as UTF-8 in JPEG frames. Null and empty texts: one padded unit.

    Rows with a null id are kept; repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, texts in chunks(batches, text_col):
            data = [x.encode() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(x) for x in data], pa.int64()), pa.array(map(encode, data), pa.binary())],
                names=[id_col, "n_bytes", "media"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


#: What the parser and the decoder raise on bytes that aren't a baseline JPEG of one scan.
_BROKEN = (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, MemoryError, struct.error)


def _read(media: list[bytes | None]) -> list[tuple]:
    """For each image what ``describe`` returns of it: nulls and an error where it can't be read."""

    def one(data, made):
        pixels = np.concatenate([x[2] for x in made])
        size = made[0][0], sum(x[1] for x in made)
        return (len(data), hashlib.sha256(data).hexdigest(), *size, average_hash(pixels), pixels.tobytes(), None)

    if all(media):
        try:
            return [one(data, made) for data, made in zip(media, thumbnails(media))]
        except _BROKEN:
            pass  # one by one, to tell which it is
    out = []
    for data in media:
        try:
            out.append(one(data, thumbnails([data])[0]) if data else (None if data is None else 0, *[None] * 5, "no media"))
        except _BROKEN as e:
            out.append((len(data), hashlib.sha256(data).hexdigest(), *[None] * 4, f"{type(e).__name__}: {e}"))
    return out


def describe(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored frames back: ``(id_col, n_bytes, media_bytes, media_sha256, width, height, thumbnail_hash,
    payload, error)``, the payload being the thumbnails' pixels; height adds up over frames.

    Null and empty media, and what is no baseline JPEG of one scan, have an ``error`` and nulls for what can't be told;
    other rows of their task aren't touched. Repeated rows give repeated results, rows with a null id are kept, an empty
    table gives none; other columns are ignored.
    """
    kind = stored.schema[id_col].dataType.simpleString()
    ddl = (
        f"`{id_col}` {kind}, n_bytes bigint, media_bytes bigint, media_sha256 string, width bigint, height bigint, "
        "thumbnail_hash string, payload binary, error string"
    )

    def slices(batch):
        sizes = [len(x or b"") for x in batch.column("media").to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            held += n
            if held >= 4 << 20 or i + 1 == len(sizes):
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            for part in slices(batch):
                rows = _read(part.column("media").to_pylist())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), part.column("n_bytes"), *columns],
                    names=[id_col, "n_bytes", "media_bytes", "media_sha256", "width", "height", "thumbnail_hash", "payload", "error"],
                )

    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, ddl)


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = describe(store(read(spark, sf_dir, "documents")))
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"),
    )
