"""Comparison form of texts, their character n-grams, MinHash signatures and LSH bands.

What Spark has no function for runs in Arrow batches: Unicode NFKC and case folding, n-gram hashes, minima.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W_]+")
#: Characters of text that one step inside a task holds at a time.
STEP = 2 << 20
#: 64-bit numbers that are worked on at a time, so that they stay near the processor.
BLOCK = 1 << 15
#: Letters and digits of ASCII texts, all else spaces.
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + b" " * 128
#: Buckets in which n-grams are counted, 16 MB; tasks sum CHUNK of them at a time.
BUCKETS, CHUNK = 1 << 24, 1 << 16
#: Buckets of n-grams that have a sign in each of some directions.
SIGNS, DIRECTIONS = 1 << 20, 2


def normalized(text: str) -> str:
    """NFKC, case-folded, words (letters and digits) joined by single spaces."""
    if not isinstance(text, str):
        raise TypeError(f"a text must be a string, not {type(text).__name__}")
    if text.isascii():
        return " ".join(text.lower().encode().translate(_ASCII).decode().split())
    return " ".join(_WORDS.findall(unicodedata.normalize("NFKC", text).casefold()))


def normalize_native(text: Column) -> Column:
    """The same with built-in functions, for texts that NFKC leaves alone and whose only special fold is the sharp s."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of the public splitmix64 generator), in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _hashes(text: str, width: int) -> np.ndarray:
    """The hash of the ``width`` characters from each place of ``text`` that has as many behind it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(max(len(codes) - width + 1, 0), width, np.uint64)
    for start in range(0, len(out), BLOCK):
        h = out[start : start + BLOCK]
        for i in range(start, start + width):
            h += codes[i : i + len(h)]
            h += np.uint64(0x9E3779B97F4A7C15)
            _mixed(h)
    return out


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingles(text: str, ngram: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the overlapping ``ngram``-character pieces of a normalized text.

    A shorter text is one piece, an empty text has none.
    """
    if ngram < 1:
        raise ValueError("ngram must be at least 1")
    return _distinct(_hashes(text, min(ngram, len(text)))) if text else np.zeros(0, np.uint64)


def shingle_lists(texts: list[str], ngram: int = 5) -> list[np.ndarray]:
    """``shingles`` of each text, hashed together: pieces that reach over the end of a text are left out."""
    if ngram < 1:
        raise ValueError("ngram must be at least 1")
    h, out, at = _hashes("".join(texts), ngram), [], 0
    for text in texts:
        out.append(_distinct(h[at : at + len(text) - ngram + 1]) if len(text) >= ngram else shingles(text, ngram))
        at += len(text)
    return out


def shared_of(left: np.ndarray, right: np.ndarray) -> int:
    """How many hashes two sorted sets of distinct ones share."""
    few, many = sorted((left, right), key=len)
    if not len(few):
        return 0
    at = np.searchsorted(many, few)
    return int((many[np.minimum(at, len(many) - 1)] == few).sum())


def jaccard_of(left: np.ndarray, right: np.ndarray) -> float:
    """Shared over all of two sorted sets of distinct hashes; two empty sets are alike."""
    if not len(left) and not len(right):
        return 1.0
    shared = shared_of(left, right)
    return shared / (len(left) + len(right) - shared)


def jaccard(left: Column, right: Column) -> Column:
    """The same of two array columns of distinct values."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def check_threshold(threshold: float) -> float:
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
        raise TypeError("the threshold must be a number")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    return float(threshold)


def lsh_bands(threshold: float, num_perm: int = 128, min_recall: float = 0.98) -> tuple[int, int]:
    """``(bands, rows)`` with as many rows in a band as keep the chance that a pair at the threshold meets in some band
    at ``min_recall``; one row a band where none does."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    meets = ((num_perm // rows, rows) for rows in range(num_perm, 0, -1))
    return next(((b, r) for b, r in meets if 1 - (1 - threshold**r) ** b >= min_recall), (num_perm, 1))


@dataclass(frozen=True)
class MinHasher:
    """``num_perm`` multiply-add hashes of 64-bit values, of which the upper halves are compared."""

    num_perm: int = 128
    seed: int = 0

    def __post_init__(self):
        if self.num_perm < 1:
            raise ValueError("num_perm must be at least 1")

    def family(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed).integers(0, 1 << 63, (2, self.num_perm), dtype=np.uint64)
        return draw[0] | np.uint64(1), draw[1]

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima for each set; an empty set has all ones."""
        a, b = self.family()
        out = np.full((len(sets), self.num_perm), 0xFFFFFFFF, np.uint32)
        start, held = 0, 0
        for i, found in enumerate(sets):
            if held and held + len(found) > BLOCK:
                self._minima(sets, start, i, a, b, out)
                start, held = i, 0
            held += len(found)
        self._minima(sets, start, len(sets), a, b, out)
        return out

    def _minima(self, sets: list[np.ndarray], start: int, end: int, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
        full = [i for i in range(start, end) if len(sets[i])]
        if not full:
            return
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        h, least = np.empty_like(flat), np.empty((self.num_perm, len(full)), np.uint64)
        for k in range(self.num_perm):
            np.multiply(flat, a[k], out=h)
            h += b[k]
            np.minimum.reduceat(h, starts, out=least[k])
        out[full] = (least >> np.uint64(32)).T


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each signature and band, the band's number mixed in."""
    out = np.empty((len(signatures), bands), np.int64)
    for band in range(bands):
        h = np.full(len(signatures), band + 1, np.uint64)
        for value in signatures[:, band * rows : (band + 1) * rows].T:
            h = _mixed(h + value + np.uint64(0x9E3779B97F4A7C15))
        out[:, band] = h.view(np.int64)
    return out


def tally(h: np.ndarray) -> bytes:
    """How many n-gram hashes fall into each of some buckets, up to 15, in half a byte each. There are 16 to 65,536 buckets,
    a power of two above a quarter of the hashes as far as that goes."""
    buckets = 1 << min(max((len(h) // 4).bit_length(), 4), 16)
    n = np.minimum(np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 15).astype(np.uint8)
    return (n[: buckets // 2] | n[buckets // 2 :] << 4).tobytes()


def tallied(packed: bytes) -> np.ndarray:
    half = np.frombuffer(packed, np.uint8)
    return np.concatenate([half & 15, half >> 4])


def most_shared(left: np.ndarray, n_left: int, right: np.ndarray, n_right: int) -> int:
    """No fewer than two sets of so many hashes share, by what they ``tallied``: in each bucket no more than the lesser count,
    and beyond 15 no more than the lesser of what is left of each set."""
    few, many = sorted((left, right), key=len)
    few, many = few.astype(np.int64), many.reshape(-1, len(few)).sum(0, dtype=np.int64)
    over = min(n_left - int(left.sum(dtype=np.int64)), n_right - int(right.sum(dtype=np.int64)))
    return int(np.minimum(few, many).sum()) + over


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about STEP characters, and their normalized texts. A null is an error that names the column."""
    for batch in batches:
        keys, start, held = [], 0, 0
        for i, text in enumerate(batch.column(column).to_pylist()):
            if text is None:
                raise TypeError(f"column {column} holds a null; texts must be strings")
            keys.append(normalized(text))
            held += len(text)
            if held >= STEP:
                yield batch.slice(start, i + 1 - start), keys
                keys, start, held = [], i + 1, 0
        if keys:
            yield batch.slice(start), keys


def normalize_text(df: DataFrame, text_col: str = "text", out: str = "normalized") -> DataFrame:
    """``df`` with the comparison form of ``text_col`` as ``out``. Nulls raise."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(normalized)

    return df.withColumn(out, run(F.col(text_col)))


def _digest(key: str) -> bytes:
    return hashlib.md5(key.encode("utf-8", "surrogatepass")).digest()


def shingle_sets(df: DataFrame, id_col: str, text_col: str = "text", ngram: int = 5, *, digest: bool = False) -> DataFrame:
    """``(id_col, shingles)``: each row's distinct n-gram hashes of its normalized text; with ``digest`` also ``key``, the
    digest of that text."""
    if ngram < 1:
        raise ValueError("ngram must be at least 1")
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "shingles", "key"][: 3 if digest else 2]

    def run(batches):
        for part, keys in _parts(batches, text_col):
            sets = [s.view(np.int64) for s in shingle_lists(keys, ngram)]
            columns = [part.column(id_col), pa.array(sets, pa.list_(pa.int64()))]
            if digest:
                columns.append(pa.array([_digest(k) for k in keys], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, shingles array<bigint>" + (", key binary" if digest else ""))


def _counted(batches, text_col: str, ngram: int) -> Iterator[pa.RecordBatch]:
    """``(chunk, counts)``: how often n-grams fall into each bucket, by chunk of BUCKETS, packed as steps and sums."""
    sums = np.zeros(BUCKETS, np.uint32)
    for _, keys in _parts(batches, text_col):
        for h in shingle_lists(keys, ngram):
            np.add.at(sums, (h & np.uint64(BUCKETS - 1)).view(np.int64), np.uint32(1))
    for chunk in range(0, BUCKETS, CHUNK):
        at = np.flatnonzero(sums[chunk : chunk + CHUNK])
        if len(at):
            packed = np.concatenate([np.diff(at, prepend=0), sums[chunk + at]]).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk // CHUNK], pa.int32()), pa.array([zlib.compress(packed, 1)], pa.binary())], names=["chunk", "counts"])


def ngram_counts(df: DataFrame, text_col: str = "text", ngram: int = 5) -> bytes:
    """How many texts of ``df`` have n-grams in each of BUCKETS buckets of their hashes, 255 for all from there on: BUCKETS
    bytes, whatever the texts. A bucket with 1 has one n-gram of one text."""

    def summed(batches):
        now, sums = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(sums, 255).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "sums"])
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, sums = chunk, np.zeros(CHUNK, np.int64)
                at, n = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
                sums[np.cumsum(at)] += n
        if now is not None:
            yield done()

    packed = df.select(text_col).mapInArrow(lambda batches: _counted(batches, text_col, ngram), "chunk int, counts binary")
    out = bytearray(BUCKETS)
    for r in packed.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk int, sums binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["sums"]
    return bytes(out)


def prefixes(df: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, counts, alone: int = 1) -> DataFrame:
    """``(id_col, key, size, prefix)``: a digest of each normalized text, how many n-grams it has, and its rarest ones, as
    many as it may lack of a similar text's and one more, as ``(h, at)`` by their place; those that no other text has, with
    counts up to ``alone``, are left out. ``counts`` is a broadcast result of ``ngram_counts`` over all texts that are
    compared, or, with ``alone`` 0, over those of one of two sides."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        known = np.frombuffer(counts.value, np.uint8)
        for part, keys in _parts(batches, text_col):
            sizes, rows = [], []
            for h in shingle_lists(keys, ngram):
                n = known[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
                take = len(h) - int(np.ceil(len(h) * threshold - 1e-9)) + 1 if len(h) else 0
                order = np.lexsort((h, n))[:take]
                at = np.flatnonzero(n[order] > alone)
                sizes.append(len(h))
                rows.append([{"h": x, "at": i} for x, i in zip(h[order[at]].view(np.int64).tolist(), at.tolist())])
            columns = [part.column(id_col), pa.array([_digest(k) for k in keys], pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())])))], names=[id_col, "key", "size", "prefix"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key binary, size bigint, prefix array<struct<h: bigint, at: int>>")


def parity(h: np.ndarray) -> bytes:
    """A bit for each of some buckets, a power of two from 64 on and no fewer than the hashes: whether an odd number of them
    falls into it. In so many buckets at least two sets differ, halves put on each other included, as their sketches do in bits."""
    bits = 1 << max((len(h) - 1).bit_length(), 6)
    n = np.bincount(((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches_: np.ndarray, words: int) -> np.ndarray:
    """Rows of ``parity`` bits as 64-bit words, put on each other until they are so many."""
    while sketches_.shape[1] > words:
        half = sketches_.shape[1] // 2
        sketches_ = sketches_[:, :half] ^ sketches_[:, half:]
    return sketches_


def class_width(threshold: float) -> float:
    """Sets alike enough in size for the threshold are at most two classes apart, a class being a step of the logarithm of
    sizes by so much."""
    return max(-math.log(threshold), 0.05) / 2 * (1 + 1e-6)


def directions(sets: list[np.ndarray], rounds: int = 12) -> np.ndarray:
    """A sign, or 0, of each of SIGNS buckets of n-grams in each of DIRECTIONS in which ``sets`` differ most, as texts of several
    languages do: by power iteration. The sums of two sets' signs are no further apart than the sets differ in n-grams."""
    out, sets = np.zeros((DIRECTIONS, SIGNS), np.int8), [h for h in sets if len(h)]
    if len(sets) < 3:
        return out
    sizes = np.array([len(h) for h in sets])
    flat, starts, root = (np.concatenate(sets) & np.uint64(SIGNS - 1)).view(np.int64), np.cumsum(sizes) - sizes, np.sqrt(sizes)
    known, draw = [root / np.sqrt(sizes.sum())], np.random.default_rng(0)

    def freed(u):
        for v in known:
            u = u - v * (u @ v)
        return u / max(np.sqrt(u @ u), 1e-300)

    for direction in range(DIRECTIONS):
        u = freed(draw.standard_normal(len(sets)))
        for _ in range(rounds):
            u = freed(np.add.reduceat(np.bincount(flat, np.repeat(u / root, sizes), SIGNS)[flat], starts) / root)
        known.append(u)
        out[direction] = np.sign(np.bincount(flat, np.repeat(u / root, sizes), SIGNS))
    return out


def size_class(size: int, width: float) -> int:
    return math.floor(math.log(size) / width)


@cache
def wave(period: int) -> float:
    """The most that ``1 - cos(2 pi d / period)`` may be taken times, to be no more than ``d`` for any whole number ``d``."""
    d = np.arange(1, 4 * period + 1)
    return float(1 / np.max((1 - np.cos(2 * np.pi * d / period)) / d))


@cache
def wave_shape(threshold: float, apart: float = 1.6) -> tuple[int, float]:
    """``(period, share)``: counts are kept modulo ``period``, in ``share`` buckets for each n-gram of a set. Of all periods up
    to 16 the one whose ``waves`` tell sets of one size that differ in ``apart`` times so many n-grams from similar ones, in
    the fewest numbers; ``(2, 0)`` if none does."""
    need, best = 1.2 * 2 * (1 - threshold) / (1 + threshold), (2, 0.0)
    for period in range(16, 1, -1):
        angle, cost = 1 - math.cos(2 * math.pi / period), 1 if period == 2 else 2
        share = next((x / 100 for x in range(4, 201) if wave(period) * x / 100 * (1 - math.exp(-100 * apart / x * angle)) >= need), None)
        if share and (not best[1] or share * cost < best[1] * (1 if best[0] == 2 else 2)):
            best = period, share
    return best


def class_shapes(sets: list[np.ndarray], sizes: list[int], threshold: float) -> list[tuple[int, int]]:
    """``(period, buckets)`` for each class of sizes, the last for all above, by how far unlike sets of such a size are apart.

    ``sets`` are the least hashes of some sets of such ``sizes``, which tell how many all would share. What they say changes
    how many pairs ``waves`` leave over, and no result.
    """
    width, order = class_width(threshold), np.argsort(sizes).tolist()
    classes, apart = [], []
    for at, i in enumerate(order):
        for j in order[at + 1 : at + 5]:
            if not len(sets[i]) or not len(sets[j]):
                continue
            end = min(x[-1] if len(x) < sizes[k] else np.uint64(2**64 - 1) for x, k in ((sets[i], i), (sets[j], j)))
            a, b = (x[: np.searchsorted(x, end, "right")] for x in (sets[i], sets[j]))
            differ = 2 - 4 * shared_of(a, b) / max(len(a) + len(b), 1)
            if differ > 2.4 * (1 - threshold) / (1 + threshold):
                classes.append(size_class(sizes[j], width))
                apart.append(differ)
    classes, apart, out, last = np.array(classes), np.array(apart), [], 1.6
    for of in range(int(classes.max(initial=0)) + 3):
        near = apart[np.abs(classes - of) <= 2] if len(apart) else apart
        last = float(np.quantile(near, 0.1)) if len(near) >= 8 else last
        period, share = wave_shape(threshold, max(math.floor(10 * last), 1) / 10)
        out.append((period, int(share * math.exp(of * width)) + 24))
    return out


def shape_of(shapes: list[tuple[int, int]], of_class: int) -> tuple[int, int]:
    return shapes[min(max(of_class, 0), len(shapes) - 1)]


def counted(h: np.ndarray, period: int, buckets: int) -> bytes:
    """How many hashes fall into each bucket, modulo ``period``, half a byte each."""
    at = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).view(np.int64)
    n = (np.bincount(at, minlength=buckets + buckets % 2) % period).astype(np.uint8)
    return (n[::2] | n[1::2] << 4).tobytes()


def waves(packed: np.ndarray, period: int, buckets: int) -> np.ndarray:
    """Rows of ``counted`` buckets as cosines and sines. Two sets differ in at least ``wave(period)`` times what the product of
    their rows is less than the number of buckets: a bucket's counts differ by no more than its n-grams do."""
    n = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    n[:, ::2], n[:, 1::2] = packed & 15, packed >> 4
    turns = 2 * np.pi * np.arange(16) / period
    parts = [f(turns).astype(np.float32)[n[:, :buckets]] for f in ((np.cos,) if period == 2 else (np.cos, np.sin))]
    return np.concatenate(parts, axis=1)


def profiles(df: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, counts, most: int, known_by) -> DataFrame:
    """``(id_col, key, size, prefix, class, sketch, counted, sums)``: what ``prefixes`` gives, but of its n-grams only those with
    counts up to ``most``. A text whose prefix has others too gets its class of sizes, its ``parity`` as ``sketch`` and its
    n-grams as ``counted`` in the buckets of its class and of the two below it, and its sums of signs; the rest have none.
    ``known_by`` are ``directions`` and ``class_shapes``, broadcast."""
    kind, width = df.schema[id_col].dataType.simpleString(), class_width(threshold)

    def run(batches):
        known, (signs, shapes) = np.frombuffer(counts.value, np.uint8), known_by.value
        for part, keys in _parts(batches, text_col):
            sizes, rows, classes, bits, tiles, sums = [], [], [], [], [], []
            for h in shingle_lists(keys, ngram):
                n = known[(h & np.uint64(BUCKETS - 1)).view(np.int64)]
                take = len(h) - int(np.ceil(len(h) * threshold - 1e-9)) + 1 if len(h) else 0
                last = int(np.partition(n, take - 1)[take - 1]) if take else 0
                few = np.flatnonzero(n <= min(last, most))  # what the prefix has with such counts, and equals of its last
                order = few[np.lexsort((h[few], n[few]))][:take]
                at = np.flatnonzero(n[order] > 1)
                sizes.append(len(h))
                rows.append([{"h": x, "at": i} for x, i in zip(h[order[at]].view(np.int64).tolist(), at.tolist())])
                own = size_class(len(h), width) if last > most else None
                classes.append(own)
                bits.append(parity(h) if last > most else None)
                tiles.append([counted(h, *shape_of(shapes, own - i)) for i in range(3)] if last > most else None)
                sums.append(signs[:, (h & np.uint64(SIGNS - 1)).view(np.int64)].sum(1, dtype=np.int64).tolist() if last > most else None)
            columns = [part.column(id_col), pa.array([_digest(k) for k in keys], pa.binary()), pa.array(sizes, pa.int64())]
            columns += [pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))), pa.array(classes, pa.int32())]
            columns += [pa.array(bits, pa.binary()), pa.array(tiles, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "key", "size", "prefix", "class", "sketch", "counted", "sums"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, key binary, size bigint, prefix array<struct<h: bigint, at: int>>, class int, sketch binary, counted array<binary>, sums array<bigint>"
    )


def ngram_index(sets: DataFrame) -> tuple[np.ndarray, ...]:
    """``(ids, sizes, hashes, begin, owner)``, ids as an Arrow array, of a bounded table ``(id, shingles)``: the places in ``ids`` of the texts that
    have ``hashes[i]`` are ``owner[begin[i] : begin[i + 1]]``."""
    found = sets.toArrow()
    lists = found.column(1).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().to_numpy().view(np.uint64)
    order = np.argsort(flat, kind="stable")
    hashes, begin = np.unique(flat[order], return_index=True)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    return found.column(0).combine_chunks(), sizes, hashes, np.append(begin, len(flat)), owner


def indexed_matches(df: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, index, kind: str) -> DataFrame:
    """``(left, right, similarity)`` of all texts of ``df`` and those of a broadcast ``ngram_index`` that reach the threshold,
    ``kind`` being the type of the latter's ids. What two texts share is counted in the task, so only results leave it."""

    def run(batches):
        ids, sizes, hashes, begin, owner = index.value
        most = sizes.max(initial=0)
        for part, keys in _parts(batches, text_col):
            at, to, similar = [], [], []
            for i, h in enumerate(shingle_lists(keys, ngram)):
                if not len(hashes) or len(h) * threshold > most:
                    continue
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                place = place[hashes[place] == h]
                n = begin[place + 1] - begin[place]
                every = np.repeat(begin[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[every], minlength=len(ids))
                ratio = shared / np.maximum(len(h) + sizes - shared, 1)
                good = np.flatnonzero((ratio >= threshold) & (shared > 0))
                at += [i] * len(good)
                to += good.tolist()
                similar += ratio[good].tolist()
            columns = [part.column(id_col).take(pa.array(at, pa.int64())), ids.take(pa.array(to, pa.int64())), pa.array(similar, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["left", "right", "similarity"])

    return df.select(id_col, text_col).mapInArrow(run, f"left {df.schema[id_col].dataType.simpleString()}, right {kind}, similarity double")


def sketches(df: DataFrame, id_col: str, text_col: str, ngram: int, bands: int, rows: int, num_perm: int, seed: int) -> DataFrame:
    """``(id_col, key, size, bands, tally)``: a digest of each normalized text, how many n-grams it has, its band keys, none
    for an empty text, and its ``tally``. Nulls raise.

    One pass: neither n-grams nor signatures leave the task.
    """
    hasher, kind = MinHasher(num_perm, seed), df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part, keys in _parts(batches, text_col):
            sets = shingle_lists(keys, ngram)
            found = band_keys(hasher.signatures(sets), bands, rows).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id_col),
                    pa.array([_digest(k) for k in keys], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([f if len(s) else [] for f, s in zip(found, sets)], pa.list_(pa.int64())),
                    pa.array([tally(s) for s in sets], pa.binary()),
                ],
                names=[id_col, "key", "size", "bands", "tally"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key binary, size bigint, bands array<bigint>, tally binary")
