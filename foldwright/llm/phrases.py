"""Frequent phrases that stick together, from suffix automata of shards of the corpus.

A shard is some million words of one language, of whole documents. Its automaton has, for every word, what may stand before it, up to DEPTH
words back: substrings that end at the same places are one state, whose longest substring stands for the shorter ones
too, down to one word more than its suffix link has. States are found by refining end positions backwards, so they come
with the number of their end positions, and their links are the coarser classes that they came from.

A phrase is no more frequent than what it holds, so there are three rounds. Words are summed over shards first; those
frequent in all the corpus mark bits of a filter of a fixed size, and a word that it doesn't have ends a piece from then on.
The second round has depth two: counts of pairs are summed by bits of such a filter, in packed chunks of it, and bits with
enough mark the pairs that may be frequent. The third, of depth four, goes no further back than such pairs go. Its states are
taken apart in the shard, and their substrings travel packed by a hash of all their words, some hundreds to a row, to where
they are summed and those that are frequent leave. The filters let some rare phrases through, which costs bytes; none is
missed, and what is counted is counted exactly.

Subsumption needs no longer phrase than by one word: what holds a phrase at the share holds everything between at least
as often. So each phrase looks at its suffix link, without its first word, and at its mirror image, without its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, read
from foldwright.runtime import broadcast_if_small, checkpoint, written

#: Words of the longest phrase; occurrences of a candidate; share in percent at which a longer phrase replaces it;
#: phrases of a language in the report; what the score is multiplied by.
DEPTH, LEAST, SHARE, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Words of a shard; bytes of a text that are cut into words at a time.
SHARD, SLICE = 2_000_000, 4 << 20
#: Bits of a filter, 16 MB: it grows with nothing. Tasks sum counts for CHUNK of them at a time.
BITS, CHUNK = 1 << 27, 1 << 17
#: Buckets in which phrases are summed, at least; words of the corpus for each bucket where there are more.
BUCKETS, BUCKET_WORDS = 256, 1_000_000
#: What stands between pieces; no byte of UTF-8.
END = b"\xff"
#: Bytes as words have them: letters A to Z in lower case, what ends a piece as END, tabs as spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


class Shard:
    """Words of one language as numbers; 0 ends a piece."""

    def __init__(self):
        self.words: list[bytes] = [b""]
        self.number: dict[bytes, int] = {END: 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int64)]

    def add(self, text: str) -> int:
        """Append a text; the length that it has added."""
        data, number, at, size = text.encode().translate(WORDS), self.number, 0, 0
        while at < len(data):
            end = data.find(END, at + SLICE)
            end = len(data) if end < 0 else end + 1
            found = data[at:end].replace(END, b" \xff ").split()
            for w in set(found).difference(number):
                number[w] = len(number)
                self.words.append(w)
            self.parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            size += len(found)
            at = end
        self.parts.append(np.zeros(1, np.int64))
        return size

    def sequence(self) -> np.ndarray:
        return np.concatenate(self.parts)


class Automaton:
    """The states of a shard's suffix automaton down to a depth.

    ``at[k]`` are the end positions of the substrings of ``k + 1`` words and ``of[k]`` the class of each: positions of one
    class end the same substring. ``count[k]`` has the number of end positions of each class, ``first[k]`` one of them and
    ``link[k]`` the class of its substring without the first word.
    """

    def __init__(self, words: np.ndarray, depth: int, passes=None):
        """``passes(first, last)`` says of pairs of words which may be extended; all if it isn't given."""
        self.words = words
        self.at, self.of, self.count, self.first, self.link = [], [], [], [], []
        at = np.flatnonzero(words)
        self._level(at, words[at], np.zeros(len(at), np.int64))
        for k in range(1, depth):
            start = self.at[-1] - k
            inside = words[start] > 0
            at, link = self.at[-1][inside], self.of[-1][inside]
            if k > 1:
                # The substring without its last word must have passed too: it ends one place earlier.
                alive = np.zeros(len(words), bool)
                alive[self.at[-1]] = True
                inside = alive[at - 1]
                at, link = at[inside], link[inside]
            self._level(at, link * (int(words.max(initial=0)) + 1) + words[at - k], link)
            if k == 1 and passes is not None:
                first = self.first[1]
                good = passes(words[first - 1], words[first])
                keep = good[self.of[1]]
                number = np.cumsum(good) - 1
                self.at[1], self.of[1] = self.at[1][keep], number[self.of[1][keep]]
                self.count[1], self.first[1], self.link[1] = self.count[1][good], first[good], self.link[1][good]

    def _level(self, at: np.ndarray, key: np.ndarray, link: np.ndarray) -> None:
        _, first, of, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.at.append(at)
        self.of.append(of)
        self.count.append(count)
        self.first.append(at[first])
        self.link.append(link[first])

    def states(self, shortest: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(longest, shortest, ends, counts)``: the states of each length and range, by one end position each.

        A class that one class of the next level has all end positions of is in that one's state.
        """
        out, depth = [], len(self.at)
        low = np.ones(len(self.count[0]), np.int64)  # the shortest substring of the state of each class
        for k in range(depth):
            inner = np.zeros(len(self.count[k]), bool)
            if k + 1 < depth:
                same = self.count[k + 1] == self.count[k][self.link[k + 1]]
                inner[self.link[k + 1][same]] = True
                higher = np.where(same, low[self.link[k + 1]], k + 2)
            own = ~inner & (k + 1 >= shortest)
            least = np.maximum(low, shortest)
            for n in np.unique(least[own]).tolist():
                chosen = own & (least == n)
                out.append((k + 1, n, self.first[k][chosen], self.count[k][chosen]))
            if k + 1 < depth:
                low = higher
        return out


def pair_bits(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The filter's bit of each pair, by the hashes of its words."""
    with np.errstate(over="ignore"):
        mixed = (first * np.uint64(0x9E3779B97F4A7C15) + last) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(17)).astype(np.int64) % BITS


def _marked(filter_: bytes, bits: np.ndarray) -> np.ndarray:
    return (np.frombuffer(filter_, np.uint8)[bits >> 3] >> (bits & 7)) & 1 > 0


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _shards(batches, limit: int) -> Iterator[tuple[str, Shard]]:
    """The texts of a task as shards of a language each, all given out when they hold ``limit`` words together."""
    open_: dict[str, Shard] = {}
    size = 0
    for batch, texts in chunks(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            if lang not in open_:
                open_[lang] = Shard()
            size += open_[lang].add(text)
            if size >= limit:
                yield from open_.items()
                open_, size = {}, 0
    yield from open_.items()


def _kept(lang: str, shard: Shard, common) -> tuple[np.ndarray, np.ndarray]:
    """A shard's sequence, ended at each word that the broadcast filter ``common`` doesn't have, and its words' hashes."""
    words = shard.sequence()
    hashes = _hashes(lang, shard.words)
    words[~_marked(common.value, pair_bits(hashes, hashes))[words]] = 0
    return words, hashes


def word_counts(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(lang, w0, n)``: how often each word occurs in ``docs``, which has ``lang`` and ``text``."""

    def run(batches):
        for lang, own in _shards(batches, shard):
            words, text = own.sequence(), pa.array(own.words, pa.binary()).cast(pa.string())
            for _, _, ends, counts in Automaton(words, 1).states(1):
                columns = [pa.array([lang] * len(ends), pa.string()), text.take(pa.array(words[ends])), pa.array(counts, pa.int64())]
                for at in range(0, len(ends), 50_000):
                    yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names=["lang", "w0", "n"])

    dealt = docs.select("lang", "text").mapInArrow(run, "lang string, w0 string, n bigint").repartition("lang", "w0")
    return dealt.groupBy("lang", "w0").agg(F.sum("n").alias("n"))  # a shard's counts are sums already


def _substrings(shard: Shard, words: np.ndarray, hashes: np.ndarray, passes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(phrases, counts, hashes)`` of a shard's substrings of two words or more: its automaton's states, taken apart."""
    text = pa.array(shard.words, pa.binary()).cast(pa.large_string())
    phrases_, sums, mixed = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for longest, low, ends, counts in Automaton(words, DEPTH, passes).states(2):
        for size in range(low, longest + 1):
            own = [words[ends - i] for i in reversed(range(size))]
            phrases_.append(pc.binary_join_element_wise(*(text.take(pa.array(w)) for w in own), pa.scalar(" ", pa.large_string())))
            h = np.full(len(ends), size, np.uint64)
            with np.errstate(over="ignore"):
                for w in own:
                    h = (h ^ hashes[w]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
            sums.append(counts)
            mixed.append(h)
    return pa.concat_arrays(phrases_), np.concatenate(sums), np.concatenate(mixed)


def _wrapped(phrases_: pa.Array, counts: np.ndarray) -> bytes:
    """Strings and their counts as compressed bytes: how many, their lengths, the counts, the characters."""
    lengths = pc.binary_length(phrases_).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(phrases_.buffers()[1], np.int32)[phrases_.offset : phrases_.offset + len(phrases_) + 1]
    data = memoryview(phrases_.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    return zstandard.compress(np.concatenate([[len(lengths)], lengths, counts]).astype("<u4").tobytes() + data, 3)


def _unwrapped(packed: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths, counts = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, -1)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 8 * n :])), counts.astype(np.int64)


def phrase_counts(docs: DataFrame, common, passing, least: int, buckets: int = BUCKETS, shard: int = SHARD) -> DataFrame:
    """``(lang, phrase, size, n)`` of the phrases of two to DEPTH words that occur ``least`` times. ``common`` and ``passing``
    are broadcast filters of words and of pairs."""

    def packed(batches):
        for lang, own in _shards(batches, shard):
            words, hashes = _kept(lang, own, common)
            passes = lambda first, last, h=hashes: _marked(passing.value, pair_bits(h[first], h[last]))
            found, counts, mixed = _substrings(own, words, hashes, passes)
            bucket = ((mixed >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, counts = found.take(pa.array(order)), counts[order]
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = [_wrapped(found.slice(a, b - a).cast(pa.string()), counts[a:b]) for a, b in zip(at, [*at[1:], len(order)])]
            names = ["bucket", "lang", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at], pa.int32()), pa.array([lang] * len(at), pa.string()), pa.array(rows, pa.binary())], names=names)

    def summed(batches):
        now, parts, held, before = None, [], 0, 0

        def sums():
            found = pa.table({"phrase": pa.chunked_array([p for p, _ in parts]), "n": pa.chunked_array([pa.array(n) for _, n in parts])})
            found = found.group_by("phrase").aggregate([("n", "sum")]).combine_chunks()
            return found.column("phrase"), found.column("n_sum")

        def done():
            found, n = (c.combine_chunks() for c in sums())
            good = pc.greater_equal(n, least)
            found, n = found.filter(good), n.filter(good)
            size = pc.add(pc.count_substring(found, " "), 1).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([now[1]] * len(n), pa.string()), found, size, n], names=["lang", "phrase", "size", "n"])

        for batch in batches:
            for *key, data in zip(batch.column("bucket").to_pylist(), batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
                if key != now:
                    if now is not None:
                        yield from done()
                    now, parts, held, before = key, [], 0, 0
                parts.append(_unwrapped(data))
                held += len(parts[-1][1])
                if held > 2 * before + 1_000_000:  # what shards repeat is put together before more of it is held
                    found, n = sums()
                    parts = [(p, c.to_numpy()) for p, c in zip(found.chunks, n.chunks)]
                    held = before = len(found)
        if now is not None:
            yield from done()

    rows = docs.select("lang", "text").mapInArrow(packed, "bucket int, lang string, counts binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(summed, "lang string, phrase string, size int, n bigint")


def _filter(chunks_: DataFrame, least: int) -> bytes:
    """The filter of what ``(chunk, counts)`` rows sum to ``least`` or more: packed counts of the bits of a chunk each."""

    def run(batches):
        now, sums = None, None

        def done():
            bits = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, sums = chunk, np.zeros(CHUNK, np.int64)
                at, n = np.frombuffer(zstandard.decompress(data), "<u4").reshape(2, -1)
                sums[np.cumsum(at)] += n  # a row has each bit once
        if now is not None:
            yield done()

    out = bytearray(BITS // 8)
    for row in chunks_.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary").collect():
        out[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = row["bits"]  # BITS bits in all, whatever the rows
    return bytes(out)


def _packed(bits: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(chunk, counts)``: the sums of counts by bit, packed by chunk: steps from bit to bit, then the sums."""
    at, of = np.unique(bits, return_inverse=True)
    sums = np.bincount(of, counts, len(at)).astype(np.int64)
    chunk = at // CHUNK
    found, starts = np.unique(chunk, return_index=True)
    rows = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(at)])):
        steps = np.diff(at[a:b] - found[k] * CHUNK, prepend=0)
        rows.append(zstandard.compress(np.concatenate([steps, np.minimum(sums[a:b], 0xFFFFFFFF)]).astype("<u4").tobytes(), 3))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], names=["chunk", "counts"])


def word_filter(words: DataFrame) -> bytes:
    """The filter that has the words ``(lang, w0)``."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("w0").to_pylist())
            own = np.array([_hashes(lang, [w.encode()])[0] for lang, w in rows], np.uint64)
            yield from _packed(pair_bits(own, own), np.ones(len(own)))

    return _filter(words.select("lang", "w0").mapInArrow(run, "chunk int, counts binary"), 1)


def pair_filter(docs: DataFrame, common, least: int, shard: int = SHARD) -> bytes:
    """The filter that has every pair of words of ``common`` that occurs ``least`` times in ``docs``, and some that don't."""

    def run(batches):
        for lang, own in _shards(batches, shard):
            words, hashes = _kept(lang, own, common)
            pairs = Automaton(words, 2)
            last = pairs.first[1]
            yield from _packed(pair_bits(hashes[words[last - 1]], hashes[words[last]]), pairs.count[1])

    return _filter(docs.select("lang", "text").mapInArrow(run, "chunk int, counts binary"), least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(phrases, langs)``: ``(lang, phrase, size, a)`` of all phrases of one to four words that occur ``least`` times in
    their language's pieces, and ``(lang, n)``, the words of each language. ``docs`` has ``lang`` and ``text``."""
    share = docs.sparkSession.sparkContext.broadcast
    words = written(word_counts(docs, shard))
    langs, words = checkpoint(words.groupBy("lang").agg(F.sum("n").alias("n"))), words.where(F.col("n") >= least)
    buckets = max(BUCKETS, (langs.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    common = share(word_filter(words))
    passing = share(pair_filter(docs, common, least, shard))
    words = words.select("lang", F.col("w0").alias("phrase"), F.lit(1).alias("size"), "n")
    both = words.unionByName(phrase_counts(docs, common, passing, least, buckets, shard))
    return written(both.withColumnRenamed("n", "a")), langs


def _ratio(top: str, scale: int, bottom: str) -> str:
    """``floor(scale * top / bottom)`` in decimals, as products pass 64 bits."""
    return f"(CAST({top} AS decimal(20, 0)) * CAST({scale} AS decimal(10, 0))) div ({bottom})"


def phrases(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE, top: int | None = TOP, shard: int = SHARD
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: phrases of two to four words within a piece of text that occur ``least``
    times and in no longer phrase at ``share`` percent of that or more, by how much their parts stick together.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut with the lowest score ``floor(SCALE * a / (l + r))``, of
    equals the first, and ``n`` the language's words. The first ``top`` of each language, or all: by falling score, falling
    ``a``, phrase as UTF-8. A null language is ``und``; null and empty texts have no words; repeated rows count as often as
    they stand there; an empty table gives nothing; other columns are ignored.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    counts, langs = frequent_phrases(docs.select(lang, F.col(text_col).alias("text")), least, shard)
    word = F.split("phrase", " ")
    found = counts.where("size > 1")

    def part(start, length):
        return F.array_join(F.slice(word, start, length), " ")

    # What a phrase's suffix link and its mirror image are: itself without its first or its last word.
    links = F.explode(F.array(part(F.lit(2), F.col("size") - 1), part(F.lit(1), F.col("size") - 1)))
    longer = found.where("size > 2").select("lang", links.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left")
    own = F.expr(f"CAST(longer AS decimal(20, 0)) * 100 >= CAST(a AS decimal(20, 0)) * {share}")
    kept = kept.where(~F.coalesce(own, F.lit(False))).drop("longer")

    # Parts stand in the order of cuts, the left one first, so that two neighbours are a cut.
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(part(F.lit(1), k), part(k + 1, F.col("size") - k))))
    parts = kept.select("lang", "phrase", "a", F.posexplode(cuts).alias("at", "part"))
    parts = parts.join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "f"))), lambda x: x["f"])
    rows = parts.groupBy("lang", "phrase", "a").agg(listed.alias("f"))
    sums = "CAST(f[2 * k] AS decimal(20, 0)) + CAST(f[2 * k + 1] AS decimal(20, 0))"
    scored = f"transform(sequence(0, size(f) div 2 - 1), k -> named_struct('score', {_ratio('a', SCALE, sums)}, 'k', k, 'l', f[2 * k], 'r', f[2 * k + 1]))"
    rows = rows.select("lang", "phrase", "a", F.array_min(F.expr(scored)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # The first of each of some parts of a language, then of the language: no task sorts all its phrases.
        some = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.join(broadcast_if_small(langs), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read(spark, sf_dir, "documents"))
