"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens in blocks of some megabytes. A block keeps its documents as positions in the list of its
own distinct words, so what is exploded and shuffled is each block's distinct words, not every occurrence: packed by a
hash of the word into buckets, of which there are as many as the input asks for. A bucket is read pack by pack, merges
each word of the whole corpus once and sends the ids back to the blocks that asked. There documents are put together by
position, and decoded by a join with the token-byte table, which is broadcast.
"""

from __future__ import annotations

import heapq
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, read

#: Characters of text in one block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Bytes of text whose distinct words share a bucket, so that no task grows with the corpus.
BUCKET = 64 << 20


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """``(id, bytes)`` of a rank file: a line for each token, its bytes in base 64, then its rank."""
    part = F.split("value", " ")
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(part[1].cast("int").alias("id"), F.unbase64(part[0]).alias("bytes"))


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings in one: their lengths, then themselves, compressed."""
    lengths = np.array([len(x) for x in parts], np.uint32)
    return zstandard.compress(np.uint32(len(parts)).tobytes() + lengths.tobytes() + b"".join(parts), 3)


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _pack_positions(places: np.ndarray) -> bytes:
    """Places below 192 take one byte, others three, or five from 2 ** 21 on; compressed."""
    size = np.where(places < 192, 1, np.where(places < 1 << 21, 3, 5))
    ends = np.cumsum(size)
    at, out = ends - size, np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[at[size == 1]] = places[size == 1]
    for width, lead in ((3, 192), (5, 255)):
        own = size == width
        out[at[own]] = lead + (places[own] >> 16 if width == 3 else 0)
        for i in range(1, width):
            out[at[own] + i] = (places[own] >> 8 * (width - 1 - i)) & 255
    return zstandard.compress(out.tobytes(), 3)


def _unpack_positions(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    # A lead byte is one that no longer code covers: walk along the few long codes, all else is single.
    step = np.where(raw < 192, 1, np.where(raw < 255, 3, 5))
    first = np.ones(len(raw), bool)
    at = 0
    for k in np.flatnonzero(step > 1).tolist():
        if k >= at:
            at = k + int(step[k])
            first[k + 1 : at] = False
    at = np.flatnonzero(first)
    size, out = step[at], raw[at].astype(np.int64)
    for width in (3, 5):
        own = at[size == width]
        value = raw[own].astype(np.int64) - 192 if width == 3 else np.zeros(len(own), np.int64)
        for i in range(1, width):
            value = value << 8 | raw[own + i]
        out[size == width] = value
    if len(out) != n:
        raise ValueError("positions are broken")
    return out


def _blocks(docs: DataFrame, pattern: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each block: its documents' ids and lengths in words, the place of each word in the list of distinct
    words, each distinct word's bucket, and for each bucket that has any its words packed, in the order of their places.
    So a block grows with its own words and not with the number of buckets, which grows with the input."""
    kind = docs.schema[id_col].dataType.simpleString()
    packed = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))

    def run(batches):
        split, task, k = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, text_col, BLOCK):
            places: dict[str, int] = {}
            place = places.setdefault
            runs = [np.fromiter((place(w, len(places)) for w in split(text)), np.int64) for text in texts]
            flat = np.concatenate(runs)
            # Frequent words get small places.
            order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = list(places)
            words = [words[i].encode() for i in order.tolist()]
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
            members = np.argsort(of, kind="stable")
            full, starts = np.unique(of[members], return_index=True)
            parts = np.split(members, starts[1:])
            packs = [{"bucket": b, "words": _pack([words[i] for i in own.tolist()])} for b, own in zip(full.tolist(), parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{k}"]),
                    pa.array([batch.column(id_col).to_pylist()], pa.list_(batch.column(id_col).type)),
                    pa.array([[len(r) for r in runs]], pa.list_(pa.int64())),
                    pa.array([_pack_positions(rank[flat])], pa.binary()),
                    pa.array([zstandard.compress(of.tobytes())], pa.binary()),
                    pa.array([packs], packed),
                ],
                names=["block", "docs", "sizes", "positions", "buckets", "packs"],
            )
            k += 1

    schema = (
        f"block string, docs array<{kind}>, sizes array<bigint>, positions binary, buckets binary, "
        "packs array<struct<bucket: int, words: binary>>"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _asked(blocks: DataFrame) -> DataFrame:
    """``(bucket, block, words)``: the packs of all blocks. Takes whole rows so that the exchange below is shared."""

    def run(batches):
        for batch in batches:
            for block, packs in zip(batch.column("block").to_pylist(), batch.column("packs").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["bucket"] for x in packs], pa.int32()),
                        pa.array([block] * len(packs), pa.string()),
                        pa.array([x["words"] for x in packs], pa.binary()),
                    ],
                    names=["bucket", "block", "words"],
                )

    return blocks.mapInArrow(run, "bucket int, block string, words binary")


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: from single bytes on, the pair of neighbours with the least rank is joined, the first of
    equals, until none has a rank. A heap holds the pairs; one whose parts were joined otherwise is stale."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the start of each part
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[i], after[middle] = end, -1
        if end < n:
            before[end] = i
            if (rank := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        if (k := before[i]) >= 0 and (rank := ranks.get(word[k:end])) is not None:
            heapq.heappush(heap, (rank, k, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _coded(asked: DataFrame, ranks: dict[bytes, int], buckets: int) -> DataFrame:
    """``(of, bucket, ids)`` for each pack of words: their ids packed. Packs stream through the task of their bucket,
    which keeps the words it has merged: at most those of BUCKET bytes of text or so."""
    shared = asked.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table, known = shared.value, {}
        for batch in batches:
            for block, bucket, pack in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words"))):
                out = []
                for word in _unpack(pack):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(merge(word, table), np.uint32).tobytes()
                    out.append(ids)
                lengths = np.fromiter(map(len, out), np.uint32, len(out)) // 4
                ids = np.frombuffer(b"".join(out), np.uint8).reshape(-1, 4).T  # like bytes together
                data = np.uint32(len(out)).tobytes() + lengths.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([zstandard.compress(data, 3)], pa.binary())], names=["of", "bucket", "ids"]
                )

    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "of string, bucket int, ids binary")


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of a pack."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    whole = lambda x: np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel()
    return whole(raw[4 : 4 + 4 * n]).astype(np.int64), whole(raw[4 + 4 * n :]).astype(np.int32)


def decode_ids(coded: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``(key, ids, decoded)``: the ids of each row, which ``key`` names, joined with the token-byte table and put
    together by position. The table is broadcast: it has as many rows as the vocabulary, whatever the input. An id that
    it lacks is an error; no ids decode to no bytes."""
    each = coded.select(key, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    known = F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.lit("no such token"))).otherwise(F.hex("bytes"))
    parts = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "id", known.alias("hex")))).alias("parts"))
    full = F.filter("parts", lambda x: x["id"].isNotNull())
    return parts.select(
        key,
        F.transform(full, lambda x: x["id"]).alias("ids"),
        F.unhex(F.array_join(F.transform(full, lambda x: x["hex"]), "")).alias("decoded"),
    )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)`` for each row: the token ids of the whole text and the bytes they decode to.

    ``path`` is a rank file, ``pattern`` cuts texts into pre-tokens; there are no special tokens. Null and empty texts
    have no ids and no bytes. Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks = {bytes(r["bytes"]): r["id"] for r in token_table(spark, path).collect()}  # bounded by the vocabulary file
    tokens = spark.sparkContext.broadcast({i: b for b, i in ranks.items()})
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / BUCKET))
    # One exchange serves both sides: the words on their way out and the documents that wait for the ids.
    blocks = _blocks(docs, pattern, n, id_col, text_col).repartition(n, "block")
    back = _coded(_asked(blocks), ranks, n)
    kind = docs.schema[id_col].dataType.simpleString()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table, made = tokens.value, []
        parts = [_unpack_ids(x) for x in right.sort_by("bucket").column("ids").to_pylist()]
        lengths = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        for row in left.drop_columns(["packs"]).to_pylist():
            of = np.frombuffer(zstandard.decompress(row["buckets"]), np.uint32)
            if len(of) != len(lengths):
                raise ValueError(f"block {row['block']}: {len(lengths)} of {len(of)} words came back")
            came = np.empty(len(of), np.int64)  # for each place, where its word is in what came back
            came[np.argsort(of, kind="stable")] = np.arange(len(of))
            sizes = np.array(row["sizes"], np.int64)
            words = came[_unpack_positions(row["positions"], int(sizes.sum()))]
            till = np.concatenate(([0], np.cumsum(lengths[words])))
            flat = ids[np.repeat(starts[words] - till[:-1], lengths[words]) + np.arange(till[-1])]
            bounds = till[np.concatenate(([0], np.cumsum(sizes)))]
            decoded = [b"".join([table[i] for i in flat[a:b].tolist()]) for a, b in zip(bounds[:-1], bounds[1:])]
            made.append(
                pa.table(
                    {
                        id_col: pa.array(row["docs"], left.schema.field("docs").type.value_type),
                        "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())),
                        "decoded": pa.array(decoded, pa.binary()),
                    }
                )
            )
        return pa.concat_tables(made)

    both = blocks.groupBy("block").cogroup(back.groupBy("of"))
    return both.applyInArrow(assemble, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
