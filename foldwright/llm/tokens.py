"""Token ids in files of independent zstandard frames, which a seek table at the end and checksums describe.

A file is a row of frames. Each holds the ids of some whole documents as little-endian unsigned 32-bit integers, about
FRAME bytes of them. Behind the last one stand two skippable frames: the index, an Arrow batch with a row for each
document (its id, frame and number of ids), and the seek table of the public seekable format: for each frame its stored
size, its size and the low half of the XXH64 of what it holds. Spark's text writer puts the files where the table goes,
whatever the store, and commits them as a whole; the line separator that it writes behind each frame is itself an empty
skippable frame, so a file stays a sequence of frames that any zstandard reader can decompress.

Documents are in the order of their ids, over a file and from file to file: ``part`` numbers the tasks that wrote, and
``before`` counts the ids of a part's earlier documents.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwright.llm.common import chunks, read
from foldwright.runtime import ensure_checkpoint_dir, written

#: Bytes of ids in a frame, beyond which the next document begins another; frames of a file. A longer document has a
#: frame of its own, so a file is at most so many frames of FRAME bytes, or of its longest documents.
FRAME, FRAMES = 256 << 10, 63
#: An empty skippable frame; the kinds of the index and the seek table; the seek table's last bytes.
GAP = b"P*M\x18\x00\x00\x00\x00"
INDEX, TABLE, MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Distinct pieces of text whose ids a worker remembers, and the longest of them in characters.
KNOWN, LONGEST = 1_000_000, 64
#: A space between two characters that nobody takes for white space: words never reach over it.
CUT = re.compile(r" (?=[^\s\u180e])(?<=[^\s\u180e] )")
#: White space, or what has been such, but for spaces and line feeds.
ODD = [c for c in map(chr, range(0x3001)) if (c.isspace() or c == "\u180e") and c not in " \n"]
#: What a worker has loaded and encoded, by vocabulary file.
_loaded: dict[str, tuple] = {}


def _cut(text: str) -> list[str]:
    """As CUT splits; where every space is such a one, the quick way."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or " \n" in text or any(c in text for c in ODD):
        return CUT.split(text)
    return text.split(" ")


class Encoder:
    """Encodes whole texts by a file of the ``tokenizers`` library for byte-level BPE, where a space begins a word.

    A text is cut at single spaces, each distinct piece is encoded once, and ids are put together again. New pieces are
    encoded in one string: the ids whose token begins with a space say where each piece begins.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text, their names are text
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(names.values()) + 1, bool)
        self.leads[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        plain = [p for p in pieces if " " not in p and len(p) <= LONGEST and not p[-1].isspace()]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(plain):
                raw, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
                self.known.update(zip(plain, [raw[a:b] for a, b in zip((4 * starts).tolist(), ends)]))
        rest = [p for p in pieces if p not in self.known]
        self.known.update(zip(rest, self._each([" " + p for p in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [_cut(x) for x in texts]
        heads = [x.pop(0) for x in parts]
        first = list(set(heads))
        begun = dict(zip(first, self._each(first)))
        pieces = set().union(*parts)
        if len(self.known) > KNOWN:  # what this text has is likely to come again
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        new = pieces.difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        out = [begun[head] + b"".join(map(get, x)) for head, x in zip(heads, parts)]
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out


def _skippable(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data


def _check(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileRows:
    """The records of one task's files: ``add`` documents in order and write each record that comes back, ``close`` last.

    Every file but the last is ``frames`` frames and an end, so a writer that begins a file after one record more cuts
    where this does.
    """

    def __init__(self, part: int, kind: pa.DataType, frame: int = FRAME, frames: int = FRAMES):
        self.part, self.kind, self.frame, self.frames, self.total = part, kind, frame, frames, 0
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self._begin()

    def _begin(self) -> None:
        self.before, self.table, self.ids, self.of, self.sizes = self.total, [], [], [], []
        self.held: list[bytes] = []
        self.bytes = 0

    def add(self, key, ids: bytes) -> Iterator[bytes]:
        self.ids.append(key)
        self.of.append(len(self.table))
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.frame:
            yield self._frame()
            if len(self.table) == self.frames:
                yield self._end()

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame()
        if self.table:
            yield self._end()

    def _frame(self) -> bytes:
        data = b"".join(self.held)
        frame = self.pack(data)
        self.table.append((len(frame) + len(GAP), len(data), _check(data)))
        self.held, self.bytes = [], 0
        return frame

    def _end(self) -> bytes:
        about = {"part": str(self.part), "before": str(self.before)}
        columns = [pa.array(self.ids, self.kind), pa.array(self.of, pa.int32()), pa.array(self.sizes, pa.int64())]
        batch = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(("id", "frame", "n"), (c.type for c in columns))), about))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        data = sink.getvalue().to_pybytes()
        index = _skippable(INDEX, self.pack(data))
        table = b"".join(struct.pack("<III", *x) for x in [*self.table, (len(index), len(data), _check(data))])
        end = index + _skippable(TABLE, table + struct.pack("<IBI", len(self.table) + 1, 0x80, MAGIC))
        self._begin()
        return end


class File:
    """One file's bytes: the index is read at once, a frame when it is asked for. Anything that isn't as its checksum
    says is an error."""

    def __init__(self, content: bytes, name: str = ""):
        self.data, self.name = memoryview(content), name
        end = len(content) - len(GAP)
        n, _, magic = struct.unpack("<IBI", self.data[end - 9 : end]) if end > 9 else (0, 0, 0)
        if magic != MAGIC or end - 17 - 12 * n < 0:
            raise ValueError(f"{name}: no seek table")
        self.table = np.frombuffer(self.data[end - 9 - 12 * n : end - 9], "<u4").reshape(n, 3).astype(np.int64)
        self.ends = np.cumsum(self.table[:, 0])
        if self.ends[-1] + 17 + 12 * n != end:
            raise ValueError(f"{name}: the seek table tells of another size")
        with pa.ipc.open_stream(self.frame(n - 1, 8)) as stream:
            self.index = stream.read_all()
        about = self.index.schema.metadata
        self.part, self.before = int(about[b"part"]), int(about[b"before"])
        self.frames = n - 1

    def frame(self, k: int, skip: int = 0) -> bytes:
        stored, size, check = self.table[k].tolist()
        try:
            raw = zstandard.ZstdDecompressor().decompress(self.data[int(self.ends[k]) - stored + skip : int(self.ends[k])], max_output_size=size)
        except zstandard.ZstdError as e:
            raise ValueError(f"{self.name}: frame {k} can't be read: {e}") from None
        if len(raw) != size or _check(raw) != check:
            raise ValueError(f"{self.name}: frame {k} differs from its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[np.ndarray, list[memoryview]]]:
        """``(rows, ids)`` for each frame that has any of the rows ``wanted`` of the index, or all rows; no other frame
        is decompressed."""
        of, sizes = (self.index.column(c).to_numpy() for c in ("frame", "n"))
        bounds = np.searchsorted(of, np.arange(self.frames + 1))
        for k in range(self.frames) if wanted is None else sorted({int(of[r]) for r in wanted}):
            data = memoryview(self.frame(k))
            rows = np.arange(bounds[k], bounds[k + 1])
            ends = 4 * np.cumsum(sizes[rows])
            texts = [data[a:b] for a, b in zip((ends - 4 * sizes[rows]).tolist(), ends.tolist())]
            if wanted is not None:
                chosen = [i for i, r in enumerate(rows.tolist()) if r in wanted]
                rows, texts = rows[chosen], [texts[i] for i in chosen]
            yield rows, texts


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text", *, frame: int = FRAME, frames: int = FRAMES
) -> None:
    """Write the ids of every whole text to files below ``path``, in ascending order of ``id_col``, null ids first, then of
    a hash of the text and the text. ``end`` is appended to each document; null and empty texts have nothing else.

    Repeated rows are repeated; an empty table gives files without documents; other columns are ignored. Rows are dealt
    into ranges of id and hash, so a repeated id alone makes no large range.
    """
    kind = to_arrow_schema(docs.select(id_col).schema).field(0).type
    last = b"" if end is None else struct.pack("<I", end)

    def run(batches):
        encoder, out = Encoder.of(vocabulary), FileRows(TaskContext.get().partitionId(), kind, frame, frames)
        record = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["value"])
        for batch, texts in chunks(batches, text_col):
            for key, ids in zip(batch.column(id_col).to_pylist(), encoder.encode(texts)):
                yield from map(record, out.add(key, ids + last))
        yield from map(record, out.close())

    rows = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_hash"))
    ranged = rows.repartitionByRange(F.asc_nulls_first(id_col), "_hash").sortWithinPartitions(F.asc_nulls_first(id_col), "_hash", text_col)
    records = ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", frames + 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _over(files: DataFrame, fields: str, kind: str, made) -> DataFrame:
    """``(id, part, before, path, row)`` of documents and what ``made(rows, ids)`` has for them as Arrow arrays."""
    names = ["id", "part", "before", "path", "row"]
    ddl = f"id {kind}, part int, before bigint, path string, row bigint" + fields
    asks = "rows" in files.columns

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch.column("path")[at].as_py()
                file = File(batch.column("content")[at].as_py(), name)
                sizes = file.index.column("n").to_numpy()
                before = file.before + np.cumsum(sizes) - sizes
                wanted = set(batch.column("rows")[at].as_py()) if asks else None
                for rows, more in made(file, wanted):
                    own = [file.index.column("id").take(pa.array(rows)).combine_chunks(), pa.array([file.part] * len(rows), pa.int32()), pa.array(before[rows])]
                    own += [pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.int64()), *more.values()]
                    yield pa.RecordBatch.from_arrays(own, names=[*names, *more])

    return files.mapInArrow(run, ddl)


def index(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``(id, part, before, path, row, n_tokens)`` of every document in the files below ``path``; no frame is decompressed."""

    def made(file, _):
        yield np.arange(file.index.num_rows), {"n_tokens": file.index.column("n").combine_chunks()}

    return _over(_files(spark, path), ", n_tokens bigint", kind, made)


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame | None = None, kind: str = "bigint") -> DataFrame:
    """``(id, part, before, path, row, ids)`` of all documents, or of those whose id is in the column ``id`` of ``wanted``;
    then only the frames that hold them are decompressed. ``kind`` is the id column's type."""
    files = _files(spark, path)
    if wanted is not None:
        found = index(spark, path, kind).join(wanted.select("id").distinct(), "id", "left_semi")
        files = files.join(found.groupBy("path").agg(F.collect_list("row").alias("rows")), "path")  # at most a file's documents

    def made(file, asked):
        for rows, ids in file.documents(asked):
            bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            yield rows, {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))}

    return _over(files, ", ids array<int>", kind, made)


def digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, read from the files: ``start`` counts the ids of all
    documents before it, over all files."""

    def made(file, _):
        for rows, ids in file.documents():
            yield rows, {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}

    each = written(_over(_files(spark, path), ", n_tokens bigint, ids_crc32 bigint", kind, made).drop("path", "row"))
    sums = each.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    starts = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    return each.join(F.broadcast(starts), "part").select("id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return digests(spark, path).withColumnRenamed("id", "doc_id")
