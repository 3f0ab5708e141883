"""SimHash near-duplicate groups by pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits agree on at least three
whole blocks, so each distinct fingerprint is listed under its twenty triples of blocks and only fingerprints that share
a triple are compared. A triple holds 32 bits or so, which keeps chance meetings rare as the table grows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import per_row, read
from foldwright.operators.components import connected_components
from foldwright.runtime import checkpoint

WORDS, SEED, MAX_DISTANCE = 3, 42, 3
#: Widths of the six blocks, from the lowest bit up; MAX_DISTANCE + 3 blocks leave three that agree.
WIDTHS = (10, 11, 11, 10, 11, 11)
#: Fingerprints of one bucket compared in one step; a larger bucket is dealt out as pairs of such tiles.
TILE = 2048
#: Shingles whose hashes are unpacked to bits at a time.
STEP = 1 << 16

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = str.maketrans("\t\n\v\f\r", "     ")


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of a whole text; null or no words: zero. Fewer than three words are one shingle."""
    words = (text or "").translate(_UPPER).translate(_SPACE).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    votes = np.zeros(64, np.int64)
    of = xxhash.xxh64_intdigest
    for low in range(0, n, STEP):
        part = words[low : min(low + STEP, n) + WORDS - 1]
        shingles = map(" ".join, zip(*(part[i:] for i in range(WORDS)))) if len(part) >= WORDS else [" ".join(part)]
        hashes = np.fromiter((of(s.encode(), SEED) for s in shingles), np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *keep, fp)``, ``fp`` the fingerprint as a signed 64-bit number; one row per input row, no shuffle."""

    def one(text):
        fp = fingerprint(text)
        return (fp - (1 << 64) if fp >> 63 else fp,)

    return per_row(docs, text_col, [id_col, *keep], "fp bigint", one)


def block_keys(fp) -> list:
    """The columns of the twenty triples: fingerprint bits of three blocks, the others zero."""
    masks, low = [], 0
    for width in WIDTHS:
        masks.append(((1 << width) - 1) << low)
        low += width
    out = []
    for three in combinations(masks, len(WIDTHS) - MAX_DISTANCE):
        mask = sum(three)
        out.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return out


def _forest(fps: np.ndarray, left: slice, right: slice) -> tuple[list, list]:
    """Spanning links among all pairs between two tiles of a bucket: as connected as all close pairs are."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    us, vs = [], []
    a, b = np.arange(len(fps))[left], np.arange(len(fps))[right]
    # What earlier rows have joined is left out as a whole, so a dense bucket costs a row's pairs and not all of them.
    label = np.arange(len(fps))
    low, step = 0, 16
    while low < len(a):
        rows = a[low : low + step]
        close = (np.bitwise_count(fps[rows][:, None] ^ fps[b][None, :]) <= MAX_DISTANCE) & (label[rows][:, None] != label[b][None, :])
        before = len(us)
        for i, j in zip(*np.nonzero(close)):
            i, j = int(rows[i]), int(b[j])
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                us.append(i)
                vs.append(j)
        low, step = low + step, min(2 * step, 256)
        if low < len(a) and len(us) > before:
            label = np.array([root(x) for x in range(len(fps))])
    return us, vs


def links(distinct: DataFrame) -> DataFrame:
    """``(u, v)`` links between close fingerprints, as connected as the full list of pairs.

    ``distinct`` has ``fp``, each once. Buckets of more than TILE fingerprints are dealt out by pairs of
    tiles: no task holds more than two tiles of one bucket, and every pair of a bucket is compared.
    """
    spark = distinct.sparkSession
    listed = distinct.select(
        "fp", F.posexplode(F.array(*block_keys(F.col("fp")))).alias("block", "key")
    )
    sizes = listed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = listed.join(sizes, ["block", "key"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    shared = shared.select("block", "key", "fp", tiles.alias("tiles"), tile.alias("tile"))
    # Tile t meets tile s in cell (min, max): a row of tile t goes to the cells of all tiles.
    cells = shared.select(
        "block", "key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    ).select(
        "block", "key", "fp", "tile",
        F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "block", "key", "a", "b").sortWithinPartitions("block", "key", "a", "b", "tile")

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("block", "key", "a", "b", "tile", "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            block, key, a, b = cols[:4]
            new = np.ones(len(block), bool)
            new[1:] = (block[1:] != block[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = np.flatnonzero(new)
            held = [x[starts[-1] :] for x in cols]
            yield from bucket(cols, starts)
        if held is not None:
            yield from bucket(held, np.array([0, len(held[0])]))

    def bucket(cols, bounds):
        us, vs = [], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low < 2:
                continue
            a, b, tile, fps = (x[low:high] for x in cols[2:])
            cut = int(np.searchsorted(tile, b[0])) if a[0] != b[0] else 0
            left, right = (slice(0, cut), slice(cut, None)) if a[0] != b[0] else (slice(None), slice(None))
            u, v = _forest(fps.view(np.uint64), left, right)
            us += fps[u].tolist()
            vs += fps[v].tolist()
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def linked(distinct: DataFrame) -> DataFrame:
    """``distinct`` with ``part``, the least fingerprint of those that links reach from ``fp``."""
    # The links are read twice below; written, they are made once.
    parts = connected_components(checkpoint(links(distinct.select("fp"))), "u", "v")
    joined = distinct.join(parts, distinct["fp"] == parts["node"], "left")
    return checkpoint(joined.select(*distinct.columns, F.coalesce("component", "fp").alias("part")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``.

    Texts are lower-cased (A-Z), split on ASCII white space and hashed as 3-word shingles, repeats included.
    Fingerprints within three bits are linked, and ``component_id`` is the least id reachable. Null and empty texts have
    fingerprint zero and are linked like any other. Rows with a null id get a component but never name one; a component
    without any id has a null ``component_id``. Repeated rows give repeated results; an empty table gives none.
    Other columns are ignored. Exact copies share a fingerprint and are compared once, as its least id.
    """
    known = checkpoint(fingerprints(docs, id_col, text_col))
    distinct = checkpoint(known.groupBy("fp").agg(F.min(id_col).alias("least")))
    parts = linked(distinct)
    names = checkpoint(parts.groupBy("part").agg(F.min("least").alias("component_id")))
    of = checkpoint(parts.join(names, "part").select("fp", "component_id"))
    return known.join(of, "fp", "left").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents with one row of each near-duplicate group: the least ``doc_id``, null last, and a hash of the text
    among rows that share it. The row is told by both, as ids may be null or repeated; of repeated rows one stays.
    Null and empty texts are one group. Columns of any name stay as they are; an empty table gives none.
    """
    named = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    known = fingerprints(named, keep=("key",))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    distinct = checkpoint(known.groupBy("fp").agg(F.min(row).alias("least")))
    first = linked(distinct).groupBy("part").agg(F.min("least").alias("least")).select("least.*")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")
    kept = checkpoint(first.select("unnamed", name("doc_id"), "key"))
    told = ["unnamed", "name", "key"]
    # The rows wait in one column, so that no name of theirs meets one of these.
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col("row.doc_id").isNull().alias("unnamed"), name("row.doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("key"))
    return rows.join(kept.hint("merge"), told, "left_semi").dropDuplicates(told).select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
