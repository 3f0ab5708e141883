"""Similar pairs of texts: candidates by LSH bands or by an exact prefix filter, verified on their n-gram sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.text import DIRECTIONS, check_threshold, class_shapes, directions, folded, indexed_matches, lsh_bands, most_shared, ngram_counts, ngram_index, normalized, prefixes, profiles, shared_of, shingle_lists, shingle_sets, shingles, sketches, shape_of, tallied, wave, waves
from foldwright.operators.components import connected_components
from foldwright.runtime import broadcast_if_small, checkpoint, written

#: Texts of one bucket on either side of one join key; a larger bucket is dealt out as pairs of such tiles.
TILE = 512
#: n-gram hashes that a task keeps of the texts it compares, 64 MB.
KEPT = 8 << 20
#: n-grams of one side that every task may have as an index of who has them, 24 MB.
INDEX = 2 << 20
#: Texts that an n-gram of a prefix may have to be looked up; texts with others are compared by sketches.
RARE = 16
#: Bytes of sketches, and sketches, of one side of a task; numbers of each side, and their products, that are worked on at a time.
HELD, MANY, STEP = 64 << 20, 1 << 17, 1 << 20
#: Texts, and n-grams of each, by which directions are found in which texts differ most.
SEEN, EACH = 1000, 4096


def _shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets ``left[i]`` and ``right[j]`` share, for each pair of places; pairs of one left follow each other.

    Hashes become numbers among all of the left; a left set marks its own, and those that the right sets have are added up.
    """
    out = np.zeros(len(i), np.int64)
    every = np.unique(np.concatenate(left)) if left else np.zeros(0, np.uint64)
    if not len(every) or not len(i):
        return out
    found = [np.searchsorted(every, x) for x in right]
    found = [at[every[np.minimum(at, len(every) - 1)] == x] for at, x in zip(found, right)]
    mark, starts = np.zeros(len(every), np.uint8), np.flatnonzero(np.diff(i, prepend=-1))
    for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
        own = np.searchsorted(every, left[i[at]])
        mark[own] = 1
        for k in range(at, to):
            out[k] = np.count_nonzero(mark[found[j[k]]])
        mark[own] = 0
    return out


def _compared(rows: DataFrame, kind: str, ngram: int, same: bool) -> DataFrame:
    """``(left, right, n_shared, n_union, similarity)``. ``rows`` come tile by tile, in each the texts of the left, of the right, and the pairs."""

    def run(batches):
        tile, texts, places, kept, size = None, ({}, {}), None, {}, 0

        def begun(t):
            nonlocal tile, texts, places, kept, size
            tile, texts, places, kept, size = t, ({}, {}), None, {}, 0

        def all_shared(pairs):
            """Of pairs of a tile of bounded size, whose sets are all kept."""
            nonlocal places
            if places is None:
                places = [{key: n for n, key in enumerate(side)} for side in texts]
                for side, own in enumerate(texts):
                    keys = [normalized(x.as_py()) for x in own.values()]
                    kept[side] = shingle_lists(keys, ngram) if keys else []
            other = 0 if same else 1
            i, j = np.array([places[0][p[0]] for p in pairs]), np.array([places[other][p[1]] for p in pairs])
            shared = _shared(kept[0], kept[other], i, j)
            return shared.tolist(), [len(kept[0][n]) for n in i], [len(kept[other][n]) for n in j]

        def each_shared(pairs):
            """Of pairs of a larger tile: sets are made anew where too many were kept."""
            nonlocal kept, size
            out = []
            for a, b in pairs:
                found = []
                for side, key in ((0, a), (0 if same else 1, b)):
                    if (side, key) not in kept:
                        if size > KEPT:
                            kept, size = {}, 0
                        kept[side, key] = shingles(normalized(texts[side][key].as_py()), ngram)
                        size += len(kept[side, key])
                    found.append(kept[side, key])
                out.append((shared_of(*found), len(found[0]), len(found[1])))
            return zip(*out)

        def compared(pairs):
            chars = sum(len(x.as_buffer()) if x.is_valid else 0 for side in texts for x in side.values())
            for shared, m, n, (a, b) in zip(*(all_shared if chars <= KEPT else each_shared)(pairs), pairs):
                union = m + n - shared
                yield a, b, shared, union, shared / union if union else 1.0

        for batch in batches:
            out, pairs = [], []
            rows_ = zip(*(batch.column(c).to_pylist() for c in ("tile", "what", "a", "b")), batch.column("text"))
            for t, what, a, b, text in rows_:
                if t != tile:
                    out += compared(pairs) if pairs else ()
                    pairs = []
                    begun(t)
                if what < 2:
                    texts[what][a] = text
                else:
                    pairs.append((a, b))
            out += compared(pairs) if pairs else ()
            columns = list(zip(*out)) or [()] * 5
            types = (batch.schema.field("a").type, batch.schema.field("b").type, pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["left", "right", "n_shared", "n_union", "similarity"])

    return rows.mapInArrow(run, f"left {kind}, right {kind}, n_shared bigint, n_union bigint, similarity double")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(left, right, n_shared, n_union, similarity)`` of the candidate pairs ``(left, right, tile)``, each once, that reach
    the threshold.

    A text goes once to each tile in which it is compared, however many pairs it has there, so what is moved grows with
    texts and tiles and not with pairs. Only texts that are in some pair are moved; where sizes and tallies of both sides are
    ``known``, in some ``likely`` one. ``left`` and ``right`` may be one table.
    """
    pairs = checkpoint(likely(pairs, *known, "uid", threshold)) if known else pairs
    kind, same = left.schema[id_col].dataType.simpleString(), left is right
    dealt = _dealt(pairs, left, right, id_col, F.col(text_col).alias("text"))
    return _compared(dealt, kind, ngram, same).where(F.col("similarity") >= threshold)


def _of_hubs(pairs: DataFrame) -> DataFrame:
    """``(left, right, tile)`` of distinct ``pairs``: the least text that is paired with a left one, or itself, is the hub of its
    pairs. Pairs of one group mostly have the same, so a text isn't sent anew for each left text that it is paired with."""
    least = pairs.groupBy(F.col("right").alias("left")).agg(F.min("left").alias("least"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = pairs.join(least.repartition(n), "left", "left").select(F.col("left").alias("uid"), F.col("right").alias("other_uid"), F.coalesce("least", "left").alias("hub"))
    named = checkpoint(named)
    members = [named.select(F.col("hub").alias("left"), F.col(c).alias("right")) for c in ("uid", "other_uid")]
    return _once_by_hub(named, members[0].union(members[1]).distinct())


def _dealt(pairs: DataFrame, left: DataFrame, right: DataFrame, id_col: str, *values: Column) -> DataFrame:
    """``(tile, what, a, b, *values)``, tile by tile: the ``values`` of the left ids of its pairs, of the right ones if they
    are of another table, and the pairs, ``what`` being 0, 1 and 2."""
    same = left is right
    pairs = pairs.select("tile", "left", "right")
    held = []
    ends = [pairs.select("tile", F.col(c).alias("a")) for c in ("left", "right")]
    for what, (df, need) in enumerate([(left, ends[0].union(ends[1]))] if same else [(left, ends[0]), (right, ends[1])]):
        own = df.select(F.col(id_col).alias("_id"), *values)
        need = broadcast_if_small(checkpoint(need.distinct()))  # few ids go to where the texts lie; many meet their texts by id
        own = own.join(need, F.col("a") == F.col("_id")).withColumn("what", F.lit(what)).withColumn("b", F.lit(None).cast(df.schema[id_col].dataType))
        held.append(own.drop("_id"))
    rows = pairs.select("tile", F.lit(2).alias("what"), F.col("left").alias("a"), F.col("right").alias("b"))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [rows, *held])
    return rows.repartition("tile").sortWithinPartitions("tile", "what", "a", "b")


def likely(pairs: DataFrame, left: DataFrame, right: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """The candidate ``pairs`` that may reach the threshold by the sizes and tallies that ``left`` and ``right`` have: what is
    left out shares too little, whatever its n-grams are. Tallies are a tenth of the texts that they keep from moving."""
    kind, same = left.schema[id_col].dataType.simpleString(), left is right
    rows = _dealt(pairs, left, right, id_col, F.col("size"), F.col("tally"))

    def run(batches):
        tile, sets = None, ({}, {})
        for batch in batches:
            good = []
            rows_ = zip(*(batch.column(c).to_pylist() for c in ("tile", "what", "a", "b", "size", "tally")))
            for i, (t, what, a, b, size, packed) in enumerate(rows_):
                if t != tile:
                    tile, sets = t, ({}, {})
                if what < 2:
                    sets[what][a] = packed, size
                    continue
                (x, m), (y, n) = sets[0][a], sets[0 if same else 1][b]
                most = min(most_shared(tallied(x), m, tallied(y), n), m, n)
                if most >= threshold * (m + n - most) - 1e-6:
                    good.append(i)
            found = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column(c) for c in ("tile", "a", "b")], names=["tile", "left", "right"])

    return rows.mapInArrow(run, f"tile bigint, left {kind}, right {kind}")


def starred(pairs: DataFrame) -> DataFrame:
    """``(left, right, tile)`` of distinct ``pairs``: those of one left are a tile, or several where it has more than TILE."""
    counts = pairs.groupBy("left").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    many = pairs.join(broadcast_if_small(checkpoint(counts)), "left", "left")
    return many.select("left", "right", F.xxhash64("left", F.pmod(F.xxhash64("right"), F.coalesce("tiles", F.lit(1)))).alias("tile"))


def unique_sketches(df: DataFrame, id_col: str, text_col: str, threshold: float, ngram: int, num_perm: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, uniques)``: ``(id_col, uid)`` for each row, and ``(uid, size, bands, tally)`` for each distinct normalized
    text, ``uid`` being its least id. Written once; copies are put together before anything is compared."""
    bands, rows = lsh_bands(threshold, num_perm)
    made = written(sketches(df, id_col, text_col, ngram, bands, rows, num_perm, seed))
    firsts = made.groupBy("key").agg(F.min(id_col).alias("uid"))
    uniques = checkpoint(firsts)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = made.join(uniques.withColumnRenamed("key", "_key"), (F.col(id_col) == F.col("uid")) & (F.col("key") == F.col("_key")))
    own = written(own.select("uid", "size", "bands", "tally").dropDuplicates(["uid"]))
    return made.select(id_col, "key").join(uniques.repartition(n), "key").select(id_col, "uid"), own


def _listed(uniques: DataFrame) -> DataFrame:
    return uniques.select("uid", "size", F.posexplode("bands").alias("band", "key"))


def met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs of rows of both sides that share ``(band, key)`` and whose sets are alike enough in size to reach the
    threshold, with their ``tile``; the columns of ``right`` but these get the prefix ``other_``.

    A bucket of more than TILE rows is cut into tiles by a hash, and a tile of the left meets each of the right under a
    key of its own, so no join key holds more than TILE rows of a side, whatever the bucket holds. Counts find the hot
    buckets; only they are listed, a row for TILE rows at most, and marked without a join on the bucket.
    """
    bucket = ["band", "key"]

    def hot(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*bucket).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name)).where(F.col(name) > 1)
        return broadcast_if_small(checkpoint(counts))

    ones, others = hot(left, "a"), hot(right, "b") if right is not left else None
    tiled = [df.join(ones, bucket, "left") for df in (left, right)]
    tiled = [df.withColumn("b", F.col("a")) if others is None else df.join(others, bucket, "left") for df in tiled]
    tiled = [df.na.fill(1, ["a", "b"]) for df in tiled]
    own = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    more = [c for c in right.columns if c not in bucket]
    ours = tiled[0].select(*left.columns, own("a").alias("i"), every("b").alias("j"))
    theirs = tiled[1].select(*bucket, *(F.col(c).alias(f"other_{c}") for c in more), every("a").alias("i"), own("b").alias("j"))
    alike = F.least("size", "other_size") >= F.greatest("size", "other_size") * threshold - 1e-9
    return ours.join(theirs, [*bucket, "i", "j"]).where(alike).withColumn("tile", F.xxhash64(*bucket, "i", "j"))


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair of ``met`` once, in the tile of its first band."""
    first = F.min(F.struct("band", "tile"))
    return pairs.groupBy(F.col("uid").alias("left"), F.col("other_uid").alias("right")).agg(first["tile"].alias("tile"))


def _with_hubs(uniques: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(shared, stars)``: ``(band, key, uid, size, hub)`` of the buckets that hold several texts, ``hub`` being the least,
    and each pair ``(left, right)`` of a hub and another text of its buckets once, if their sizes may be alike enough."""
    listed = _listed(uniques)
    n = int(uniques.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = listed.groupBy("band", "key").agg(F.min(F.struct("uid", F.col("size").alias("hub_size"))).alias("h"), F.count("*").alias("n"))
    hubs = hubs.where("n > 1").select("band", "key", F.col("h.uid").alias("hub"), "h.hub_size")
    shared = checkpoint(listed.join(hubs.repartition(n), ["band", "key"]))
    alike = F.least("size", "hub_size") >= F.greatest("size", "hub_size") * threshold - 1e-9
    stars = shared.where(alike).where("uid <> hub").select(F.col("hub").alias("left"), F.col("uid").alias("right")).distinct()
    return shared.drop("hub_size"), checkpoint(stars)


def _once_by_hub(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """Each pair of ``met`` within one table once, in a tile of the least hub of the buckets in which it meets.

    Buckets of one group mostly have the same hub, so a text goes to the tiles of few hubs and not to those of every band.
    A hub with more than TILE texts has a tile for each two parts of them, by a hash.
    """
    once = pairs.groupBy(F.col("uid").alias("left"), F.col("other_uid").alias("right")).agg(F.min("hub").alias("hub"))
    counts = stars.groupBy(F.col("left").alias("hub")).agg(F.ceil((F.count("*") + 1) / TILE).cast("int").alias("k")).where("k > 1")
    once = once.join(broadcast_if_small(checkpoint(counts)), "hub", "left")
    i, j = (F.pmod(F.xxhash64(c), F.coalesce("k", F.lit(1))) for c in ("left", "right"))
    return once.select("left", "right", F.xxhash64("hub", F.least(i, j), F.greatest(i, j)).alias("tile"))


def lsh_pairs(df: DataFrame, id_col: str, text_col: str = "text", threshold: float = 0.8, *, ngram: int = 5, num_perm: int = 128, seed: int = 0) -> DataFrame:
    """``(left, right, similarity)`` of all pairs of distinct normalized texts that share a band and reach the threshold.

    The result is as long as its pairs are many; ``linked_parts`` gives groups without listing the pairs inside them.
    """
    threshold = check_threshold(threshold)
    _, uniques = unique_sketches(df, id_col, text_col, threshold, ngram, num_perm, seed)
    shared, stars = _with_hubs(uniques, threshold)
    pairs = checkpoint(_once_by_hub(met(shared, shared, threshold).where("uid < other_uid"), stars))
    return verified(pairs, df, df, id_col, text_col, ngram, threshold, (uniques, uniques)).select("left", "right", "similarity")


def linked_parts(df: DataFrame, uniques: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float) -> DataFrame:
    """``(node, component)`` of the distinct texts that are linked to others, as all similar band pairs would link them.

    First every text of a bucket is compared with the bucket's least; then, in buckets that this has left in several
    parts, the texts of different parts with each other. Pairs inside one part are never listed.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared, stars = _with_hubs(uniques, threshold)
    known = uniques, uniques
    first = checkpoint(verified(checkpoint(starred(stars)), df, df, id_col, text_col, ngram, threshold, known).select("left", "right"))
    parts = checkpoint(connected_components(first))
    placed = shared.join(parts.repartition(n), F.col("uid") == F.col("node"), "left")
    placed = placed.select("band", "key", "uid", "size", "hub", F.coalesce("component", "uid").alias("part"))
    mixed = placed.groupBy("band", "key").agg((F.min("part") < F.max("part")).alias("mixed")).where("mixed").select("band", "key")
    placed = checkpoint(placed.join(mixed.repartition(n), ["band", "key"]))
    rest = met(placed, placed, threshold).where("uid < other_uid and part <> other_part")
    rest = checkpoint(_once_by_hub(rest, stars).join(stars, ["left", "right"], "left_anti"))
    more = checkpoint(verified(rest, df, df, id_col, text_col, ngram, threshold, known).select("left", "right"))
    return parts if more.isEmpty() else checkpoint(connected_components(first.unionByName(more)))


def _by_prefix(each: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """``(uid, other)`` of the sets ``(uid, size, h, at)`` that share a first n-gram at places with room for enough others."""
    other = others.select(F.col("uid").alias("other"), F.col("size").alias("other_size"), "h", F.col("at").alias("other_at"))
    alike = F.least("size", "other_size") >= F.greatest("size", "other_size") * threshold - 1e-9
    room = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))  # it and what comes behind it
    enough = room >= (F.col("size") + F.col("other_size")) * (threshold / (1 + threshold)) - 1e-6
    return each.join(other, "h").where(alike & enough)


class _Side:
    """Rows ``(uid, size, sketch, counted, sums)`` of one side of a tile: ids, sizes, ``counted`` as a table, sketches by length,
    in the order of cells of ``sums``, a quarter of the greatest set wide, and in them of sizes."""

    def __init__(self, rows: list):
        sums, sizes = np.array([r[4] if len(r) > 4 else [0] * DIRECTIONS for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        cells = sums // max(int(sizes.max()) // 4, 1)
        order = np.lexsort((sizes, *cells.T))
        rows, self.sums, cells = [rows[i] for i in order.tolist()], sums[order], cells[order]
        self.ends = np.flatnonzero((np.diff(cells, axis=0) != 0).any(1)) + 1  # where another cell begins
        self.uids = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.counted = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.words = np.array([len(r[2]) // 8 for r in rows])
        self.place, self.bits = np.zeros(len(rows), np.int64), {}
        for words in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == words)
            self.place[own] = np.arange(len(own))
            self.bits[words] = np.frombuffer(b"".join(rows[i][2] for i in own), np.uint64).reshape(-1, words)


def _differ(left: _Side, i: np.ndarray, right: _Side, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of each pair of places differ."""
    out = np.zeros(len(i), np.int64)
    for a, b in ((a, b) for a in left.bits for b in right.bits):
        own, n = np.flatnonzero((left.words[i] == a) & (right.words[j] == b)), min(a, b)
        step = max(STEP // (8 * max(a, b)), 1)
        for part in (own[at : at + step] for at in range(0, len(own), step)):
            x, y = left.bits[a][left.place[i[part]]], right.bits[b][right.place[j[part]]]
            out[part] = np.bitwise_count(folded(x, n) ^ folded(y, n)).sum(1, dtype=np.int64)
    return out


def _close(left: _Side, right: _Side | None, threshold: float, period: int, buckets: int):
    """Places ``(left, right)`` of each pair of two tiles, or of one, that may be similar by sizes, by sums, by ``waves`` and by
    sketches.

    Blocks whose sums or sizes are too far apart are passed over, as those of texts in two languages. Else one product of matrices says of all pairs of two blocks in how many n-grams they differ at least, less how many similar
    sets may; what that leaves over is compared by sketches.
    """
    limit = (1 - threshold) / (1 + threshold)
    scale, wide = wave(period), buckets * (1 if period == 2 else 2) + 2
    step, error = min(max(STEP // wide, 1), 1024), 0.01 + 3 * scale * buckets * wide * 2.0**-23  # of sums of single precision

    def blocks(side):
        """``(begin, end, least, most)`` of runs of one cell, the bounds being of sums and sizes."""
        values = np.column_stack([side.sums, side.sizes])
        for low, high in zip([0, *side.ends.tolist()], [*side.ends.tolist(), len(values)]):
            for at in range(low, high, step):
                own = values[at : min(at + step, high)]
                yield at, at + len(own), own.min(0), own.max(0)

    def rows(side, at, to, mine):
        out = np.empty((to - at, wide), np.float32)
        out[:, :-2] = waves(side.counted[at:to], period, buckets)
        own = limit * side.sizes[at:to]
        if mine:
            out[:, :-2] *= scale
            out[:, -2], out[:, -1] = own - scale * buckets, 1
        else:
            out[:, -2], out[:, -1] = 1, own
        return out

    one, right = right is None, left if right is None else right
    theirs = list(blocks(right))
    for at, end, least, most in blocks(left):
        a = rows(left, at, end, True)
        for to, other_end, other_least, other_most in theirs:
            apart = np.maximum(least[:-1] - other_most[:-1], other_least[:-1] - most[:-1])
            if one and to < at or (apart > (most[-1] + other_most[-1]) * limit + 1e-6).any():
                continue
            if most[-1] < other_least[-1] * threshold - 1e-9 or other_most[-1] < least[-1] * threshold - 1e-9:
                continue
            room = a @ rows(right, to, other_end, False).T
            i, j = np.divmod(np.flatnonzero(room.ravel() >= -error), room.shape[1])
            i, j = i + at, j + to
            m, n = left.sizes[i], right.sizes[j]
            good = np.minimum(m, n) >= np.maximum(m, n) * threshold - 1e-9
            i, j = (x[good & (i < j)] if one else x[good] for x in (i, j))
            good = _differ(left, i, right, j) <= (left.sizes[i] + right.sizes[j]) * limit + 1e-6
            yield i[good], j[good]


def _by_sketch(each: DataFrame, threshold: float, shapes: list[tuple[int, int]]) -> DataFrame:
    """``(a, b)`` of the sets ``(uid, size, class, sketch, counted, sums)`` whose sizes, counts and sketches are alike enough to reach
    the threshold.

    Classes of sizes are dealt into tiles of a bounded size; each two tiles of classes near enough are a task's, compared in
    the buckets of the lesser class. What is moved is the sketches, as often as there are tiles that they meet. Only counts
    of classes, of which there are some hundreds at most, reach the driver.
    """
    kind = each.schema["uid"].dataType.simpleString()
    counts = each.groupBy("class").agg(F.sum(F.octet_length("sketch") + F.octet_length(F.col("counted")[0])).alias("bytes"), F.count("*").alias("n")).collect()
    tiles = {r["class"]: max(-(-r["bytes"] // HELD), -(-r["n"] // MANY)) for r in counts}
    meet = [(c, other, tiles[c], tiles[other], *shape_of(shapes, min(c, other))) for c in tiles for other in range(c - 2, c + 3) if other in tiles]
    n = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(m[2] * m[3] for m in meet) // 4, 4000))
    meet = each.sparkSession.createDataFrame(meet, "class int, to int, own int, other int, period int, buckets int")
    rows = each.join(F.broadcast(meet), "class").withColumn("i", F.pmod(F.xxhash64("uid"), F.col("own")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    ends = [F.struct(F.col(c).alias("class"), F.col(i).alias("i")) for c, i in (("class", "i"), ("to", "j"))]
    tile = F.to_json(F.array(F.least(*ends), F.greatest(*ends)))
    counted = F.col("counted")[F.greatest(F.col("class") - F.col("to"), F.lit(0))].alias("counted")
    rows = rows.select(tile.alias("tile"), (ends[0] > ends[1]).cast("int").alias("what"), (ends[0] == ends[1]).alias("one"), "period", "buckets", "uid", "size", "sketch", counted, "sums")

    def run(batches):
        tile, one, shape, sides, type_ = None, False, (2, 0), ([], []), None

        def done():
            if sides[0] and (one or sides[1]):
                left, right = _Side(sides[0]), None if one else _Side(sides[1])
                for i, j in _close(left, right, threshold, *shape):
                    ends = ([side.uids[k] for k in at.tolist()] for side, at in ((left, i), (right or left, j)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, type_) for x in ends], names=["a", "b"])

        for batch in batches:
            type_ = batch.schema.field("uid").type
            for t, what, same, period, n, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "what", "one", "period", "buckets", "uid", "size", "sketch", "counted", "sums"))):
                if t != tile:
                    yield from done()
                    tile, one, shape, sides = t, same, (period, n), ([], [])
                sides[what].append(row)
        yield from done()

    return rows.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(run, f"a {kind}, b {kind}")


def _known_by(df: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float) -> tuple:
    """``directions`` and ``class_shapes`` by some texts of ``df``. They say how fast texts are told apart, by bounds that hold
    whatever they are, so they change no result."""
    some = df.where(F.pmod(F.xxhash64(id_col), F.lit(max(df.count() // SEEN, 1))) == 0).limit(2 * SEEN)
    found = shingle_sets(some, id_col, text_col, ngram).select(F.slice("shingles", 1, EACH).alias("h"), F.size("shingles").alias("n")).toArrow()
    sets, sizes = [_unsigned(h.values) for h in found.column("h")], found.column("n").to_pylist()
    return directions(sets), class_shapes(sets, sizes, threshold)


def _unsigned(h) -> np.ndarray:
    return np.sort(h.to_numpy().view(np.uint64))


def exact_pairs(df: DataFrame, id_col: str, text_col: str = "text", threshold: float = 0.8, *, ngram: int = 5) -> DataFrame:
    """``(left, right, n_shared, n_union, similarity)`` of all pairs of distinct normalized texts at the threshold, none
    missed: in any order of n-grams, similar sets share one of their first, as many as they may lack plus one.

    The order is by counts in buckets of a fixed number, which every task has. A text whose first ones are all in RARE texts
    at most is found by them: what is like it has one of them among its own first, at places that leave room for enough others.
    The rest, as in prose of few words, are compared with each other by counts in buckets and by sketches, of which a task
    holds two tiles of a bounded size; that is quadratic in the texts of a size. Texts are told apart by digest, so texts of one line repeated, which have
    the same set, are a pair.
    """
    threshold = check_threshold(threshold)
    counts = df.sparkSession.sparkContext.broadcast(ngram_counts(df, text_col, ngram))
    known_by = _known_by(df, id_col, text_col, ngram, threshold)
    made = profiles(df, id_col, text_col, ngram, threshold, counts, RARE, df.sparkSession.sparkContext.broadcast(known_by))
    first = written(made.groupBy("key").agg(F.min(F.struct(F.col(id_col).alias("uid"), "size", "prefix", "class", "sketch", "counted", "sums")).alias("x")).select("x.*"))
    listed = first.select("uid", "size", "sketch", F.explode("prefix").alias("p")).select("uid", "size", "sketch", "p.h", "p.at")
    rare = listed.where(F.col("sketch").isNull()).drop("sketch")
    met_ = rare.select("h").distinct()
    others = listed.drop("sketch").join(broadcast_if_small(checkpoint(met_)), "h", "left_semi")
    pairs = _by_prefix(rare, others, threshold).where("uid <> other").select(F.col("uid").alias("a"), F.col("other").alias("b"))
    pairs = pairs.unionByName(_by_sketch(first.where(F.col("sketch").isNotNull()).select("uid", "size", "class", "sketch", "counted", "sums"), threshold, known_by[1]))
    pairs = checkpoint(pairs.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct())
    return verified(checkpoint(_of_hubs(pairs)), df, df, id_col, text_col, ngram, threshold)


def find_cross_duplicates(
    train: DataFrame, test: DataFrame, id_col: str, text_col: str = "text", threshold: float = 0.8, *,
    ngram: int = 5, num_perm: int = 128, seed: int = 0, exact: bool = False,
) -> DataFrame:
    """``(train_id, test_id, similarity)``: one row for each test row that has a match in train.

    A train text equal after normalization comes first, with similarity 1 and its least id; else the most similar one,
    the least id among equals. ``exact`` compares by all n-grams instead of LSH bands and misses none.
    """
    threshold = check_threshold(threshold)
    bands, rows = (0, 0) if exact else lsh_bands(threshold, num_perm)
    num_perm = 1 if exact else num_perm  # no bands are needed
    made = {side: written(sketches(df, id_col, text_col, ngram, bands, rows, num_perm, seed)) for side, df in (("train", train), ("test", test))}
    return _matches(made, train, test, id_col, text_col, threshold, ngram, exact)


def split_duplicates(
    df: DataFrame, splits: list[DataFrame], id_col: str, text_col: str = "text", threshold: float = 0.8, *, ngram: int = 5, num_perm: int = 128, seed: int = 0
) -> list[DataFrame]:
    """What ``find_cross_duplicates`` finds between the rows of ``df`` that are ``train`` and ``test`` in each of ``splits``,
    tables ``(id_col, split)``. Texts are hashed, and a pair of them is compared, once for all splits; pairs that no split
    asks for are not compared."""
    threshold = check_threshold(threshold)
    rows, uniques = unique_sketches(df, id_col, text_col, threshold, ngram, num_perm, seed)
    spread = lambda x: x.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = [split.where(F.col("split").isin("train", "test")).select(id_col, F.lit(n).alias("n"), (F.col("split") == "train").alias("train")) for n, split in enumerate(splits)]
    placed = written(reduce(DataFrame.unionByName, placed).join(rows, id_col))
    ends = placed.groupBy("n", "uid").agg(F.min(F.when(F.col("train"), F.col(id_col))).alias("train_id"), F.count_if(~F.col("train")).alias("tests"))
    ends = written(ends)
    trains, pending = ends.where("train_id is not null").select("n", "uid", "train_id"), ends.where("train_id is null").select("n", "uid")
    best = ends.where("train_id is not null and tests > 0").select("n", "uid", "train_id", F.lit(1.0).alias("similarity"))
    if threshold < 1:
        shared, stars = _with_hubs(uniques, threshold)
        once = checkpoint(_once_by_hub(met(shared, shared, threshold).where("uid < other_uid"), stars))
        # A pair is asked for where one of it is in train and the other is not.
        sides = ends.groupBy("uid").agg(F.sort_array(F.collect_set(F.when(F.col("train_id").isNotNull(), F.col("n")))).alias("in"), F.sort_array(F.collect_set(F.when(F.col("train_id").isNull(), F.col("n")))).alias("out"))
        sides = checkpoint(sides)
        for end, other in (("left", "l"), ("right", "r")):
            once = once.join(spread(sides.select(F.col("uid").alias(end), F.col("in").alias(f"{other}_in"), F.col("out").alias(f"{other}_out"))), end)
        asked = checkpoint(once.where(F.arrays_overlap("l_in", "r_out") | F.arrays_overlap("l_out", "r_in")).select("left", "right", "tile"))
        near = verified(asked, df, df, id_col, text_col, ngram, threshold, (uniques, uniques)).select("left", "right", "similarity")
        near = checkpoint(near)
        near = near.select(F.col("left").alias("other"), F.col("right").alias("uid"), "similarity").union(near.select(F.col("right").alias("other"), F.col("left").alias("uid"), "similarity"))
        found = near.join(spread(pending), "uid").join(spread(trains.withColumnRenamed("uid", "other")), ["n", "other"])
        first = F.min(F.struct((-F.col("similarity")).alias("s"), "train_id"))
        best = best.unionByName(found.groupBy("n", "uid").agg(first.alias("b")).select("n", "uid", "b.train_id", (-F.col("b.s")).alias("similarity")))
    tests = placed.where(~F.col("train")).select("n", "uid", F.col(id_col).alias("test_id"))
    every = written(tests.join(spread(checkpoint(best)), ["n", "uid"]).select("n", "train_id", "test_id", "similarity"))
    return [every.where(F.col("n") == n).drop("n") for n in range(len(splits))]


def _matches(made: dict[str, DataFrame], train, test, id_col: str, text_col: str, threshold: float, ngram: int, exact: bool) -> DataFrame:
    """``find_cross_duplicates`` of two sides of sketches; ``train`` and ``test`` have their texts."""
    train_uid = checkpoint(made["train"].groupBy("key").agg(F.min(id_col).alias("train_id")))
    test_uid = checkpoint(made["test"].groupBy("key").agg(F.min(id_col).alias("test_uid")))
    same = test_uid.join(train_uid, "key").select("key", "train_id", F.lit(1.0).alias("similarity"))
    best = same
    if threshold < 1:
        pending = test_uid.join(train_uid, "key", "left_anti")
        left = written(train_uid.join(made["train"], "key").where(F.col(id_col) == F.col("train_id")).dropDuplicates(["key"]))
        right = written(pending.join(made["test"], "key").where(F.col(id_col) == F.col("test_uid")).dropDuplicates(["key"]))
        if exact:
            ends = (left.select(F.col("train_id").alias(id_col)), right.select(F.col("test_uid").alias(id_col)))
            near = _exact_cross(train, test, *ends, id_col, text_col, ngram, threshold)
        else:
            own = left.withColumnRenamed("train_id", "uid"), right.withColumnRenamed("test_uid", "uid")
            pairs = checkpoint(_once(met(*(checkpoint(_listed(x)) for x in own), threshold)))
            near = verified(pairs, train, test, id_col, text_col, ngram, threshold, own)
        first = near.groupBy("right").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "left")).alias("b"))
        near = right.join(first, right["test_uid"] == first["right"]).select("key", F.col("b.left").alias("train_id"), (-F.col("b.s")).alias("similarity"))
        best = same.unionByName(near)
    n = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made["test"].join(checkpoint(best).repartition(n), "key").select("train_id", F.col(id_col).alias("test_id"), "similarity")


def _exact_cross(train, test, left, right, id_col, text_col, ngram, threshold) -> DataFrame:
    """``(left, right, similarity)`` of all similar pairs of two sides. ``left`` and ``right`` name the texts to compare.

    A test side of up to INDEX n-grams is an index that every task has. A larger one meets train by the prefix filter, in
    the order of how many test texts have an n-gram: one that none has is first and isn't moved.
    """
    own = checkpoint(shingle_sets(test.join(right, id_col, "left_semi").dropDuplicates([id_col]), id_col, text_col, ngram))
    broadcast = test.sparkSession.sparkContext.broadcast
    if (own.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= INDEX:
        return indexed_matches(train, id_col, text_col, ngram, threshold, broadcast(ngram_index(own)), test.schema[id_col].dataType.simpleString())
    counts = broadcast(ngram_counts(test, text_col, ngram))
    a, b = (
        written(
            prefixes(df, id_col, text_col, ngram, threshold, counts, 0).join(ids, id_col, "left_semi").dropDuplicates([id_col])
            .select(F.col(id_col).alias("uid"), "size", F.explode("prefix").alias("p")).select("uid", "size", "p.h", "p.at")
        )
        for df, ids in ((train, left), (test, right))
    )
    pairs = _by_prefix(a, b, threshold).select(F.col("uid").alias("left"), F.col("other").alias("right")).distinct()
    pairs = checkpoint(starred(checkpoint(pairs)))
    return verified(pairs, train, test, id_col, text_col, ngram, threshold).select("left", "right", "similarity")


__all__ = ["exact_pairs", "find_cross_duplicates", "linked_parts", "lsh_pairs", "split_duplicates", "unique_sketches", "verified"]
