"""Benchmark decontamination by spaced seeds.

A seed lays over some tokens and looks at part of them only, so a changed token under a hole of the seed changes nothing.
The hashes under each seed at every position of every text are joined with those of the benchmark; around each hit the
text and the item are laid over each other word by word and the best run of WINDOW words decides. Wherever the changes
lie that the decision admits, some seed misses them all, so no overlap goes without a hit. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import read
from foldwright.runtime import broadcast_if_small, written

#: Words of the stretch that decides, and the share of them that must agree in place.
WINDOW, SHARE = 13, 0.8
#: The seeds by the length of the stretch, WINDOW or a shorter item's length. Wherever in it as many words
#: are changed as SHARE admits, one of its seeds fits between them.
SEEDS = {
    13: ("11110111", "1110010111", "1100101001011"), 12: ("1111",), 11: ("11101",), 10: ("111",), 9: ("111011",), 8: ("1111",),
    7: ("11011",), 6: ("111",), 5: ("11",), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",),
}
#: Benchmark hashes, and places to compare, that may be broadcast: 24 bytes each.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-case words: runs of letters, marks and digits."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.transform(F.filter(F.split(flat, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def _listed(rows: DataFrame, keep: list[str], seeds: Sequence[str]) -> DataFrame:
    """``(*keep, at, seed)``: a row for each seed and each position (from 0) of the token hashes ``words`` with room for it."""
    least = min(map(len, seeds))
    room = rows.where(F.size("words") >= least)
    each = room.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    found = []
    for seed in seeds:
        seen = [F.get("words", F.col("at") + i) for i, bit in enumerate(seed) if bit == "1"]
        found.append(F.when(F.col("at") + len(seed) <= F.size("words"), F.xxhash64(F.lit(int(seed, 2)), *seen)))
    return each.select(*keep, "at", F.explode(F.array(*found)).alias("seed")).where("seed is not null")


def _best() -> Column:
    """The most words that agree in any ``n`` places in a row, with ``under`` laid over ``words`` from each of ``firsts``.
    One place is looked at after the other; an array of one names what a place has in common."""
    same = "transform(under, (w, i) -> if(first + i >= 0 and get(words, first + i) = w, 1, 0))"
    runs = "transform(sequence(1, size(same) - n + 1), i -> aggregate(slice(same, i, n), 0, (a, x) -> a + x))"
    return F.expr(f"aggregate(firsts, 0, (most, first) -> greatest(most, transform(array({same}), same -> array_max({runs}))[0]))")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(id_col, text_key, item_col, words, matched, similarity)``: each document and item that overlap, best place.

    ``words`` is the length of the stretch compared (WINDOW, or the item's length if shorter), ``matched`` how many of
    its words agree in place, ``similarity`` their share, at least SHARE; words beyond an end of the text don't agree.
    Short items count as well, those under five words only verbatim. Null and empty texts overlap nothing; rows with a
    null id are compared and reported with it, ``text_key`` (a hash of the text) telling them apart; repeated rows are
    reported once; other columns are ignored. An empty table on either side gives none.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    # Items are told apart by their id and words: ids may be null or repeated.
    items = written(items.dropDuplicates().withColumn("item_key", F.xxhash64("item", "words")))
    stretch = F.least(F.size("words"), F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.select(stretch).distinct().collect()) or [WINDOW]  # at most WINDOW values
    index = reduce(DataFrame.unionByName, (_listed(items.where(stretch == n), ["item_key"], SEEDS[n]) for n in lengths))
    index = index.select("seed", "item_key", F.col("at").alias("item_at"))
    known = broadcast_if_small(written(index.distinct()), BROADCAST_SEEDS)

    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("whole"))
    # A seed travels with the text's key and its place alone; where it hits, the item would begin at word "first".
    seeds = _listed(rows.select("text_key", tokens(F.col("whole")).alias("words")), ["text_key"], sorted({x for n in lengths for x in SEEDS[n]}))
    places = seeds.join(known, "seed").select("text_key", "item_key", (F.col("at") - F.col("item_at")).alias("first")).distinct()
    places = written(places)
    few = places.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    side = F.broadcast if few else (lambda df: df)

    # Back to the texts with hits: each is cut into words once and laid under each of its items at all of their places.
    hit = rows.join(side(places.select("text_key").distinct()), "text_key", "left_semi")
    hit = hit.select("id", "text_key", tokens(F.col("whole")).alias("words"))
    pairs = places.groupBy("text_key", "item_key").agg(F.collect_list("first").alias("firsts"))  # at most a text's words
    under = items.select("item_key", "item", F.col("words").alias("under"), stretch.alias("n"))
    laid = hit.join(side(pairs), "text_key").join(broadcast_if_small(under, BROADCAST_SEEDS // 50), "item_key")
    laid = laid.select("id", "text_key", "item", F.col("n").alias("words"), _best().alias("matched"))
    share = F.col("matched") / F.col("words")
    found = laid.where(share >= SHARE).groupBy("id", "text_key", "item").agg(F.max("words").alias("words"), F.max("matched").alias("matched"))
    return found.select(F.col("id").alias(id_col), "text_key", F.col("item").alias(item_col), "words", "matched", share.alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without those that overlap a benchmark item. Null and empty texts stay; rows with a null or repeated id
    are told apart by their texts; repeated rows go or stay together; with an empty table on either side nothing is
    dropped. Columns of any name stay as they are."""
    found = written(overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    found = broadcast_if_small(found)
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (key == found["_key"]), "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("words").cast("bigint"), F.col("matched").cast("bigint"), "similarity")
