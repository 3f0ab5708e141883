"""How the sources of a language differ in their terms, exactly, without a dense source-by-term table.

Each source of a language gives every kept term a share, its count smoothed, in billionths. Two sources differ by the sum
over all kept terms of the distance of their shares. A term that a source lacks has the source's zero share there, so the
sum falls into three parts: what only depends on one source's counts is priced from the histogram of those counts against
the other's zero share; terms that both lack cost the distance of the zero shares each; and terms that both have, which
the first part has counted twice, are corrected in a join of the postings that exist. The work grows with postings and
with pairs of sources, which are the result, and never with sources times terms.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, read
from foldwright.runtime import broadcast_if_small, checkpoint, written

#: Documents that a kept term occurs in; terms that a source's report lists; what each count is raised by; one, in shares.
LEAST, TOP, SMOOTH, ONE = 30, 50, 5, 1_000_000_000
#: Counts that a task holds before it sends them on; bytes of a text that are cut into terms at a time.
HELD, SLICE = 400_000, 4 << 20
#: Sources on one side of a key when pairs are made.
TILE = 256
#: Bytes as terms have them: letters A to Z in lower case, all else in ASCII but a to z a gap. Other bytes stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _cut(data: bytes):
    """The terms of a text that TERMS has been laid over, in lists of about SLICE bytes."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``docs``, which has ``lang``, ``source`` and ``text``: occurrences and documents.

    Counts are summed in the task until it holds more than ``held`` of them, so a combination may have several rows.
    """

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (counts, within) in groups.items():
                terms = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
                        pa.array([within[t] for t in terms], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        size = 0
        for batch, texts in chunks(batches, "text"):
            for key, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), texts):
                if key not in groups:
                    groups[key] = Counter(), Counter()
                counts, within = groups[key]
                seen: set[bytes] = set()
                before = len(counts)
                for terms in _cut(text.encode().translate(TERMS)):
                    counts.update(terms)
                    seen.update(terms)
                within.update(seen)
                size += len(counts) - before
                if size > held:
                    yield from sent()
                    size = 0
        yield from sent()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _share(count: str, total: str, terms: str) -> Column:
    """The smoothed share of a count in billionths, rounded down, plus one; in decimals, as products pass 64 bits."""
    whole = f"CAST({total} AS decimal(20, 0)) + {SMOOTH} * CAST({terms} AS decimal(18, 0))"
    return F.expr(f"1 + (CAST({count} + {SMOOTH} AS decimal(20, 0)) * CAST({ONE} AS decimal(10, 0))) div ({whole})")


def _between(low: str, high: str) -> Column:
    return F.abs(F.col(low) - F.col(high))


def divergence(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every language and source that occur.

    Part ``pair``: the other sources of the language and how far their shares are apart, all of them. Part ``term``: the
    ``top`` terms whose share in the source is furthest above the language's. Ranks count from 1 by falling value, then by
    item as UTF-8. Null texts, languages and sources are empty strings; repeated rows count as often as they stand there;
    a language without kept terms has pairs of value 0; an empty table gives nothing; other columns are ignored.
    """
    filled = lambda name, to: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(to)
    docs = docs.select(filled(lang_col, "lang"), filled(source_col, "source"), filled(text_col, "text"))
    # Postings of a term lie together, so kept terms and totals over the language need no further exchange.
    found = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = W.partitionBy("lang", "term")
    found = found.select("*", F.sum("docs").over(own).alias("within"), F.sum("n").over(own).alias("all"), F.row_number().over(own.orderBy("source")).alias("row"))
    kept = written(found.where(F.col("within") >= least).select("lang", "source", "term", "n", "all", (F.col("row") == 1).alias("first")))

    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(broadcast_if_small(checkpoint(langs)), "lang", "left")
    groups = groups.na.fill(0, ["terms", "lang_total", "total", "has"])
    groups = checkpoint(groups.withColumn("zero", F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(0)))

    priced = kept.join(broadcast_if_small(groups), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n", _share("n", "total", "terms").alias("p"), "zero", _share("all", "lang_total", "terms").alias("q"))
    priced = written(priced)

    listed = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    pairs = _pairs(groups, priced)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(listed)


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """``(lang, source, other, value)`` of all ordered pairs of sources of a language."""
    # A histogram has as many steps as a source has different counts: at most the root of twice its words.
    steps = priced.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count("*").alias("terms"))
    steps = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("steps"))
    none = F.array().cast("array<struct<p: bigint, terms: bigint>>")
    each = groups.join(steps, ["lang", "source"], "left").withColumn("steps", F.coalesce("steps", none))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    each = checkpoint(each.join(broadcast_if_small(checkpoint(tiles)), "lang"))

    left = each.select("lang", "source", "terms", "has", "zero", "steps", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"))
    more = [F.col(c).alias(f"other_{c}") for c in ("has", "zero", "steps")]
    right = each.select("lang", F.col("source").alias("other"), *more, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    both = left.join(right, ["lang", "tile"]).where("source < other")
    cost = lambda steps, zero: F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x["terms"] * F.abs(x["p"] - F.col(zero)))
    rest = (F.col("terms") - F.col("has") - F.col("other_has")) * _between("zero", "other_zero")
    apart = both.select("lang", "source", "other", (cost("steps", "other_zero") + cost("other_steps", "zero") + rest).alias("value"))

    postings = priced.select("lang", "term", "source", "p", "zero")
    others = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    shared = postings.join(others, ["lang", "term"]).where("source < other")
    twice = _between("p", "other_p") - _between("p", "other_zero") - _between("zero", "other_p") + _between("zero", "other_zero")
    shared = shared.groupBy("lang", "source", "other").agg(F.sum(twice).alias("shared"))
    value = (F.col("value") + F.coalesce("shared", F.lit(0).cast("bigint"))).alias("value")
    half = checkpoint(apart.join(shared, ["lang", "source", "other"], "left").select("lang", "source", "other", value))
    return half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
