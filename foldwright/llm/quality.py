"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition of the labelled rows sums its share of the normal equations;
the sums are added up and solved once. Cross-fitted scores are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, per_row, read
from foldwright.runtime import broadcast_if_small, written

#: Labelled rows that the model is fitted on, at most in expectation; more are thinned by a hash of the id.
FIT_ROWS = 20_000
#: Random features, kernel width in standard deviations of all statistics together, ridge penalty per row.
WIDTH, BANDWIDTH, PENALTY, SEED = 320, 4.0, 1e-3, 7
#: Partitions that the labelled rows are summed in, so that as many matrices reach the driver whatever the input.
SUMS = 16

_SENTENCE = re.compile(r"[.!?\n]+")
_MARKS = re.compile(r"[^\w\s]")
_ODD = re.compile(r"[^\w\s.,;:'\"!?()-]")
STATISTICS = (
    "log_chars", "log_words", "upper", "marks", "odd_marks", "digits", "exclamations", "word_length", "word_spread", "types",
    "top_word", "repeated_lines", "repeated_sentences", "short_words", "capitalised", "sentence_length", "repeated_triples",
    "marked_words", "line_length", "echoes",
)


def _repeated(items: list) -> float:
    """The share of items that occur more than once."""
    counts = Counter(items)
    return sum(n for n in counts.values() if n > 1) / len(items) if items else 0.0


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; null and empty texts have all zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, k = len(text), len(words)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    lengths = np.fromiter(map(len, words), np.float64, k)
    bare = [w.strip(".,;:!?").lower() for w in words]
    counts = Counter(bare)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    sentences = [x.strip().lower() for x in _SENTENCE.split(text) if x.strip()]
    marks = len(_MARKS.findall(text))
    odd = len(_ODD.findall(text))
    triples = list(zip(bare, bare[1:], bare[2:]))
    return [
        math.log1p(n), math.log1p(k), upper / letters, marks / n, math.sqrt(odd / n), sum(map(str.isdigit, text)) / n,
        math.sqrt(text.count("!") / n), min(lengths.mean(), 20.0), min(lengths.std(), 20.0), math.log1p(len(counts)) / math.log1p(k),
        counts.most_common(1)[0][1] / k, _repeated(lines), _repeated(sentences), float((lengths <= 3).mean()),
        sum(map(str.istitle, words)) / k, math.log1p(k / max(1, len(sentences))), _repeated(triples),
        sum(not w[-1].isalnum() for w in words) / k, math.log1p(n / max(1, len(lines))),
        sum(a == b for a, b in zip(bare, bare[1:])) / k,
    ]


@dataclass
class Model:
    """``centre`` and ``scale`` of the statistics, the random directions, ridge weights and calibration steps."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(features(rows, self.centre, self.scale) @ self.weights, self.knots, self.levels)


def features(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of statistics, with a constant."""
    draw = np.random.default_rng(SEED)
    directions = draw.normal(0, 1 / BANDWIDTH, (rows.shape[1], WIDTH))
    shifts = draw.uniform(0, 2 * np.pi, WIDTH)
    z = np.clip((rows - centre) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / WIDTH) * np.cos(z @ directions + shifts), np.ones((len(rows), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Calibration by pooling adjacent violators: knots and non-decreasing levels, drawn in a little from 0 and 1.

    ``y`` has the sum of labels at each ``x``, ``n`` how many there are, one each if not given.
    """
    n = np.ones(len(x)) if n is None else n
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, of x, count
    for a, b, c in zip(y[order], x[order], n[order]):
        pools.append([float(a), float(b * c), float(c)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    levels = np.array([(p[0] + 0.5) / (p[2] + 1) for p in pools])
    return np.array([p[1] / p[2] for p in pools]), np.maximum.accumulate(levels)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from; a null id has no labels and counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _fold(id_col: str):
    return (F.crc32(F.col(id_col).cast("string")) % 3).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(fold, y, statistics)`` of the rows to fit on. Ids with several labels count with their mean's side."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    n = known.count()
    share = min(1.0, FIT_ROWS / max(1, n))
    kept = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True))
    kept = kept.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = docs.select("doc_id", "text").join(broadcast_if_small(written(kept)), "doc_id").withColumn("fold", _fold("doc_id"))
    rows = rows.dropDuplicates(["doc_id", "text"])
    return written(per_row(rows, "text", ["fold", "y"], "s array<double>", lambda x: (statistics(x),)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model of the labelled documents outside the held-out third; a constant score where one class is missing."""
    rows = _labelled(docs, labels)
    totals = rows.select("y", F.posexplode("s").alias("k", "v")).groupBy("k")
    totals = totals.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"), F.avg("y").alias("y")).orderBy("k").collect()
    share = totals[0]["y"] if totals else 0.5
    if share in (0.0, 1.0) or not totals:
        return share
    centre, scale = np.array([r["m"] for r in totals]), np.array([max(r["d"], 1e-6) for r in totals])

    def sums(batches):
        parts = {f: [np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1), 0] for f in (0, 2)}
        for batch in batches:
            x = features(np.array(batch.column("s").to_pylist()), centre, scale)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f, part in parts.items():
                own = x[fold == f]
                part[0] += own.T @ own
                part[1] += own.T @ y[fold == f]
                part[2] += len(own)
        for f, (a, b, n) in parts.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    gathered = rows.repartition(SUMS).mapInArrow(sums, "fold int, a binary, b binary, n bigint").collect()
    added = {}
    for f in (0, 2):
        own = [r for r in gathered if r["fold"] == f]
        a = sum(np.frombuffer(r["a"]) for r in own).reshape(WIDTH + 1, WIDTH + 1)
        added[f] = (a, sum(np.frombuffer(r["b"]) for r in own), sum(r["n"] for r in own))

    def solve(a, b, n):
        return np.linalg.solve(a + PENALTY * max(n, 1) * np.eye(WIDTH + 1), b)

    both = solve(*(p + q for p, q in zip(added[0], added[2])))
    crossed = {0: solve(*added[2]), 2: solve(*added[0])}  # each fold is scored by the other's weights

    def cross(batches):
        for batch in batches:
            x, fold = features(np.array(batch.column("s").to_pylist()), centre, scale), batch.column("fold").to_numpy()
            raw = np.where(fold == 0, x @ crossed[0], x @ crossed[2])
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], names=["raw", "y"])

    # Four places from -9 to 9 are 180,001 values at most, whatever the number of rows.
    place = F.round(F.greatest(F.least("raw", F.lit(9.0)), F.lit(-9.0)), 4).alias("raw")
    raw = rows.mapInArrow(cross, "raw double, y double").groupBy(place).agg(F.sum("y").alias("y"), F.count("*").alias("n")).toPandas()
    knots, levels = isotonic(raw["raw"].to_numpy(), raw["y"].to_numpy(), raw["n"].to_numpy())
    return Model(centre, scale, both, knots, levels)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is, from 0 to 1, for every row whole and without a shuffle.

    Null and empty texts are scored like a text without words. Null ids, repeated rows and further columns pass through;
    the column named ``score`` is replaced. An empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch, texts in chunks(batches, text_col):
            if isinstance(model, Model):
                got = model.score(np.array([statistics(x) for x in texts]))
            else:
                got = np.full(len(texts), model)
            columns = [batch.column(f.name).cast(f.type) for f in list(arrow)[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.float64())], schema=arrow)

    return kept.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts: score 0.5 or more. Rows and columns stay as they are, one named ``score``
    among them; null and empty texts are judged like any other, repeated rows alike; an empty table gives none."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return score(rows, fit(docs, labels)).where("score >= 0.5").select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
