"""Cross-entropy difference of two matched character n-gram models.

The background model counts all documents, the target model those that the labels call good. Both have the same order,
the same smoothing and one vocabulary, the characters of the whole corpus. Blocks of some megabytes list their distinct
n-grams; counts are added up over the corpus, both losses of each n-gram are worked out once and joined back to the
blocks that hold it, where each document adds up its tokens' loss differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, read
from foldwright.runtime import broadcast_if_small, written

#: Characters of text in one block; a longer text is a block of its own.
BLOCK = 4 << 20
#: Characters of context; three fit in 63 bits at 21 bits each. Texts begin with this many of START.
CONTEXT, START = 3, 2


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, one after another: the place of each token's n-gram in the list of distinct ones, in the order of
    their first tokens, and the contexts and characters of that list."""
    sizes = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(chr(START) * CONTEXT + x for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = np.zeros(len(codes), np.uint64)
    for i in range(CONTEXT):
        mixed[CONTEXT - i :] += codes[: len(codes) - CONTEXT + i]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed += codes
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    token = np.ones(len(codes), bool)
    begins = np.cumsum(sizes + CONTEXT) - sizes - CONTEXT
    for i in range(CONTEXT):
        token[begins + i] = False
    mixed = mixed[token]
    places, known = pd.factorize(mixed ^ (mixed >> np.uint64(31)))
    first = np.empty(len(known), np.int64)
    backwards = np.arange(len(places) - 1, -1, -1)
    first[places[backwards]] = backwards
    at = np.flatnonzero(token)[first]
    context = np.zeros(len(at), np.int64)
    for i in range(CONTEXT, 0, -1):
        context = context << 21 | codes[at - i]
    return places, context, codes[at].astype(np.int64)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each block: its distinct n-grams with their counts in all and in target documents, its documents' ids and
    lengths, and their texts packed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, text_col, BLOCK):
            sizes = [len(x) for x in texts]
            places, context, char = _grams(texts)
            good = np.repeat(np.array([bool(x) for x in batch.column("target").to_pylist()], bool), sizes)
            counts = (np.bincount(x, minlength=len(char)) for x in (places, places[good]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{k}"]),
                    pa.array([batch.column(id_col).to_pylist()], pa.list_(batch.column(id_col).type)),
                    pa.array([sizes], pa.list_(pa.int64())),
                    *(pa.array([x], pa.list_(pa.int64())) for x in (context, char, *counts)),
                    pa.array([zstandard.compress("".join(texts).encode("utf-8", "surrogatepass"), 3)], pa.binary()),
                ],
                names=["block", "docs", "sizes", "context", "char", "n", "n_target", "texts"],
            )
            k += 1

    schema = (
        f"block string, docs array<{kind}>, sizes array<bigint>, context array<bigint>, char array<bigint>, n array<bigint>, "
        "n_target array<bigint>, texts binary"
    )
    return docs.select(id_col, text_col, "target").mapInArrow(run, schema)


def losses(grams: DataFrame) -> DataFrame:
    """``(context, char, target, background)``: both models' losses in nats of each n-gram of ``(context, char, n,
    n_target)``, by Witten-Bell mixing with the characters' own shares."""
    counts = grams.groupBy("context", "char").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    # One row for each character there is, 1,114,112 at most whatever the input.
    chars = counts.groupBy("char").agg(F.sum("n").alias("c"), F.sum("n_target").alias("c_target"))
    chars = written(chars)
    total = chars.agg(F.sum("c").alias("c"), F.sum("c_target").alias("t"), F.count("*").alias("v")).first()
    size = total["v"] + 1
    share = lambda c, n: (F.col(c) + 1) / F.lit(float((n or 0) + size))
    alone = chars.select("char", share("c", total["c"]).alias("p"), share("c_target", total["t"]).alias("p_target"))
    near = W.partitionBy("context")  # at most one row for each character
    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).over(near)
    counts = counts.select(
        "*", F.sum("n").over(near).alias("h"), F.sum("n_target").over(near).alias("h_target"), seen("n").alias("t"), seen("n_target").alias("t_target")
    ).join(F.broadcast(alone), "char")
    loss = lambda n, h, t, p: -F.log(F.when(F.col(h) > 0, (F.col(n) + F.col(t) * F.col(p)) / (F.col(h) + F.col(t))).otherwise(F.col(p)))
    return counts.select(
        "context", "char", loss("n_target", "h_target", "t_target", "p_target").alias("target"), loss("n", "h", "t", "p").alias("background")
    )


def score(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, loss_target, loss_background, difference)`` for each row: mean losses in nats a character.

    ``good`` has the ids of target documents; the lower the difference, the more a text is like them. Null and empty
    texts have no tokens and zeros. Rows with a null id are scored and count as background only; repeated rows count and
    are scored each; an empty table gives none; other columns are ignored.
    """
    marks = written(good.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()).withColumn("target", F.lit(True))
    flagged = docs.select(id_col, text_col).join(broadcast_if_small(marks), id_col, "left")
    blocks = written(_blocks(flagged, id_col, text_col))
    listed = blocks.select("block", F.posexplode(F.arrays_zip("context", "char", "n", "n_target")).alias("place", "g"))
    listed = listed.select("block", "place", "g.context", "g.char", "g.n", "g.n_target")
    known = written(losses(listed.select("context", "char", "n", "n_target")))
    back = listed.select(F.col("block").alias("of"), "place", "context", "char").join(known, ["context", "char"])
    back = back.select("of", "place", "target", "background")
    kind = docs.schema[id_col].dataType.simpleString()

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("place")
        made = []
        for row in left.to_pylist():
            text, sizes = zstandard.decompress(row["texts"]).decode("utf-8", "surrogatepass"), np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            places, _, char = _grams([text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())])
            if len(char) != len(right):
                raise ValueError(f"block {row['block']}: {len(right)} of {len(char)} n-grams came back")
            out = []
            for column in ("target", "background"):
                sums, full = np.zeros(len(sizes)), sizes > 0
                if len(places):
                    sums[full] = np.add.reduceat(right.column(column).to_numpy()[places], (ends - sizes)[full])
                out.append(sums / np.maximum(sizes, 1))
            ids = pa.array(row["docs"], left.schema.field("docs").type.value_type)
            made.append(
                pa.table(
                    {id_col: ids, "n_tokens": sizes, "loss_target": out[0], "loss_background": out[1], "difference": out[0] - out[1]}
                )
            )
        return pa.concat_tables(made)

    schema = f"`{id_col}` {kind}, n_tokens bigint, loss_target double, loss_background double, difference double"
    waiting = blocks.select("block", "docs", "sizes", "texts")
    return waiting.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(add_up, schema)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target documents are those that ``labels`` calls good and not toxic. Losses are given to nine places."""
    good = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    scored = score(read(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 9).alias(c) for c in ("loss_target", "loss_background", "difference")))
