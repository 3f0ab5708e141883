"""Groups of rows that belong together: near-duplicate texts, shared keys, and unions of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from foldwright.functions.text import check_threshold
from foldwright.operators.components import connected_components
from foldwright.operators.pairs import linked_parts, unique_sketches
from foldwright.runtime import checkpoint


def renumbered(rows: DataFrame, id_col: str, label: str, out: str = "group_id") -> DataFrame:
    """``(id_col, out)``: groups numbered from 0 in the order of their least ids.

    Groups are ranked, not rows: ids are cut into ranges by a sample, each range counts its groups, and a running sum
    over the ranges says where each begins.
    """
    firsts = rows.groupBy(label).agg(F.min(id_col).alias("_first"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(firsts.repartitionByRange(n, "_first").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    begins = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_begin"))
    place = F.row_number().over(W.partitionBy("_range").orderBy("_first"))
    numbered = ranged.withColumn("_place", place).join(F.broadcast(begins), "_range")
    numbered = checkpoint(numbered.select(label, (F.col("_begin") + F.col("_place") - 1).cast("bigint").alias(out)))
    return rows.join(numbered.repartition(n), label).select(id_col, out)


def near_duplicate_groups(
    df: DataFrame, id_col: str, text_col: str = "text", threshold: float = 0.8, *, ngram: int = 5, num_perm: int = 128, seed: int = 0
) -> DataFrame:
    """``(id_col, group_id)``: near-duplicate texts share a group, numbered in the order of least ids.

    Texts equal after normalization always do, empty ones among them; others if a chain of pairs at the threshold
    connects them. At threshold 1 only equal texts do.
    """
    threshold = check_threshold(threshold)
    rows, uniques = unique_sketches(df, id_col, text_col, threshold, ngram, num_perm, seed)
    if threshold == 1:
        return renumbered(rows, id_col, "uid")
    parts = linked_parts(df, uniques, id_col, text_col, ngram, threshold)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = rows.join(parts.repartition(n), F.col("uid") == F.col("node"), "left")
    return renumbered(joined.select(id_col, F.coalesce("component", "uid").alias("_part")), id_col, "_part")


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating-point column."""
    null = F.col(column).isNull()
    return null | F.isnan(column) if isinstance(df.schema[column].dataType, (DoubleType, FloatType)) else null


def merge_groups(df: DataFrame, id_col: str, *labelings: str | None) -> DataFrame:
    """``(id_col, group_id)``: rows that share a value in any of the columns ``labelings`` are together, transitively.

    Null and NaN link nothing. ``None`` in place of a column is skipped; at least one column is needed.
    """
    present = [c for c in labelings if c is not None]
    if not present:
        raise ValueError("at least one grouping is needed")
    edges = []
    for column in present:
        own = df.where(~missing(df, column)).select(F.col(column).alias("_v"), F.col(id_col).alias("right"))
        firsts = own.groupBy("_v").agg(F.min("right").alias("left"), F.count("*").alias("_n")).where("_n > 1").select("_v", "left")
        edges.append(own.join(checkpoint(firsts), "_v").where("left <> right").select("left", "right"))
    parts = connected_components(reduce(DataFrame.union, edges))
    joined = df.join(parts, df[id_col] == parts["node"], "left")
    return renumbered(joined.select(id_col, F.coalesce("component", F.col(id_col)).alias("_part")), id_col, "_part")


def group_stats(groups: DataFrame, group_col: str = "group_id") -> DataFrame:
    """One row ``(n_rows, n_groups, largest, rows_shared)``, the last being rows in groups of more than one."""
    sizes = groups.groupBy(group_col).agg(F.count("*").alias("n"))
    shared = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"), F.count("*").alias("n_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"), shared.cast("bigint").alias("rows_shared"),
    )
