"""How well splits meet their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_summary(rows: DataFrame, split_col: str = "split") -> DataFrame:
    """``(split, n, share)`` for each split, and for ``(all)``."""
    named = rows.select(F.col(split_col).cast("string").alias("split"))
    counts = named.rollup("split").agg(F.count("*").alias("n"), F.grouping("split").alias("_all"))
    total = rows.agg(F.count("*").alias("_total"))  # one row
    named = counts.join(total, F.lit(True)).withColumn("split", F.when(F.col("_all") == 1, "(all)").otherwise(F.col("split")))
    return named.where("_total > 0").select("split", "n", (F.col("n") / F.col("_total")).alias("share"))


def label_shares(rows: DataFrame, split_col: str = "split", labels_col: str = "labels") -> DataFrame:
    """``(split, label, n, n_split, n_label, n_total)`` for every split and label, zero counts too.

    Splits and labels are few: a row for each pair of them is what a summary shows.
    """
    base = rows.select(F.col(split_col).cast("string").alias("split"), F.array_distinct(labels_col).alias("l"))
    splits = base.groupBy("split").agg(F.count("*").alias("n_split"))
    each = base.select("split", F.explode("l").alias("label")).groupBy("split", "label").agg(F.count("*").alias("n"))
    labels = each.groupBy("label").agg(F.sum("n").alias("n_label"))
    total = base.agg(F.count("*").alias("n_total"))
    grid = splits.join(labels, F.lit(True)).join(total, F.lit(True))
    return grid.join(each, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"), "n_split", "n_label", "n_total")


def label_table(rows: DataFrame, values: list[str], split_col: str = "split", labels_col: str = "labels") -> DataFrame:
    """A row for each split and ``(all)`` with the share of its rows that have each label of ``values``, one column each."""
    shares = label_shares(rows, split_col, labels_col)
    whole = shares.groupBy("label").agg(F.first("n_label").alias("n"), F.first("n_total").alias("of")).select(F.lit("(all)").alias("split"), "label", "n", "of")
    both = shares.select("split", "label", "n", F.col("n_split").alias("of")).unionByName(whole)
    return both.groupBy("split").pivot("label", values).agg(F.first(F.col("n") / F.greatest("of", F.lit(1))))


def label_gap(rows: DataFrame, split_col: str = "split", labels_col: str = "labels") -> DataFrame:
    """``(split, gap)``: the largest distance, in percentage points, of a label's share in a split from that in all rows."""
    gap = F.abs(F.col("n") / F.greatest("n_split", F.lit(1)) - F.col("n_label") / F.col("n_total")) * 100
    return label_shares(rows, split_col, labels_col).groupBy("split").agg(F.max(gap).alias("gap"))


def label_share_deviation(rows: DataFrame, split_col: str = "fold", labels_col: str = "labels") -> DataFrame:
    """One row ``(mean, worst, smallest, largest)``: relative deviation of label shares over splits and labels, and sizes."""
    shares = label_shares(rows, split_col, labels_col)
    whole = F.col("n_label") / F.col("n_total")
    off = F.abs(F.col("n") / F.greatest("n_split", F.lit(1)) - whole) / whole
    return shares.agg(F.avg(off).alias("mean"), F.max(off).alias("worst"), F.min("n_split").alias("smallest"), F.max("n_split").alias("largest"))
