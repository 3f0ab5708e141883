"""Labels as one array of strings for each row, their counts, and group keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StringType, StructType


def text_of(df: DataFrame, column: str) -> Column:
    """A value as text: structs, arrays and maps as JSON, a map's entries in the order of their keys; others cast."""
    kind = df.schema[column].dataType
    if isinstance(kind, MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
    return F.to_json(column) if isinstance(kind, (StructType, MapType, ArrayType)) else F.col(column).cast("string")


def label_sets(df: DataFrame, *columns: str, indicator: bool = False) -> Column:
    """The labels of a row: of a scalar column one, of an array column its items; null, NaN and "" are no label.

    Several columns with ``indicator`` are 0/1 flags: the names of the nonzero ones are the labels.
    """
    if indicator:
        return F.filter(F.array(*[F.when(F.coalesce(F.col(c) != 0, F.lit(False)), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    if len(columns) != 1:
        raise ValueError("give one column of labels, or several with indicator=True")
    kind = df.schema[columns[0]].dataType
    if isinstance(kind, ArrayType):
        nested = isinstance(kind.elementType, (StructType, MapType, ArrayType))
        items = F.transform(columns[0], lambda x: F.to_json(x) if nested else x.cast("string"))
        return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (x != "NaN") if isinstance(kind.elementType, (DoubleType, FloatType)) else x.isNotNull()), F.array().cast("array<string>"))
    value = text_of(df, columns[0])
    empty = value.isNull() | (value == "") if isinstance(kind, StringType) else value.isNull()
    if isinstance(kind, (DoubleType, FloatType)):
        empty = empty | F.isnan(columns[0])
    return F.when(empty, F.array().cast("array<string>")).otherwise(F.array(value))


def group_key(df: DataFrame, column: str) -> Column:
    """A key for ``merge_groups``: null for null, NaN and "", JSON for nested values, else text."""
    kind, value = df.schema[column].dataType, text_of(df, column)
    lost = value.isNull() | (value == "")
    if isinstance(kind, (DoubleType, FloatType)):
        lost = lost | F.isnan(column)
    return F.when(~lost, value)


def group_label_counts(rows: DataFrame, group_col: str = "group_id", labels_col: str = "labels") -> DataFrame:
    """``(group_col, label, n)``; a label repeated in one row counts once."""
    each = rows.select(group_col, F.explode(F.array_distinct(labels_col)).alias("label"))
    return each.groupBy(group_col, "label").agg(F.count("*").alias("n"))


def label_totals(rows: DataFrame, labels_col: str = "labels") -> DataFrame:
    """``(label, total)``."""
    return rows.select(F.explode(F.array_distinct(labels_col)).alias("label")).groupBy("label").agg(F.count("*").alias("total"))


def group_rarity(rows: DataFrame, group_col: str = "group_id", labels_col: str = "labels") -> DataFrame:
    """``(group_col, rarity)``: the largest share of any label's rows that a group holds; 0 without labels."""
    shares = group_label_counts(rows, group_col, labels_col).join(label_totals(rows, labels_col), "label")
    best = shares.groupBy(group_col).agg(F.max(F.col("n") / F.col("total")).alias("rarity"))
    return rows.select(group_col).distinct().join(best, group_col, "left").select(group_col, F.coalesce("rarity", F.lit(0.0)).alias("rarity"))
