"""Leakage reports: test rows whose text is, or nearly is, in train."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.text import check_threshold
from foldwright.operators.pairs import find_cross_duplicates
from foldwright.runtime import checkpoint
from foldwright.sources.io import array_lines


def report(pairs: DataFrame, test: DataFrame, train: DataFrame, threshold: float) -> DataFrame:
    """One row ``(n_train, n_test, threshold, leaked, exact, fraction)``; ``exact`` counts similarity 1."""
    counts = pairs.agg(F.count("*").alias("leaked"), F.count_if(F.col("similarity") >= 1).alias("exact"))
    sizes = train.agg(F.count("*").alias("n_train")).join(test.agg(F.count("*").alias("n_test")), F.lit(True))  # one row each
    rows = sizes.join(counts, F.lit(True))
    share = F.when(F.col("n_test") > 0, F.col("leaked") / F.col("n_test")).otherwise(F.lit(0.0))
    return rows.select("n_train", "n_test", F.lit(threshold).alias("threshold"), "leaked", "exact", share.alias("fraction"))


def in_order(pairs: DataFrame) -> DataFrame:
    """``pairs`` by test id, over partitions and in each."""
    return pairs.repartitionByRange("test_id").sortWithinPartitions("test_id")


def report_lines(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(value)``: lines of text that are a report as JSON, all pairs in the order of test ids, similarities to four places.

    A line for each pair, so reports of any length are written or read by many tasks; the first line has the counts.
    """
    head = reports.select(F.to_json(F.struct("*"))).first()[0]  # one row of numbers
    each = F.struct(F.col("train_id").alias("train"), F.col("test_id").alias("test"), F.round("similarity", 4).alias("similarity"))
    return array_lines(in_order(pairs).select(F.to_json(each)), f'{head[:-1]},"pairs":[', "]}")


@dataclass(frozen=True)
class LeakageReport:
    """Counts of an audit, and its pairs as a DataFrame ``(train_id, test_id, similarity)``."""

    n_train: int
    n_test: int
    threshold: float
    leaked: int
    exact: int
    pairs: DataFrame

    @property
    def row(self) -> DataFrame:
        """One row ``(n_train, n_test, threshold, leaked, exact, fraction)``."""
        values = (self.n_train, self.n_test, self.threshold, self.leaked, self.exact, self.fraction)
        return self.pairs.sparkSession.createDataFrame([values], "n_train bigint, n_test bigint, threshold double, leaked bigint, exact bigint, fraction double")

    def lines(self) -> DataFrame:
        """The report as JSON, line by line, for reports of any length; ``sources.io.write_lines`` makes a file of them."""
        return report_lines(self.row, self.pairs)

    @property
    def fraction(self) -> float:
        return self.leaked / self.n_test if self.n_test else 0.0

    def to_dict(self) -> dict:
        """The report with its pairs as a list, for reports that a person reads; ``lines`` has the same for any length."""
        rows = in_order(self.pairs).toLocalIterator()
        pairs = [{"train": r["train_id"], "test": r["test_id"], "similarity": round(r["similarity"], 4)} for r in rows]
        return {
            "n_train": self.n_train, "n_test": self.n_test, "threshold": self.threshold, "leaked": self.leaked,
            "exact": self.exact, "fraction": self.fraction, "pairs": pairs,
        }


def leakage_report(train: DataFrame, test: DataFrame, id_col: str, text_col: str = "text", threshold: float = 0.8, *, ngram: int = 5, num_perm: int = 128) -> LeakageReport:
    """Audits ``test`` against ``train``; both are DataFrames with ``id_col`` and ``text_col``."""
    threshold = check_threshold(threshold)
    pairs = checkpoint(find_cross_duplicates(train, test, id_col, text_col, threshold, ngram=ngram, num_perm=num_perm))
    r = report(pairs, test, train, threshold).first()
    return LeakageReport(r["n_train"], r["n_test"], threshold, r["leaked"], r["exact"], pairs)


def examples(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pairs to show: those that aren't identical first, the most similar of them first, then by test id."""
    return pairs.orderBy(F.col("similarity") >= 1, F.desc("similarity"), "test_id").limit(max(0, n))


def by_split(df: DataFrame, split_col: str, names: str) -> DataFrame:
    """Rows whose split, as text, is one of the comma-separated ``names``; a null split is called ``None``."""
    return df.where(F.coalesce(F.col(split_col).cast("string"), F.lit("None")).isin([n.strip() for n in names.split(",")]))


def split_values(df: DataFrame, split_col: str) -> DataFrame:
    """``(value, n)`` of the split column as text."""
    value: Column = F.coalesce(F.col(split_col).cast("string"), F.lit("None")).alias("value")
    return df.groupBy(value).agg(F.count("*").alias("n"))


def sides(df: DataFrame, split_col: str, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the split column. A side without any row is an error that lists the values there are."""
    out = by_split(df, split_col, train), by_split(df, split_col, test)
    for names, side in zip((train, test), out):
        if side.isEmpty():
            seen = [r["value"] for r in split_values(df, split_col).orderBy("value").limit(20).collect()]
            raise ValueError(f"no rows with {split_col} in {names}; there are: {', '.join(seen) or 'none'}")
    return out


def label_conflicts(pairs: DataFrame, train: DataFrame, test: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Pairs whose two rows have different labels: ``(train_id, test_id, train_label, test_label)``; nulls are no label."""
    left = train.select(F.col(id_col).alias("train_id"), F.col(label_col).alias("train_label"))
    right = test.select(F.col(id_col).alias("test_id"), F.col(label_col).alias("test_label"))
    both = pairs.join(left, "train_id").join(right, "test_id")
    return both.where("train_label <> test_label").select("train_id", "test_id", "train_label", "test_label")
