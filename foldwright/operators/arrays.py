"""Folds over plain arrays, for tools that take a splitter with ``split(X, y, groups)`` and ``get_n_splits()``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import KW_ONLY, dataclass

import numpy as np
from pyspark.sql import SparkSession

from foldwright.operators.folds import NearDupKFold
from foldwright.sources.io import from_values


def label_lists(y) -> list[list[str]]:
    """The labels of each row: of a one-dimensional array one each, of an indicator matrix the numbers of the columns
    that aren't zero, of lists or sets their items. Missing values are no label. A mixture is a TypeError."""
    if hasattr(y, "toarray"):
        y = y.toarray()
    matrix = np.asarray(y) if getattr(y, "ndim", 1) == 2 else None
    if matrix is not None:
        return [[str(k) for k in np.flatnonzero(row)] for row in matrix]
    rows = y.tolist() if hasattr(y, "tolist") else list(y)
    nested = [isinstance(x, (list, tuple, set, frozenset, np.ndarray)) for x in rows]
    if any(nested) and not all(nested):
        raise TypeError("labels are either one value a row or a list a row")
    missing = lambda x: x is None or x == "" or x != x
    return [sorted({str(v) for v in (x if many else [x]) if not missing(v)}) for x, many in zip(rows, nested)]


@dataclass
class ArrayKFold:
    """``split(X, y, groups)`` gives arrays of row numbers, so that it can be passed as ``cv``.

    ``texts`` are compared instead of X, where X holds features. The arrays are in the driver's memory by nature; tables
    belong to ``NearDupKFold``.
    """

    n_splits: int = 5
    _: KW_ONLY
    threshold: float = 0.8
    texts: Sequence[str] | None = None
    stratify: bool = True
    ngram: int = 5
    num_perm: int = 128
    random_state: int = 0

    def __post_init__(self):
        self._folds()

    def _folds(self) -> NearDupKFold:
        return NearDupKFold(self.n_splits, threshold=self.threshold, stratify=self.stratify, ngram=self.ngram, num_perm=self.num_perm, seed=self.random_state)

    def get_n_splits(self, X=None, y=None, groups=None) -> int:
        return self.n_splits

    def fold_ids(self, X=None, y=None, groups=None) -> np.ndarray:
        """The fold of each row, from 0."""
        spark = SparkSession.builder.getOrCreate()
        df = from_values(spark, X if self.texts is None else self.texts)
        n = df.count()
        sides = {"X": X, "y": y, "groups": groups}
        for name, values in sides.items():
            if values is not None and (values.shape[0] if hasattr(values, "shape") else len(values)) != n:
                raise ValueError(f"{name} and the texts differ in length")
        labels = label_lists(y) if y is not None and self.stratify else [[]] * n
        keys = [None if g is None or g != g else str(g) for g in (groups if groups is not None else [None] * n)]
        more = spark.createDataFrame(list(zip(range(n), labels, keys)), "row_id bigint, labels array<string>, key string")
        columns = {"label_cols": ("labels",) if any(labels) else (), "groups_col": "key" if groups is not None else None}
        found = self._folds().fold_ids(df.join(more, "row_id"), "row_id", **columns)
        out = np.empty(n, np.int64)
        for r in found.toLocalIterator():
            out[r["row_id"]] = r["fold"]
        return out

    def split(self, X=None, y=None, groups=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(train, test)`` row numbers of each fold."""
        folds = self.fold_ids(X, y, groups)
        for k in range(self.n_splits):
            yield np.flatnonzero(folds != k), np.flatnonzero(folds == k)
