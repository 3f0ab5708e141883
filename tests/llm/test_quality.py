import zlib

import numpy as np
from pyspark.sql import functions as F

from foldwright.llm import quality as q

from .fixtures import EDGES, edge_table, empty_table


def test_isotonic_equals_brute_force():
    draw = np.random.default_rng(0)
    x = np.round(draw.normal(size=60), 1)
    y = (draw.random(60) < 1 / (1 + np.exp(-x))).astype(float)
    knots, levels = q.isotonic(x, y)
    assert np.all(np.diff(knots) > 0) and np.all(np.diff(levels) >= 0) and levels.min() > 0 and levels.max() < 1
    # Pools are those of the max-min formula for isotonic means.
    order = np.argsort(x, kind="stable")
    s = y[order]
    fit = [max(min(s[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert len(knots) == len(np.unique(np.round(fit, 12)))


def test_sums_by_partition_equal_one_solution(spark):
    """Ridge weights from partition sums against numpy on all rows."""
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(120):
        good = i % 3 != 0
        rows.append((i, " ".join("word%d" % draw.integers(200) for _ in range(60)) if good else "BAD!! " * int(draw.integers(5, 60))))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = q.fit(docs, known)
    train = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    s = np.array([q.statistics(t) for t, _ in train])
    x = q.features(s, s.mean(0), np.maximum(s.std(0), 1e-6))
    want = np.linalg.solve(x.T @ x + q.PENALTY * len(x) * np.eye(x.shape[1]), x.T @ np.array([float(y) for _, y in train]))
    assert np.allclose(model.weights, want, atol=1e-6)
    got = {r["doc_id"]: r["score"] for r in q.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.95


def test_labels_of_the_held_out_third_are_never_used(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.fit(docs, labels), q.fit(docs, flipped)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_edges(spark, data):
    model = q.fit(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels")))
    got = q.score(edge_table(spark), model)
    assert got.columns == [*(c for c in edge_table(spark).columns if c != "score"), "score"]
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 6)}) == 1
    assert q.score(empty_table(spark), model).count() == 0


def test_missing_classes_give_a_constant(spark):
    docs = edge_table(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert q.fit(docs, none) == 0.5
    ones = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 5, 6, 7, 8)] + [(None, 0), (8, None)], "doc_id bigint, quality int")
    assert q.fit(docs, ones) == 1.0
    assert {r["score"] for r in q.score(docs, 1.0).collect()} == {1.0}


def test_columns_of_the_user_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    more = docs.select("*", *(F.lit("kept").alias(c) for c in ("score", "row", "fold", "y", "s")))
    kept = q.keep_good(more, labels)
    assert kept.columns == more.columns and {tuple(r)[-5:] for r in kept.collect()} == {("kept",) * 5}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in q.keep_good(docs, labels).collect()}
    held = spark.createDataFrame([(None,), (1,)], "doc_id bigint").select(q.held_out().alias("h")).collect()
    assert all(r["h"] in (True, False) for r in held)


def test_repeated_ids_weigh_once(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    a, b = q.fit(docs, labels), q.fit(docs.union(docs).union(docs), labels.union(labels))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_isotonic_of_sums_equals_brute_force():
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=200), 1)
    y = (draw.random(200) < 1 / (1 + np.exp(-x))).astype(float)
    at, of = np.unique(x, return_inverse=True)
    sums, n = np.bincount(of, y), np.bincount(of)
    knots, levels = q.isotonic(at, sums, n)
    mean = lambda i, j: sums[i : j + 1].sum() / n[i : j + 1].sum()
    fit = np.array([max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])
    want = []
    for level in np.unique(np.round(fit, 12)):
        own = np.round(fit, 12) == level
        want.append(((at * n)[own].sum() / n[own].sum(), (sums[own].sum() + 0.5) / (n[own].sum() + 1)))
    assert np.allclose(knots, [w[0] for w in want]) and np.allclose(levels, np.maximum.accumulate([w[1] for w in want]))


def test_query_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in q.op6_quality_classifier(spark, data).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    test = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert np.mean([p == y for p, y in test]) >= 0.97
    assert np.mean([p for p, y in test if y == 1]) >= 0.97
