import itertools
import random
import re
import time

import duckdb
import pandas as pd

from foldwright.llm import decontaminate as d
from foldwright.llm import oracle

from .fixtures import EDGES, edge_table, empty_table, prose


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def brute(docs, items):
    """Every place of every item over every text: the best run of WINDOW words in place."""
    out = {}
    for i, text in docs:
        w = words(text)
        for k, item in items:
            v = words(item)
            n = min(len(v), d.WINDOW)
            for first in range(-len(v) + 1, len(w)) if set(v) & set(w) else []:
                same = [0 <= first + j < len(w) and w[first + j] == v[j] for j in range(len(v))]
                best = max(sum(same[j : j + n]) for j in range(len(v) - n + 1))
                if best / n >= d.SHARE and (n, best) > out.get((i, k), (0, 0)):
                    out[i, k] = n, best
    return {key: best for key, (_, best) in out.items()}


def planted():
    items = [(k, prose(1000 + k, 20 + 3 * k)) for k in range(8)] + [(90, "too short"), (91, None), (92, prose(1000, 20))]
    draw = random.Random(4)
    docs = [(i, prose(i, 120)) for i in range(20)]
    for i, (k, every) in enumerate([(0, 0), (1, 5), (2, 6), (3, 7), (4, 9), (5, 4), (6, 3), (7, 11)]):
        passage = words(items[k][1])
        if every:
            passage = [f"x{draw.random()}".replace(".", "") if j % every == every - 1 else w for j, w in enumerate(passage)]
        docs.append((100 + i, f"{prose(200 + i, 30)}, {' '.join(passage).upper()}! {prose(300 + i, 30)}"))
    part = words(items[7][1])
    docs += [(200, " ".join(part[5:25])), (201, " ".join(part[:9])), (202, " ".join([*part[:20], "added", *part[20:]])), (203, " ".join(part))]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = planted()
    got = d.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in got.collect()}
    assert got == brute(docs, items)
    caught = {i for i, _ in got}
    assert {100, 101, 102, 103, 104, 107, 200, 202, 203} <= caught  # a change in every fifth word or rarer
    assert not caught & set(range(20)) and 106 not in caught and 201 not in caught


def test_some_seed_misses_all_admitted_changes():
    for n in range(1, d.WINDOW + 1):
        changes = n - next(k for k in range(n + 1) if k / n >= d.SHARE)
        laid = [{at + i for i, bit in enumerate(s) if bit == "1"} for s in d.SEEDS[n] for at in range(n - len(s) + 1)]
        assert all(any(not x & set(c) for x in laid) for c in itertools.combinations(range(n), changes))


def test_finds_what_the_rule_finds_without_masks(spark):
    """Items of 1 to 16 words, copied, changed in every pair of places, and cut by an end of the text."""
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, 17)] + [(17, None), (18, "...")]
    docs = []
    for n, item in items[:16]:
        v = item.split()
        for a, b in itertools.combinations_with_replacement(range(n), 2):
            docs.append(f"{prose(n, 5)} {' '.join('new' if j in (a, b) else w for j, w in enumerate(v))} {prose(a, 4)}")
        docs += [item, " ".join(v[1:]), " ".join(v[:-2]), f"before {' '.join(v[:-1])}", " ".join(v[:9]), f"{prose(1, 20)} {' '.join(v[:11])}"]
    docs = list(enumerate(docs))
    want = {}
    for i, text in docs:
        w = words(text)
        for k, item in items:
            v = words(item)
            n = min(len(v), 13)
            for first in range(-len(v) + 1, len(w)) if v else []:
                same = [0 <= first + j < len(w) and w[first + j] == v[j] for j in range(len(v))]
                best = max(sum(same[j : j + n]) for j in range(len(v) - n + 1))
                if best / n >= 0.8 and best > want.get((i, k), (0, 0))[1]:
                    want[i, k] = (n, best)
    got = d.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["words"], r["matched"]) for r in got.collect()} == want
    assert {k for _, k in want} == set(range(1, 17)) and sum(k == 13 and n[1] == 11 for (_, k), n in want.items()) >= 78


def test_large_tables_take_the_same_way_without_a_broadcast(spark, monkeypatch):
    docs, items = planted()
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    got = d.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in got.collect()} == brute(docs, items)


def test_a_long_text_takes_linear_time_without_a_broadcast(spark, monkeypatch):
    item = prose(3, 30)
    long = f"{prose(1, 10_000, 10**6)} {item} {prose(2, 10_000, 10**6)}"
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    docs, items = spark.createDataFrame([(1, long)], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    d.overlaps(docs.limit(0), items).collect()
    start = time.time()
    assert [(r["doc_id"], r["matched"]) for r in d.overlaps(docs, items).collect()] == [(1, 13)]
    assert time.time() - start < 20


def test_oracle_counts_the_same_without_seeds(spark):
    docs, items = planted()
    frames = {"documents": pd.DataFrame(docs, columns=["doc_id", "text"]), "benchmark": pd.DataFrame(items, columns=["item_id", "text"])}
    with duckdb.connect() as base:
        for name, frame in frames.items():
            base.register(name, frame)
        rows = base.sql(oracle.ORACLE["op9_benchmark_decontamination"]).fetchall()
    assert {(r[0], r[1]): r[3] for r in rows} == brute(docs, items)


def test_edges(spark):
    items = spark.createDataFrame([(1, prose(3, 30)), (None, "long " * 30)], "item_id bigint, text string")
    got = d.overlaps(edge_table(spark), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(8, None)]
    assert d.overlaps(empty_table(spark), items).count() == 0
    assert d.overlaps(edge_table(spark), items.limit(0)).count() == 0
    kept = d.clean(edge_table(spark), items)
    assert kept.columns == edge_table(spark).columns and kept.count() == len(EDGES) - 1
    assert d.clean(empty_table(spark), items).count() == 0


def test_a_null_id_is_told_apart_by_its_text(spark):
    passage = prose(3, 30)
    docs = spark.createDataFrame([(None, passage), (None, "clean"), (1, "clean"), (1, passage)], "doc_id bigint, text string")
    kept = d.clean(docs, spark.createDataFrame([(1, passage)], "item_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "clean"), ("None", "clean")]


def test_query_finds_every_long_passage(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = set()
    grams = {}
    for k, item in items:
        v = words(item)
        for j in range(len(v) - 12):
            grams.setdefault(tuple(v[j : j + 13]), set()).add(k)
    for i, text in docs:
        w = words(text)
        for j in range(len(w) - 12):
            want |= {(i, k) for k in grams.get(tuple(w[j : j + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in d.op9_benchmark_decontamination(spark, data).collect()}
    assert want and want <= got


def test_main_path_has_no_python(spark, data):
    found = d.overlaps(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet"))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().optimizedPlan().toString())
