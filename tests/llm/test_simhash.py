import random

import numpy as np
import pytest
import xxhash

from foldwright.llm import simhash

from .fixtures import EDGES, edge_table, empty_table, prose


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d", prose(1, 300), "é É ß x y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(ids, fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for k, i in zip(label, ids):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in label]


def test_components_equal_brute_force_at_every_distance(spark):
    draw = random.Random(3)
    fps = []
    for _ in range(40):
        base = draw.getrandbits(64)
        fps.append(base)
        for distance in (1, 2, 3, 3, 4, 5):
            flip = sum(1 << b for b in draw.sample(range(64), distance))
            fps.append(base ^ flip)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in set(signed)], "fp bigint"))
    from foldwright.operators.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(links, "u", "v").collect()}
    want = brute_components(signed, fps)
    groups = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, set()).add(f)
    made = {}
    for f in set(signed):
        made.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, made.values()))


def test_large_bucket_is_dealt_out_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # one chain of near fingerprints
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    from foldwright.operators.components import connected_components

    parts = connected_components(links, "u", "v").select("component").distinct().count()
    assert parts == 1 and connected_components(links, "u", "v").count() == len(fps)


def test_edges(spark):
    rows = [tuple(r) for r in simhash.near_duplicates(edge_table(spark)).collect()]
    ids, fps = [r[0] for r in EDGES], [brute_fingerprint(r[1]) for r in EDGES]
    want = sorted(zip(ids, fps, brute_components(ids, fps)), key=str)
    assert sorted(((a, b % (1 << 64), c) for a, b, c in rows), key=str) == want
    assert simhash.near_duplicates(empty_table(spark)).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(edge_table(spark))
    assert kept.columns == edge_table(spark).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(1) == 1 and 5 not in ids and ids.count(None) == 1 and 2 in ids and 3 not in ids
    assert simhash.keep_one(empty_table(spark)).count() == 0


def test_keep_one_of_rows_with_null_and_repeated_ids(spark):
    a, b, c, e = (prose(500 + i, 60) for i in range(4))
    # id 1 stands for two texts; b and e have copies under other ids; c is only in rows without an id
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (None, a), (None, c), (None, c), (None, c.upper()), (4, e), (None, e)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in kept) == sorted([("1", a), ("1", b), ("None", c), ("4", e)])


def test_one_large_group_of_copies(spark):
    rows = [(i, prose(9, 50)) for i in range(500)] + [(1000 + i, prose(100 + i, 50)) for i in range(100)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.where("component_id = 0").count() == 500
    assert np.array_equal(sorted(r["component_id"] for r in got.where("doc_id >= 1000").collect()), list(range(1000, 1100)))


def test_query_equals_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash_near_dedup(spark, data).collect()}
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps))}


def test_columns_of_the_user_stay(spark):
    names = "unnamed name key row fp least part _null _name _key component_id".split()
    rows = [(1, "one two three four", *["kept"] * len(names)), (2, "one two three four", *["kept"] * len(names)), (None, prose(1, 40), *[None] * len(names))]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
