import math
from collections import Counter

from foldwright.llm import lm

from .fixtures import EDGES, edge_table, empty_table


def brute(docs, good):
    models = []
    texts = [t or "" for _, t in docs]
    size = len(set("".join(texts))) + 1
    for keep in (lambda i: i in good, lambda i: True):
        grams, heads, kinds, chars = Counter(), Counter(), Counter(), Counter()
        for i, t in docs:
            if keep(i):
                s = "\x02" * 3 + (t or "")
                grams.update(s[k - 3 : k + 1] for k in range(3, len(s)))
        for g, n in grams.items():
            heads[g[:3]] += n
            kinds[g[:3]] += 1
            chars[g[3]] += n
        models.append((grams, heads, kinds, chars, sum(chars.values())))

    def loss(m, g):
        grams, heads, kinds, chars, total = m
        p = (chars[g[3]] + 1) / (total + size)
        return -math.log((grams[g] + kinds[g[:3]] * p) / (heads[g[:3]] + kinds[g[:3]]) if heads[g[:3]] else p)

    out = []
    for i, t in docs:
        s = "\x02" * 3 + (t or "")
        gs = [s[k - 3 : k + 1] for k in range(3, len(s))]
        a, b = (sum(loss(m, g) for g in gs) / max(1, len(gs)) for m in models)
        out.append((str(i), len(gs), round(a, 8), round(b, 8), round(a - b, 8)))
    return sorted(out)


def listed(df, id_col="doc_id"):
    return sorted((str(r[id_col]), r["n_tokens"], *(round(r[c], 8) for c in ("loss_target", "loss_background", "difference"))) for r in df.collect())


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and all(abs(x - y) < 1e-6 for x, y in zip(a[2:], b[2:])), (a, b)


def test_edges_equal_brute_force(spark):
    docs = [(i, t) for i, t, _ in EDGES]
    good = spark.createDataFrame([(1,), (7,), (7,), (None,), (99,)], "doc_id bigint")
    close(listed(lm.score(edge_table(spark), good)), brute(docs, {1, 7, 99}))
    close(listed(lm.score(edge_table(spark), good.limit(0))), brute(docs, set()))
    assert lm.score(empty_table(spark), good).count() == 0


def test_query_equals_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] == 0}
    got = lm.op7_lm_scoring(spark, data)
    close(listed(got), brute(docs, good))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    mean = {y: [r["difference"] for r in got.collect() if labels.get(r["doc_id"]) == y] for y in (0, 1)}
    assert sum(mean[1]) / len(mean[1]) < sum(mean[0]) / len(mean[0])
