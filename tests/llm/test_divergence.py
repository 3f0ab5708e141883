import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwright.llm import divergence as v

from .fixtures import edge_table, empty_table


def _by_hand(rows, least, top=50):
    """Densely and in Python's integers: ``rows`` are (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, within, out = {}, {}, []
    for lang, source, text in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        within.setdefault(lang or "", Counter()).update(set(terms))
    for lang, sources in counts.items():
        kept = [t for t, n in within[lang].items() if n >= least]
        whole = sum(sources.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def _got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def _rows(seed, n, sources, words=60, langs=("en", "de", None)):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcDEFéß漢😀", k=draw.randrange(1, 5))) for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    gaps = [" ", "-", "12", "_", "\n", "@", "\x7f"]
    text = lambda: "".join(w + draw.choice(gaps) for w in draw.choices(vocabulary, weights, k=draw.randrange(25)))
    return [(draw.choice(langs), draw.choice(sources), text()) for _ in range(n)]


@pytest.mark.parametrize("held", [v.HELD, 7])
def test_counts(spark, held):
    rows = _rows(1, 60, ["a", "b"], langs=("en",))
    got = Counter(), Counter()
    for r in v.term_counts(spark.createDataFrame(rows, "lang string, source string, text string"), held).collect():
        got[0][r["source"], r["term"]] += r["n"]
        got[1][r["source"], r["term"]] += r["docs"]
    want = Counter(), Counter()
    for _, source, text in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want[0].update((source, t) for t in terms)
        want[1].update((source, t) for t in set(terms))
    assert got == want


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(v, "SLICE", 10)
    data = ("ab " * 50 + "x" * 100 + "  é12é").encode().translate(v.TERMS)
    assert [t for part in v._cut(data) for t in part] == data.split()


@pytest.mark.parametrize("seed,least", [(2, 1), (3, 5), (4, 12), (5, 1000)])
def test_against_a_dense_table(spark, seed, least):
    rows = _rows(seed, 250, ["a", "B", "é", "", None, "z"])
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert _got(v.divergence(docs, least=least, top=7)) == _by_hand(rows, least, 7)


def test_more_sources_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(v, "TILE", 4)
    rows = _rows(6, 300, [f"s{i}" for i in range(25)], langs=("en", "fr"))
    assert _got(v.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least=3)) == _by_hand(rows, 3)


def test_ties_are_in_the_order_of_bytes(spark):
    rows = [("en", s, "same words here") for s in ("b", "a", "é", "Z", "😀", "ａ")]
    got = _got(v.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least=1))
    assert got == _by_hand(rows, 1) and [r[3] for r in sorted((r for r in got if r[1] == "b"), key=lambda r: r[5])] == ["Z", "a", "é", "ａ", "😀"]


def test_shares_are_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (3, 17, 4), (9_000_000_000, 10**13, 10**6), (4 * 10**18, 4 * 10**18, 10**9)]
    got = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").select(v._share("a", "b", "c").alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (a + 5) // (b + 5 * c) for a, b, c in rows]


def test_edges(spark):
    edges = edge_table(spark)  # its third column is the source, or null
    rows = [(r["kind"], r["score"], r["text"]) for r in edges.collect()]
    assert _got(v.divergence(edges, lang_col="kind", source_col="score", least=2)) == _by_hand(rows, 2)
    clashing = [F.lit(c).alias(c) for c in ("lang", "source", "term", "n", "docs", "zero", "p", "all", "first")]
    more = edges.drop("first", "n").select("*", *clashing)
    assert _got(v.divergence(more, lang_col="kind", source_col="score", least=2)) == _by_hand(rows, 2)
    assert _got(v.divergence(empty_table(spark), lang_col="kind", source_col="label")) == []


def test_query(spark, data):
    rows = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert _got(v.op13_source_divergence(spark, data)) == _by_hand(rows, 30)
