import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import phrases as p

from .fixtures import edge_table, empty_table


def _pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", x) for x in re.split("[.,;:!?\x0a-\x0d]", text)]


def _counts(rows):
    """``{lang: {words: n}}`` of ``(lang, text)`` rows, one to four words."""
    out = {}
    for lang, text in rows:
        own = out.setdefault("und" if lang is None else lang, Counter())
        for words in _pieces(text):
            own.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    return out


def _by_hand(rows, least, top=2000):
    out = []
    for lang, counts in _counts(rows).items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        long = {w: c for w, c in counts.items() if len(w) > 1 and c >= least}
        dropped = {w[i:j] for w, c in long.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * c >= 80 * counts[w[i:j]]}
        scored = []
        for w, a in long.items():
            if w not in dropped:
                score, _, l, r = min((2000000 * a // (counts[w[:k]] + counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def _rows(seed, n, words=30, langs=("en", "de", None), ends=(" ", " ", " ", ". ", "\n", "\t", "  ", ",")):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("aBcé漢😀-'", k=draw.randrange(1, 4))) for _ in range(words)] + ["fixed phrase of words", "New York", "a a a a a"]
    weights = [1 / (i + 1) for i in range(words)] + [0.3, 0.3, 0.1]
    text = lambda: "".join(w + draw.choice(ends) for w in draw.choices(vocabulary, weights, k=draw.randrange(40)))
    return [(draw.choice(langs), text()) for _ in range(n)]


def test_automaton_has_every_substring_with_its_end_positions():
    draw = random.Random(1)
    for size, words in ((0, 1), (1, 1), (40, 2), (300, 3), (300, 40), (300, 1)):
        sequence = np.array([0, *(draw.randrange(words + 1) for _ in range(size)), 0])
        want, ends = Counter(), {}
        for i in range(len(sequence)):
            for k in range(1, 5):
                part = tuple(sequence[max(0, i - k + 1) : i + 1].tolist())
                if len(part) == k and 0 not in part:
                    want[part] += 1
                    ends.setdefault(part, set()).add(i)
        got, states = {}, set()
        for longest, low, at, counts in p.Automaton(sequence, 4).states(1):
            for end, n in zip(at.tolist(), counts.tolist()):
                for k in range(low, longest + 1):
                    part = tuple(sequence[end - k + 1 : end + 1].tolist())
                    assert part not in got and ends[part] == ends[tuple(sequence[end - longest + 1 : end + 1].tolist())]
                    got[part] = n
                states.add(frozenset(ends[tuple(sequence[end - longest + 1 : end + 1].tolist())]))
        assert got == want and states == {frozenset(x) for x in ends.values()}


def test_automaton_goes_on_from_passing_pairs_only():
    draw = random.Random(2)
    sequence = np.array([0, *(draw.randrange(6) for _ in range(500)), 0])
    passes = lambda first, last: (first * 7 + last) % 3 > 0
    want = Counter()
    for i in range(len(sequence)):
        for k in (3, 4):
            part = sequence[max(0, i - k + 1) : i + 1]
            if len(part) == k and part.all() and passes(part[:-1], part[1:]).all():
                want[tuple(part.tolist())] += 1
    got = {}
    for longest, low, at, counts in p.Automaton(sequence, 4, passes).states(3):
        got |= {tuple(sequence[e - k + 1 : e + 1].tolist()): n for e, n in zip(at.tolist(), counts.tolist()) for k in range(low, longest + 1)}
    assert got == want


def test_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(p, "SLICE", 5)
    shard, text = p.Shard(), "Ab cd. ef gh ij kl; m\tn\n\n" * 9 + "end of it"
    shard.add(text)
    words = [shard.words[i].decode() for i in shard.sequence().tolist()]
    pieces = [x.split() for x in "|".join(w or "|" for w in words).replace("|||", "||").split("||")]
    assert [w for x in _pieces(text) for w in x] == [w for w in words if w]
    assert sorted(map(len, pieces)) and [len(x) for x in _pieces(text) if x] == [len(x.strip("|").split("|")) for x in "|".join(w or "#" for w in words).split("#") if x.strip("|")]


@pytest.mark.parametrize("shard", [p.SHARD, 300])
def test_counts_over_shards(spark, shard):
    rows = _rows(3, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").na.fill("und").repartition(3)
    counts, langs = p.frequent_phrases(docs, 4, shard)
    want = {(lang, " ".join(w)): n for lang, c in _counts(rows).items() for w, n in c.items() if n >= 4}
    assert {(r["lang"], r["phrase"]): r["a"] for r in counts.collect()} == want
    assert {r["lang"]: r["n"] for r in langs.collect()} == {lang: sum(n for w, n in c.items() if len(w) == 1) for lang, c in _counts(rows).items()}


def test_filters(spark):
    """They have all that is frequent, and of the rest what shares a bit."""
    words = [("en", f"a{i}") for i in range(3000)] + [("de", "a7")]
    bits = np.frombuffer(p.word_filter(spark.createDataFrame(words, "lang string, w0 string").repartition(3)), np.uint8)
    own = [p._hashes(lang, [w.encode()]) for lang, w in words]
    assert len(bits) == p.BITS // 8 and set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {int(p.pair_bits(h, h)[0]) for h in own}
    rows = [(lang or "und", text) for lang, text in _rows(9, 120)]
    common = spark.sparkContext.broadcast(b"\xff" * (p.BITS // 8))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    bits = np.frombuffer(p.pair_filter(docs, common, 5, 200), np.uint8)
    sums = Counter()
    for lang, counts in _counts(rows).items():
        for w, n in counts.items():
            if len(w) == 2:
                first, last = p._hashes(lang, [x.encode() for x in w])
                sums[int(p.pair_bits(np.array([first]), np.array([last]))[0])] += n
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {b for b, n in sums.items() if n >= 5}


@pytest.mark.parametrize("seed,least,top", [(4, 3, 2000), (5, 8, 2000), (6, 2, 15), (7, 500, 2000)])
def test_against_counting_everything(spark, seed, least, top):
    rows = _rows(seed, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = p.phrases(docs, least=least, top=top, shard=400)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _by_hand(rows, least, top)


def test_all_phrases(spark):
    rows = _rows(8, 100)
    got = p.phrases(spark.createDataFrame(rows, "lang string, text string"), least=2, top=None)
    assert sorted(map(tuple, got.collect())) == _by_hand(rows, 2, None)


def test_scores_are_exact_for_large_counts(spark):
    rows = [(4 * 10**18, 5 * 10**18), (7, 9), (9 * 10**18, 10**18)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select(F.expr(p._ratio("a", p.SCALE, "CAST(b AS decimal(20, 0))")).alias("x")).collect()
    assert [r["x"] for r in got] == [2000000 * a // b for a, b in rows]


def test_edges(spark):
    edges = edge_table(spark)
    rows = [(r["score"], r["text"]) for r in edges.collect()] * 2
    more = edges.union(edges).select("*", *(F.lit(c).alias(c) for c in ("lang", "phrase", "low", "w0", "w1", "a", "l", "r")))
    assert sorted(map(tuple, p.phrases(more, lang_col="score", least=2).collect())) == _by_hand(rows, 2)
    assert p.phrases(empty_table(spark), lang_col="score").count() == 0


def test_query(spark, data):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, p.op11_phrase_collocations(spark, data).collect())) == _by_hand(rows, 30)


def test_phrases_travel_packed(spark):
    """Rows between tasks are as many as shards have buckets, not as phrases occur in them."""
    rows = [(lang or "und", text) for lang, text in _rows(10, 150)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    every = spark.sparkContext.broadcast(b"\xff" * (p.BITS // 8))
    for buckets, shard in ((1, 300), (7, 300), (7, p.SHARD)):
        found = p.phrase_counts(docs, every, every, 4, buckets, shard)
        assert {(r["lang"], r["phrase"]): (r["size"], r["n"]) for r in found.collect()} == {
            (lang, " ".join(w)): (len(w), n) for lang, c in _counts(rows).items() for w, n in c.items() if len(w) > 1 and n >= 4
        }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "counts" in plan


def test_packed_counts_come_back():
    import pyarrow as pa

    words = pa.array(["x", "a b", "", "漢 😀", "c" * 70_000])
    for part, counts in ((words, [1, 2, 3, 2**32 - 1, 5]), (words.slice(1, 3), [7, 8, 9]), (words.slice(5), [])):
        found, n = p._unwrapped(p._wrapped(part, np.array(counts, np.int64)))
        assert found.to_pylist() == part.to_pylist() and n.tolist() == counts
