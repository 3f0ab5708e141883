import hashlib
import random
import re
import time

from foldwright.llm import pii

from .fixtures import EDGES, edge_table, empty_table, prose

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(RAW.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TRICKY = [
    "a@b.c+d@e.f.g a@b..c @x.y a.b@c-d.e-f. 😀me@x.org x@y",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 0.0.0.0 999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 5500 0000 0000 0004 4111 1111 1111 1111 2",
    "+1 (564) 555-4526 +12 +1234567890123456 ++49 30 123456 +49.(30).123456- +1 2 +44 20 7946 0958 1.2.3.4",
    "x" * 3000 + "1" * 3000 + "a." * 3000 + "@" + "a." * 3000 + "b",
    " ".join(f"u{i}@h{i}.org" for i in range(400)),
    "é1.2.3.4ß +1 555 0100 999",
]


def spans(rows, which="base"):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(x) for x in r[which]]) for r in rows)


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    got = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert spans(got) == [(i, brute(t)) for i, t in rows]


def test_many_matches_in_one_text(spark):
    """Places and redaction of 20,000 addresses in a text, and of numbers of all kinds."""
    draw = random.Random(3)
    one = " ".join(f"u{i}@h{i % 97}.org" for i in range(20_000))
    kinds = ["a{}@b.de", "1.2.{}.4", "+1 555 {} 0100 22", "4111 1111 1111 1111", "é ß {}", "12{}"]
    other = " x ".join(draw.choice(kinds).format(i % 200) for i in range(12_000))
    docs = spark.createDataFrame([(1, one), (2, other), (3, "no data")], "doc_id bigint, text string")
    start = time.time()
    got = spans(pii.find(docs).collect())
    found = time.time() - start
    want = {i: brute(t) for i, t in ((1, one), (2, other), (3, "no data"))}
    assert got == sorted(want.items()) and len(want[1]) == 20_000
    start = time.time()
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert found < 90 and time.time() - start < 90
    for i, text in ((1, one), (2, other)):
        out, till = [], 0
        for a, _, b, kind in want[i]:
            if a >= till:
                out += [text[till:a], f"<{kind.upper()}>"]
                till = b
        assert texts[i] == "".join(out) + text[till:]
    assert texts[3] == "no data"


def test_filters_stay_above_the_places(spark):
    """The optimizer copies nothing of the work on positions into a filter below it."""
    plan = pii.matches(spark.createDataFrame([(1, "a@b.de")], "doc_id bigint, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_w#") and not any("Filter" in line and ("aggregate(" in line or "_w#" in line) for line in plan.splitlines())
    assert plan.count("regexp_extract_all") <= 2 * (len(pii.PATTERNS) + 1) * 2


def test_edges(spark):
    got = pii.find(edge_table(spark)).collect()
    assert len(got) == len(EDGES) and all(r["base"] == [] and r["extra"] == [] for r in got)
    assert pii.find(empty_table(spark)).count() == 0
    assert pii.redact(empty_table(spark)).count() == 0
    same = pii.redact(edge_table(spark))
    assert same.columns == edge_table(spark).columns
    assert sorted(map(str, same.collect())) == sorted(map(str, edge_table(spark).collect()))


def planted():
    """Prose with identifiers of known formats in three phrases, and with others that only the phrases give away."""
    draw, rows, want = random.Random(5), [], {}

    def put(i, phrase, identifier, kind, after="thanks"):
        head = f"{prose(i, draw.randrange(5, 40))} {phrase} "
        rows.append((i, f"{head}{identifier}, {after} {prose(-i - 1, draw.randrange(5, 40))}"))
        if kind:
            want[i] = [(len(head), len(head) + len(identifier), kind)]

    for i in range(40):
        put(i, "reach desk:", f"+1 555 010 {1000 + i}", None)
        put(100 + i, "written by", f"user{i}@mail{i % 7}.example.org", None)
        put(200 + i, "on page", str(draw.randrange(10**7)), None)  # numbers without a seed
    for i in range(12):
        put(300 + i, "reach desk:", f"555/77/{1000 + i}", "phone")
        put(400 + i, "written by", f"user{i}@intranet", "email")
        put(500 + i, "ring extension", f"555/77/{1000 + i}", "phone")  # known by now, so this phrase counts from round two on
    for i in range(6):
        put(600 + i, "ring extension", f"778-99x{2000 + i}", "phone")
        put(700 + i, "on page", f"555-77/{3000 + i}", None)
    return rows, want


def test_contexts_discover_identifiers_round_by_round(spark):
    rows, want = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(docs).collect()
    got = {r["doc_id"]: [(x["start"], x["stop"], x["kind"]) for x in r["extra"]] for r in found if r["extra"]}
    assert got == want
    assert all(len(r["base"]) == (r["doc_id"] < 200) for r in found)


def test_a_word_that_all_kinds_follow_teaches_nothing(spark):
    seeds = [f"+1 555 010 {{}}", "u{}@x.org", "10.1.{}.7", "{} items of 1000"]
    rows = [(i, f"{prose(i, 9)} see the {seeds[i % 4].format(100 + i)} {prose(i, 3)}") for i in range(80)]
    rows += [(900 + i, f"see the 77123{i}45 there") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(not r["extra"] for r in pii.find(docs).collect())


def brute_learn(texts):
    """The graph and its scores in plain Python."""
    token = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+[0-9][\x20().0-9-]+[0-9]|(?<!\S)[0-9](?:[\x20-]?[0-9])++(?![^\s.,;:!?)\]])|(?<!\S)[^\s0-9@]*[0-9@]\S*")
    links = {}
    for text in texts:
        at, base = 0, {(s[0], s[2]): s[3] for s in brute(text)}
        for m in token.finditer(text):
            before, after = text[at : m.start()].lower().split(), text[m.end() :]
            at = m.end()
            following = token.search(text, at)
            after = (after[: following.start() - at] if following else after).lower().split()
            body = re.sub(r"[^A-Za-z0-9]+$", "", m.group())
            contexts = [" ".join(before[-2:]) + " _"] if len(before) > 1 else []
            if before:
                contexts += [f"{before[-1]} _ {after[0]}"] if after else []
                contexts.append(f"{before[-1]} _ as " + re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", body)))
            for c in contexts:
                key = c, body.lower()
                links[key] = max(filter(None, [links.get(key), base.get(m.span())]), default=None)
    size = {}
    for c, _ in links:
        size[c] = size.get(c, 0) + 1
    worth = {}
    for _ in range(pii.ROUNDS):
        held = {}
        for (c, i), k in links.items():
            for kind, w in [(k, 1.0)] if k else [worth[i]] if i in worth else []:
                n, total = held.get((c, kind), (0, 0.0))
                held[c, kind] = n + 1, total + w
        score = {(c, k): w / size[c] for (c, k), (n, w) in held.items() if n >= pii.MIN_GOOD and w / size[c] >= pii.PATTERN_SCORE}
        doubt = {}
        for (c, i), k in links.items():
            if not k and ("@" in i or len(re.sub("[^0-9]", "", i)) >= pii.MIN_DIGITS):
                for (d, kind), s in score.items():
                    if d == c:
                        doubt[i, kind] = doubt.get((i, kind), 1) * max(1 - s, 1e-9)
        worth = {}
        for (i, kind), x in doubt.items():
            worth[i] = max(worth.get(i, ("", 0)), (kind, 1 - x), key=lambda t: (t[1], t[0]))
        worth = {i: t for i, t in worth.items() if t[1] >= pii.INSTANCE_SCORE}
    return score, worth


def test_graph_scores_equal_brute_force(spark):
    rows, _ = planted()
    patterns, instances = pii.learn(pii.matches(spark.createDataFrame(rows, "doc_id bigint, text string")).cache())
    score, worth = brute_learn([t for _, t in rows])
    got = {(r["pattern"], r["kind"]): r["score"] for r in patterns.collect()}
    assert set(got) == set(score) and all(abs(got[k] - score[k]) < 1e-9 for k in got)
    got = {r["instance"]: (r["kind"], r["score"]) for r in instances.collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in worth.items()}
    assert all(abs(got[i][1] - worth[i][1]) < 1e-9 for i in got) and any(" _ as " in c for c, _ in score)


def test_names_of_other_columns_clash_with_nothing(spark):
    names = "id spans text_key key row base extra _id _spans found kind start stop rank body instance _t _n _b _w _s".split()
    rows = [(1, "mail me@x.org", *["kept"] * len(names)), (2, None, *[None] * len(names))]
    got = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)))
    assert sorted(map(tuple, got.collect())) == [(1, "mail <EMAIL>", *["kept"] * len(names)), rows[1]]


def test_redaction(spark):
    rows = [(1, "mail me@x.org or +1 555 010 9999 now", "k"), (2, "no data", "k"), (3, None, "k"), (1, "other 1.2.3.4 text", "k"), (None, "b@c.de", "k")]
    got = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string, kind string"))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(1, "mail <EMAIL> or <PHONE> now"), (2, "no data"), (3, None), (1, "other <IP> text"), (None, "<EMAIL>")], key=str
    )


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = pii.op1_pii_patterns(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        digest = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in want) for k in pii.KINDS]


def test_main_path_has_no_python(spark, data):
    plan = pii.find(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
