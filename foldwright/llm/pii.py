"""Personal data by fixed formats, and by contexts that those formats teach.

Everything is DataFrame and SQL functions. Base formats (e-mail, IP, card and phone numbers) are the seeds. A pattern is
what stands around a slot: the two words before it, the word before and the word behind, or the word before and the
shape of what fills it. The pattern-instance graph links patterns with the identifier-like strings in their slots.
Scores pass back and forth: a pattern is worth the share of good instances among all that fill its slot, an instance
what its good patterns are worth together. Instances that become good induce patterns in the next round, so patterns
without any seed can be found by way of others. Good instances are named wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import read
from foldwright.runtime import broadcast_if_small, written

KINDS = ("email", "ip", "card", "phone")
ORDER = {kind: k for k, kind in enumerate(KINDS)}

# The base formats. A possessive quantifier or a look behind only spares the matcher starts that can't succeed: an
# address, number or run of digits is tried once from its first character, so matching is linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings that may be identifiers: a whole format match, or a word with a digit or an at sign.
CANDIDATE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|\+[0-9][\x20().0-9-]+[0-9]"
    r"|(?<![0-9])[0-9]++(?:\.[0-9]++){3}|(?<!\S)[0-9](?:[\x20-]?[0-9])++(?![^\s.,;:!?)\]])|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
)

#: Distinct good instances that a pattern needs, rounds of scoring, and the scores from which patterns and instances count.
MIN_GOOD, ROUNDS, PATTERN_SCORE, INSTANCE_SCORE = 5, 3, 0.6, 0.6
#: Digits that a discovered number has at least.
MIN_DIGITS = 6
#: Patterns or instances that may be broadcast: a few words each.
BROADCAST_PATTERNS = 200_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's test."""
    size = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.when((size - i) % 2 == 0, F.substring(digits, i, 1).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit((2 * d) // 10 + (2 * d) % 10) for d in range(10)]), F.substring(digits, i, 1).cast("int") + 1)
        ),
    )
    return F.when(size.between(12, 19), F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern is kept."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: ``array<struct<before, match, after>>``, ``before`` the text since the last
    one, ``after`` the word that follows."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(matches)
    both = F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda b, a: F.struct(b.alias("before"), F.regexp_extract(a, r"^\s*+(\S++)", 1).alias("after")))
    return F.zip_with(both, matches, lambda g, m: F.struct(g["before"].alias("before"), m.alias("match"), g["after"].alias("after")))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns ``keep`` and new ones, which come from a generator of one row: the optimizer neither moves a filter below
    it nor copies what it makes into the expressions above, so each is worked out once a row."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _placed(rows: DataFrame, keep: list[str], column: str) -> DataFrame:
    """Adds ``start`` and ``stop`` to the structs of ``column`` (see ``spans``): code points, end exclusive. No other columns
    but ``keep`` stay.

    Lengths are added up in blocks of the square root of their number, which keeps texts with many matches affordable.
    """
    n = F.size(column)
    lengths = F.transform(column, lambda x: F.length(x["before"]) + F.length(x["match"]))
    rows = _once(rows, [*keep, column], _n=n, _b=F.ceil(F.sqrt(n)).cast("int"), _w=lengths)
    total = "aggregate({}, 0L, (a, x) -> a + x)"
    blocks = F.expr(f"transform(sequence(0, (_n - 1) div _b), k -> {total.format('slice(_w, 1, cast(k * _b as int))')})")
    rows = _once(rows, [*keep, column, "_b", "_w"], _s=blocks)
    start = f"_s[cast(i div _b as int)] + {total.format('slice(_w, cast(i - i % _b + 1 as int), cast(i % _b as int))')} + length(x.before)"
    begun = F.expr(f"transform({column}, (x, i) -> named_struct('x', x, 'start', {start}))")
    placed = "transform(_begun, y -> named_struct('before', y.x.before, 'match', y.x.match, 'after', y.x.after, 'start', y.start, 'stop', y.start + length(y.x.match)))"
    return _once(_once(rows, keep, _begun=begun), keep, **{column: F.expr(placed)})


def _contexts(x: Column) -> Column:
    """The patterns around a string, ``_`` its slot: two words before it; one before and one behind; one before and the
    string's shape, digits as 9, letters as a, whatever is around them as it is."""
    before = F.rtrim(F.regexp_replace(F.lower(x["before"]), r"\s+", " "))
    one, two = F.substring_index(before, " ", -1), F.ltrim(F.substring_index(before, " ", -2))
    shape = F.regexp_replace(F.regexp_replace(_body(x["match"]), "[0-9]+", "9"), r"\p{L}+", "a")
    after = F.lower(x["after"])
    patterns = F.array(
        F.when(two != one, F.concat(two, F.lit(" _"))),
        F.when((one != "") & (after != ""), F.concat(one, F.lit(" _ "), after)),
        F.when(one != "", F.concat(one, F.lit(" _ as "), shape)),
    )
    return F.filter(patterns, lambda p: p.isNotNull())


def _body(match: Column) -> Column:
    """A string without the punctuation that ends it."""
    return F.regexp_replace(match, r"[^A-Za-z0-9]++$", "")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_key, kind, found)``: a row for each document and kind with matches, in one pass over the texts.

    ``found`` is ``array<struct<match, start, stop, contexts>>`` without matches that fail their kind's test. Kind
    ``any`` has all strings that may be identifiers, with the patterns around them.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("text_key"), text.alias("_t")).where(F.col("_t").rlike("[0-9@]"))
    needs = {"email": F.instr("_t", "@") > 0, "phone": F.instr("_t", "+") > 0}
    kinds = [
        F.struct(F.lit(k).alias("kind"), F.when(needs.get(k, F.lit(True)), spans(F.col("_t"), p)).alias("found"))
        for k, p in (PATTERNS | {"any": CANDIDATE}).items()
    ]
    keep = [id_col, "text_key", "kind"]
    each = _placed(rows.select(id_col, "text_key", F.inline(F.array(*kinds))).where("size(found) > 0"), keep, "found")
    none = F.array().cast("array<string>")

    def kept(kind: str) -> Column:
        ours = F.filter("found", lambda x: valid(kind, x["match"])) if kind != "any" else F.col("found")
        contexts = _contexts if kind == "any" else (lambda x: none)
        return F.transform(ours, lambda x: F.struct(x["match"], x["start"], x["stop"], contexts(x).alias("contexts")))

    chosen = F.when(F.col("kind") == "any", kept("any"))
    for kind in KINDS:
        chosen = chosen.when(F.col("kind") == kind, kept(kind))
    return _once(each, keep, found=chosen).where("size(found) > 0")


def _seed_kind(match: Column) -> Column:
    """The kind that a whole string has by its format, null if none."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(match.rlike(rf"^(?:{PATTERNS[kind]})$") & valid(kind, match), F.lit(kind)).otherwise(out)
    return out


def _side(df: DataFrame) -> DataFrame:
    """A join's smaller side: broadcast behind a size check, else dealt out so that a skewed join can be split."""
    checked = broadcast_if_small(df, BROADCAST_PATTERNS)
    return checked if checked is not df else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(found: DataFrame) -> DataFrame:
    """The pattern-instance graph ``(pattern, instance, kind)``, each link once; ``kind`` is null for what isn't a seed.

    Only patterns with MIN_GOOD distinct instances are in it, as others can never count.
    """
    each = found.where("kind = 'any'").select(F.explode("found").alias("x"))
    links = each.select(F.explode("x.contexts").alias("pattern"), F.lower(_body(F.col("x.match"))).alias("instance"), _seed_kind(F.col("x.match")).alias("kind"))
    links = written(links.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    enough = links.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GOOD).select("pattern")
    return written(links.join(_side(written(enough)), "pattern"))


def learn(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pattern, kind, score)`` of the patterns and ``(instance, kind, score)`` of the instances that count after ROUNDS
    rounds over the pattern-instance graph.

    A round scores each pattern by the worth of its good instances among all its instances, then each instance that is no
    seed by its patterns that count. Seeds of another kind, and strings that no pattern speaks for, weigh against a
    pattern. What holds neither an at sign nor MIN_DIGITS digits is never good.
    """
    edges = _edges(found)
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("size")))
    seeds = written(edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("n")).withColumn("worth", F.col("n").cast("double")))
    likely = F.col("instance").contains("@") | (F.length(_digits(F.col("instance"))) >= MIN_DIGITS)
    others = written(edges.where(F.col("kind").isNull() & likely).select("pattern", "instance"))
    good, patterns, instances = seeds, None, None
    for _ in range(ROUNDS):
        held = good.groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.sum("worth").alias("worth")).where(F.col("n") >= MIN_GOOD)
        score = F.col("worth") / F.col("size")
        patterns = written(held.join(sizes, "pattern").select("pattern", "kind", score.alias("score")).where(score >= PATTERN_SCORE))
        together = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        instances = others.join(_side(patterns), "pattern").groupBy("instance", "kind").agg(together.alias("score"))
        instances = instances.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", "best.kind", "best.score")
        instances = written(instances.where(F.col("score") >= INSTANCE_SCORE))
        more = others.join(_side(instances), "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("worth"))
        good = seeds.unionByName(more)
    return patterns, instances


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``(id_col, base, extra)`` for each row of ``docs``: arrays of ``(start, rank, stop, kind)`` in that order.

    With ``keyed`` there is also ``text_key``, a hash of the text.

    ``base`` has the format matches, ``extra`` what was discovered: all places of the instances that ``learn`` finds good,
    where they touch no base span. Null and empty texts have neither; repeated rows give repeated results; rows with a
    null id are kept; an empty table gives none; other columns are ignored.
    """
    found = written(matches(docs, id_col, text_col))
    _, known = learn(found)
    rank = F.create_map(*[x for n, k in ORDER.items() for x in (F.lit(n), F.lit(k))])
    key = [id_col, "text_key"]
    span = "array<struct<start: bigint, rank: int, stop: bigint, kind: string>>"

    once = found.where("kind <> 'any'").dropDuplicates([*key, "kind"])
    placed = F.transform("found", lambda x: F.struct(x["start"].cast("bigint").alias("start"), rank[F.col("kind")].alias("rank"), x["stop"].cast("bigint").alias("stop"), F.col("kind").alias("kind")))
    base = once.groupBy(*key).agg(F.flatten(F.collect_list(placed)).alias("base"))

    each = found.where("kind = 'any'").select(*key, F.explode("found").alias("x"))
    each = each.select(*key, F.col("x.start").alias("start"), _body(F.col("x.match")).alias("body")).withColumn("instance", F.lower("body"))
    named = each.join(_side(known), "instance")
    named = named.select(*key, F.struct(F.col("start").cast("bigint").alias("start"), rank[F.col("kind")].alias("rank"), (F.col("start") + F.length("body")).cast("bigint").alias("stop"), "kind").alias("span"))
    extra = named.groupBy(*key).agg(F.collect_set("span").alias("extra"))

    rows = docs.select(id_col, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"))
    for part in (base, extra):
        part = part.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), part.columns[-1])
        rows = rows.join(part, rows[id_col].eqNullSafe(part["_id"]) & (rows["text_key"] == part["_key"]), "left").drop("_id", "_key")
    nothing = F.array().cast(span)
    rows = rows.select(id_col, *["text_key"] * keyed, F.array_sort(F.coalesce("base", nothing)).alias("base"), F.coalesce("extra", nothing).alias("extra"))
    free = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"])))
    return rows.withColumn("extra", F.array_sort(free))


def _redacted(rows: DataFrame, keep: list[str], text: Column, spans: str) -> DataFrame:
    """The columns ``keep`` and ``redacted``: ``text`` with ``<KIND>`` in the place of each span; spans that overlap are
    covered by the one that begins first. Without spans it is null.

    Cuts, each the text since the last one and a span's kind, are put by in blocks of the square root of their number. A
    block is cut from the text, and its pieces from the block, so that nothing looks through the whole text for each span.
    """
    # From the left: keep a span if it begins behind all kept before it. "till" is where the text goes on.
    cut, zero = "array<struct<low: bigint, high: bigint, kind: string>>", "CAST(0 AS bigint)"
    begin = f"named_struct('till', {zero}, 'full', CAST(array() AS array<{cut}>), 'open', CAST(array() AS {cut}))"
    whole = "size(acc.open) >= _b"
    step = (
        "IF(x.start < acc.till, acc, named_struct('till', x.stop, "
        f"'full', IF({whole}, array_append(acc.full, acc.open), acc.full), "
        "'open', array_append(IF(" + whole + f", CAST(array() AS {cut}), acc.open), named_struct('low', acc.till, 'high', x.start, 'kind', x.kind))))"
    )
    rows = _once(rows, [*keep, spans], _t=text, _b=F.ceil(F.sqrt(F.size(spans))).cast("int"))
    rows = _once(rows, [*keep, "_t"], _f=F.expr(f"aggregate({spans}, {begin}, (acc, x) -> {step})"))
    blocks = F.expr(
        "transform(array_append(_f.full, _f.open), b -> named_struct('cuts', b, 'at', get(b, 0).low, "
        "'part', substring(_t, CAST(get(b, 0).low AS int) + 1, CAST(get(b, size(b) - 1).high - get(b, 0).low AS int))))"
    )
    rows = _once(rows, [*keep, "_t", "_f"], _p=blocks)
    piece = "concat(substring(b.part, CAST(c.low - b.at AS int) + 1, CAST(c.high - c.low AS int)), '<', upper(c.kind), '>')"
    joined = F.expr(f"array_join(transform(_p, b -> array_join(transform(b.cuts, c -> {piece}), '')), '')")
    return _once(rows, keep, redacted=F.concat(joined, F.expr("substring(_t, CAST(_f.till AS int) + 1)")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``find`` reports replaced by its kind in angle brackets.

    Texts without personal data, nulls among them, stay as they are; rows and other columns are kept. Only texts that
    have spans are joined and cut; the rest pass through.
    """
    spans = find(docs, id_col, text_col, keyed=True)
    spans = spans.select(F.col(id_col).alias("id"), "text_key", F.array_sort(F.concat("base", "extra")).alias("spans"))
    found = spans.where("size(spans) > 0").dropDuplicates(["id", "text_key"])
    # The rows wait in one column, so that no name of theirs meets one of these.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"))
    rows = rows.join(_side(written(found)), F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left")
    whole = F.col(f"row.`{text_col}`")
    none = F.array().cast("array<struct<start: bigint, rank: int, stop: bigint, kind: string>>")
    rows = _redacted(rows.withColumn("spans", F.coalesce("spans", none)), ["row", "spans"], whole, "spans")
    text = F.when(F.size("spans") > 0, F.col("redacted")).otherwise(whole)
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op1_pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
