"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.text import normalize_native, normalize_text, shingle_sets
from foldwright.operators import assign, audit, evaluate, folds, groups, labels, pairs, summary
from foldwright.operators.components import connected_components, updated_components
from foldwright.runtime import checkpoint, ensure_checkpoint_dir
from foldwright.sources import io

THRESHOLD, NGRAM = 0.8, 5
RATIOS = {"train": 0.8, "test": 0.2}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of SQL. A normalized text is a key; keys have character 5-grams (a shorter key is one), and similar pairs.
KEY = r"trim(regexp_replace(replace(lower({t}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
UNIQUES = f"rows_ AS (SELECT doc_id, {KEY.format(t='text')} AS k FROM documents), uniq AS (SELECT k, min(doc_id) AS uid FROM rows_ GROUP BY k)"
GRAMS = (
    "pieces AS (SELECT DISTINCT uid, CASE WHEN length(k) < 5 THEN k ELSE substr(k, i, 5) END AS h FROM (SELECT uid, k, "
    "unnest(range(1, greatest(length(k) - 3, 2))) AS i FROM uniq WHERE k <> '')), sizes AS (SELECT uid, count(*) AS n FROM pieces GROUP BY uid)"
)
SIMILAR = (
    "shared AS (SELECT a.uid AS l, b.uid AS r, count(*) AS s FROM pieces a JOIN pieces b ON a.h = b.h AND a.uid < b.uid GROUP BY ALL), "
    "pairs AS MATERIALIZED (SELECT l, r, s AS n_shared, x.n + y.n - s AS n_union, s / (x.n + y.n - s) AS similarity FROM shared JOIN sizes x ON x.uid = l "
    f"JOIN sizes y ON y.uid = r WHERE s / (x.n + y.n - s) >= {THRESHOLD})"
)
GROUPS = (
    "ends AS MATERIALIZED (SELECT l AS x, r AS y FROM pairs UNION ALL SELECT r, l FROM pairs), reach AS (SELECT uid AS a, uid AS b FROM uniq UNION SELECT a, y FROM reach JOIN ends ON x = b), "
    "roots AS (SELECT a AS uid, min(b) AS root FROM reach GROUP BY a), "
    "placed AS (SELECT doc_id, root FROM rows_ JOIN uniq USING (k) JOIN roots USING (uid)), "
    "grouped AS (SELECT doc_id, dense_rank() OVER (ORDER BY f) - 1 AS group_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS f FROM placed))"
)
NEAR = f"WITH RECURSIVE {UNIQUES}, {GRAMS}, {SIMILAR}, {GROUPS}"


def cross_sql(train: str, test: str, threshold: float) -> str:
    """CTEs up to ``found(train_id, test_id, similarity)`` for two subqueries of ``(id, text)``."""
    key = KEY.format(t="text")
    grams = (
        "SELECT DISTINCT uid, CASE WHEN length(k) < 5 THEN k ELSE substr(k, i, 5) END AS h FROM (SELECT uid, k, "
        "unnest(range(1, greatest(length(k) - 3, 2))) AS i FROM {} WHERE k <> '')"
    )
    return (
        f"tr AS (SELECT id, {key} AS k FROM ({train})), te AS (SELECT id, {key} AS k FROM ({test})), "
        "tru AS (SELECT k, min(id) AS uid FROM tr GROUP BY k), teu AS (SELECT k, min(id) AS uid FROM te GROUP BY k), "
        f"trg AS ({grams.format('tru')}), teg AS ({grams.format('(SELECT * FROM teu ANTI JOIN tru USING (k))')}), "
        "trn AS (SELECT uid, count(*) AS n FROM trg GROUP BY uid), ten AS (SELECT uid, count(*) AS n FROM teg GROUP BY uid), "
        "near AS (SELECT a.uid AS l, b.uid AS r, count(*) AS s FROM trg a JOIN teg b USING (h) GROUP BY ALL), "
        f"hits AS (SELECT l, r, s / (x.n + y.n - s) AS similarity FROM near JOIN trn x ON x.uid = l JOIN ten y ON y.uid = r WHERE s / (x.n + y.n - s) >= {threshold}), "
        "best AS (SELECT r, l, similarity FROM hits QUALIFY row_number() OVER (PARTITION BY r ORDER BY similarity DESC, l) = 1), "
        "found AS (SELECT coalesce(e.uid, b.l) AS train_id, te.id AS test_id, CASE WHEN e.uid IS NOT NULL THEN 1.0::DOUBLE ELSE b.similarity END AS similarity "
        "FROM te LEFT JOIN tru e USING (k) JOIN teu USING (k) LEFT JOIN best b ON b.r = teu.uid WHERE e.uid IS NOT NULL OR b.l IS NOT NULL)"
    )


TRAIN = "SELECT doc_id AS id, text FROM documents WHERE doc_id % 5 <> 0"
TEST = "SELECT doc_id AS id, text FROM documents WHERE doc_id % 5 = 0"
CROSS = cross_sql(TRAIN, TEST, THRESHOLD)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")


@query(f"SELECT doc_id, {KEY.format(t='text')} AS normalized FROM documents")
def normalize_texts(spark, sf_dir):
    return normalize_text(table(spark, sf_dir, "documents")).select("doc_id", "normalized")


@query(f"SELECT doc_id, {KEY.format(t='text')} AS normalized FROM documents UNION ALL SELECT -1 - item_id, {KEY.format(t='text')} FROM benchmark")
def normalize_builtin(spark, sf_dir):
    """The built-in form over documents, and over benchmark items under negative ids."""
    both = table(spark, sf_dir, "documents").select("doc_id", "text").union(table(spark, sf_dir, "benchmark").select(-1 - F.col("item_id"), "text"))
    return both.select("doc_id", normalize_native(F.col("text")).alias("normalized"))


@query(
    f"WITH {UNIQUES} SELECT doc_id, dense_rank() OVER (ORDER BY f) - 1 AS group_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS f FROM rows_)"
)
def exact_duplicate_groups(spark, sf_dir):
    return groups.near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", threshold=1.0)


@query(f"WITH {UNIQUES}, {GRAMS} SELECT doc_id, coalesce(n, 0) AS n_shingles FROM rows_ JOIN uniq USING (k) LEFT JOIN sizes USING (uid)")
def shingle_counts(spark, sf_dir):
    sets = shingle_sets(table(spark, sf_dir, "documents"), "doc_id")
    return sets.select("doc_id", F.size("shingles").cast("bigint").alias("n_shingles"))


JACCARD = f"WITH {UNIQUES}, {GRAMS}, {SIMILAR}"


@query(f'{JACCARD} SELECT l AS "left", r AS "right", n_shared, n_union, similarity FROM pairs')
def jaccard_pairs(spark, sf_dir):
    return pairs.exact_pairs(table(spark, sf_dir, "documents"), "doc_id", threshold=THRESHOLD)


@query(f'{JACCARD} SELECT l AS "left", r AS "right", similarity FROM pairs')
def lsh_pairs(spark, sf_dir):
    return pairs.lsh_pairs(table(spark, sf_dir, "documents"), "doc_id", threshold=THRESHOLD)


@query(f"{NEAR} SELECT uid AS node, root AS component FROM roots WHERE uid IN (SELECT x FROM ends)")
def components_by_increments(spark, sf_dir):
    """Components of the similar pairs, a third of which come as new edges to the components of the others, twice."""
    found = checkpoint(lsh_pairs(spark, sf_dir).select("left", "right"))
    part = F.pmod(F.xxhash64("left", "right"), F.lit(3))
    labels_ = connected_components(found.where(part == 0))
    for k in (1, 2):
        labels_ = checkpoint(updated_components(labels_, found.where(part == k)))
    return labels_


@query(f"{NEAR} SELECT doc_id, group_id FROM grouped")
def near_duplicate_groups(spark, sf_dir):
    return groups.near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", threshold=THRESHOLD)


@query(
    f"{NEAR}, sized AS (SELECT group_id, count(*) AS n FROM grouped GROUP BY group_id) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, "
    "max(n) AS largest, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS rows_shared FROM sized"
)
def group_stats(spark, sf_dir):
    return groups.group_stats(near_duplicate_groups(spark, sf_dir))


@query(
    "WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS a, CASE WHEN turn % 3 = 0 THEN conv_id // 4 END AS b FROM conversations), "
    # a conversation is one part; conversations whose b agrees are joined: all of a block of four share it through turn 0
    "g AS (SELECT a, min(b) AS b FROM t GROUP BY a), p AS (SELECT t.id, coalesce(min(t.id) OVER (PARTITION BY g.b), t.id) AS f, g.b, t.a FROM t JOIN g USING (a)) "
    "SELECT id, dense_rank() OVER (ORDER BY f) - 1 AS group_id FROM p"
)
def merge_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("a"), F.when(F.col("turn") % 3 == 0, F.expr("conv_id div 4")).alias("b")
    )
    return groups.merge_groups(rows, "id", "a", None, "b")


@query(f"WITH {CROSS} SELECT train_id, test_id, similarity FROM found")
def cross_duplicates(spark, sf_dir):
    return pairs.find_cross_duplicates(*sides(spark, sf_dir), "doc_id", threshold=THRESHOLD)


REPORT = (
    "SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te) AS n_test, {t}::DOUBLE AS threshold, count(*) AS leaked, "
    "count(*) FILTER (similarity >= 1) AS exact, count(*) / (SELECT count(*) FROM te) AS fraction FROM found"
)


@query(f"WITH {CROSS} {REPORT.format(t=THRESHOLD)}")
def leakage_report(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    found = checkpoint(pairs.find_cross_duplicates(train, test, "doc_id", threshold=THRESHOLD))
    return audit.report(found, test, train, THRESHOLD)


@query(f"WITH {CROSS} SELECT train_id, test_id, similarity FROM found ORDER BY similarity >= 1, similarity DESC, test_id LIMIT 5")
def leakage_examples(spark, sf_dir):
    return audit.examples(cross_duplicates(spark, sf_dir), 5)


@query(
    f"WITH {CROSS} SELECT train_id, test_id, a.source AS train_label, b.source AS test_label FROM found JOIN documents a ON a.doc_id = train_id "
    "JOIN documents b ON b.doc_id = test_id WHERE a.source <> b.source"
)
def label_conflicts(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return audit.label_conflicts(cross_duplicates(spark, sf_dir), train, test, "doc_id", "source")


BY_SOURCE = ("src0,src1,src2,src3", "('src0', 'src1', 'src2', 'src3')")


@query(
    "WITH "
    + cross_sql(
        f"SELECT doc_id AS id, text FROM documents WHERE source NOT IN {BY_SOURCE[1]}", f"SELECT doc_id AS id, text FROM documents WHERE source IN {BY_SOURCE[1]}", THRESHOLD
    )
    + " "
    + REPORT.format(t=THRESHOLD)
)
def audit_by_split_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("source").isin(*BY_SOURCE[0].split(",")), F.col("source")).otherwise("rest"))
    train, test = audit.sides(docs, "split", "rest", BY_SOURCE[0])
    found = checkpoint(pairs.find_cross_duplicates(train, test, "doc_id", threshold=THRESHOLD))
    return audit.report(found, test, train, THRESHOLD)


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def split_values(spark, sf_dir):
    return audit.split_values(table(spark, sf_dir, "documents"), "source")


@query(
    f"WITH {cross_sql('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS id, text FROM benchmark', 0.3)} "
    "SELECT train_id AS doc_id, test_id AS item_id, similarity FROM found"
)
def benchmark_contamination(spark, sf_dir):
    """Whole items against whole documents; candidates by the exact prefix filter, as bands at 0.3 propose far too many."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = pairs.find_cross_duplicates(docs, items, "id", threshold=0.3, exact=True)
    return found.select(F.col("train_id").alias("doc_id"), F.col("test_id").alias("item_id"), "similarity")


# Rows with labels and a fixed split. A document's labels are its language and, where known, its flags.
LABELLED = (
    "lab AS (SELECT d.doc_id, d.doc_id % 5 AS split, list_concat([lang], CASE WHEN quality = 1 THEN ['quality'] ELSE [] END, "
    "CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS labels FROM documents d LEFT JOIN labels USING (doc_id))"
)
LONG = f"{LABELLED}, long AS (SELECT DISTINCT doc_id, split, unnest(labels) AS label FROM lab)"
GRID = (
    f"{LONG}, s AS (SELECT split, count(*) AS n_split FROM lab GROUP BY split), l AS (SELECT label, count(*) AS n_label FROM long GROUP BY label), "
    "grid AS (SELECT s.split, l.label, coalesce(n, 0) AS n, n_split, n_label, (SELECT count(*) FROM lab) AS n_total FROM s CROSS JOIN l "
    "LEFT JOIN (SELECT split, label, count(*) AS n FROM long GROUP BY ALL) c ON c.split = s.split AND c.label = l.label)"
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    every = F.concat(labels.label_sets(rows, "lang"), labels.label_sets(rows, "quality", "toxic", indicator=True))
    return rows.select("doc_id", "source", (F.col("doc_id") % 5).alias("split"), every.alias("labels"))


@query(f"WITH {LABELLED} SELECT doc_id, array_to_string(list_sort(labels), ',') AS labels FROM lab")
def label_sets(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query(f"WITH {LONG} SELECT source AS \"group\", label, count(*) AS n FROM long JOIN documents USING (doc_id) GROUP BY ALL")
def group_label_counts(spark, sf_dir):
    return labels.group_label_counts(labelled(spark, sf_dir).withColumnRenamed("source", "group"), "group")


@query(f"WITH {LONG} SELECT label, count(*) AS total FROM long GROUP BY label")
def label_totals(spark, sf_dir):
    return labels.label_totals(labelled(spark, sf_dir))


@query(
    f"WITH {LONG}, t AS (SELECT label, count(*) AS total FROM long GROUP BY label), c AS (SELECT source, label, count(*) AS n FROM long "
    'JOIN documents USING (doc_id) GROUP BY ALL) SELECT source AS "group", max(n / total) AS rarity FROM c JOIN t USING (label) GROUP BY source'
)
def group_rarity(spark, sf_dir):
    return labels.group_rarity(labelled(spark, sf_dir).withColumnRenamed("source", "group"), "group")


@query(
    "WITH r AS (SELECT doc_id % 5 AS split FROM documents) SELECT split::VARCHAR AS split, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share "
    "FROM r GROUP BY split UNION ALL SELECT '(all)', count(*), 1.0::DOUBLE FROM r"
)
def split_summary(spark, sf_dir):
    return summary.split_summary(labelled(spark, sf_dir))


LANGS = ("de", "en", "es", "fr")


@query(
    f"WITH {GRID}, r AS (SELECT split::VARCHAR AS split, label, n / n_split AS share FROM grid UNION ALL SELECT DISTINCT '(all)', label, n_label / n_total FROM grid) "
    "SELECT split, " + ", ".join(f"max(share) FILTER (label = '{x}') AS {x}" for x in LANGS) + " FROM r GROUP BY split"
)
def label_table(spark, sf_dir):
    return summary.label_table(labelled(spark, sf_dir), list(LANGS))


@query(f"WITH {GRID} SELECT split::VARCHAR AS split, round(max(abs(n / n_split - n_label / n_total) * 100), 9) AS gap FROM grid GROUP BY split")
def label_gap(spark, sf_dir):
    return summary.label_gap(labelled(spark, sf_dir)).select("split", F.round("gap", 9).alias("gap"))


@query(
    f'WITH {GRID}, d AS (SELECT n_split, abs(n / n_split - n_label / n_total) / (n_label / n_total) AS off FROM grid) SELECT round(avg(off), 9) AS mean, '
    "round(max(off), 9) AS worst, min(n_split) AS smallest, max(n_split) AS largest FROM d"
)
def label_share_deviation(spark, sf_dir):
    found = summary.label_share_deviation(labelled(spark, sf_dir), "split")
    return found.select(F.round("mean", 9).alias("mean"), F.round("worst", 9).alias("worst"), "smallest", "largest")


@query(
    "SELECT k::INTEGER AS fold, CASE WHEN doc_id % 5 = k THEN 'test' ELSE 'train' END AS role, doc_id FROM documents, unnest(range(5)) u(k)"
)
def fold_membership(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("fold"))
    return folds.fold_membership(rows, "doc_id", 5)


RANDOM = (
    "cut AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY md5('0:' || doc_id)) <= floor(0.8 * (SELECT count(*) FROM documents)) AS t FROM documents)"
)


@query(f"WITH {RANDOM} SELECT id AS doc_id, CASE WHEN t THEN 'train' ELSE 'test' END AS split FROM cut")
def random_split(spark, sf_dir):
    return folds.random_split(table(spark, sf_dir, "documents"), "doc_id", 0.8, 0)


@query(f"WITH {RANDOM}, {cross_sql('SELECT id, text FROM cut WHERE t', 'SELECT id, text FROM cut WHERE NOT t', THRESHOLD)} {REPORT.format(t=THRESHOLD)}")
def random_split_leakage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = checkpoint(folds.random_split(docs, "doc_id", 0.8, 0))
    (found,) = pairs.split_duplicates(docs, [split], "doc_id", threshold=THRESHOLD)
    return audit.report(checkpoint(found), split.where("split = 'test'"), split.where("split = 'train'"), THRESHOLD)


SEEDS = (0, 1, 2, 3, 4)


def _seed_sql(seed: int) -> str:
    cut = RANDOM.replace("'0:'", f"'{seed}:'")
    return f"SELECT n_test, exact, fraction FROM (WITH {cut}, {cross_sql('SELECT id, text FROM cut WHERE t', 'SELECT id, text FROM cut WHERE NOT t', THRESHOLD)} {REPORT.format(t=THRESHOLD)})"


@query(
    f"WITH s AS ({' UNION ALL '.join(map(_seed_sql, SEEDS))}) SELECT round(avg(fraction), 9) AS mean, min(fraction) AS least, max(fraction) AS most, "
    "round(avg(exact / n_test), 9) AS mean_exact FROM s"
)
def random_leakage_range(spark, sf_dir):
    found = evaluate.leakage_range(evaluate.random_leakage(table(spark, sf_dir, "documents"), "doc_id", seeds=SEEDS))
    return found.select(F.round("mean", 9).alias("mean"), "least", "most", F.round("mean_exact", 9).alias("mean_exact"))


@query("SELECT count(DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS n_distinct FROM documents")
def distinct_texts(spark, sf_dir):
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return table(spark, sf_dir, "documents").agg(F.countDistinct(flat).alias("n_distinct"))


@query(
    "WITH n AS (SELECT count(*) AS n FROM customer) SELECT s::INTEGER AS split, (CASE s WHEN 0 THEN floor(n * 0.7 + 1e-9) WHEN 1 THEN floor(n * 0.2 + 1e-9) "
    "ELSE n - floor(n * 0.7 + 1e-9) - floor(n * 0.2 + 1e-9) END)::BIGINT AS n FROM n, unnest(range(3)) u(s)"
)
def assign_counts(spark, sf_dir):
    """Groups of one row each: the targets are met exactly."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))
    return assign.assign_groups(rows, [0.7, 0.2, 0.1]).groupBy("split").agg(F.count("*").alias("n"))


def _split(spark, sf_dir, near: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return folds.assign_splits(docs, "doc_id", label_cols=("lang",), groups_col=None, ratios=RATIOS, near=near).select("doc_id", "split")


@query()
def assign_splits(spark, sf_dir):
    return _split(spark, sf_dir)


def _folded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The groups and the folds of one ``NearDupKFold``, which groups once."""
    docs, five = table(spark, sf_dir, "documents"), folds.NearDupKFold(5)
    return five.near_duplicate_groups(docs, "doc_id"), checkpoint(five.fold_ids(docs, "doc_id", label_cols=("lang",)))


@query()
def kfold_ids(spark, sf_dir):
    return folds.NearDupKFold(5).fold_ids(table(spark, sf_dir, "documents"), "doc_id", label_cols=("lang",))


def _shares_sql(split: str, ratio: str, splits: str) -> str:
    """For all rows and each language: how many there are and the most in one group, for each split."""
    return (
        f"{NEAR}, own AS (SELECT group_id, lang AS label, count(*) AS n FROM grouped JOIN documents USING (doc_id) GROUP BY ALL "
        "UNION ALL SELECT group_id, '(rows)', count(*) FROM grouped GROUP BY ALL), t AS (SELECT label, sum(n)::BIGINT AS total, max(n) AS largest FROM own GROUP BY label) "
        f"SELECT label, {split} AS split, total, largest, {ratio} AS ratio, true AS near FROM t, {splits}"
    )


def _shares(spark, sf_dir, near: DataFrame, placed: DataFrame, ratios: dict) -> DataFrame:
    """For all rows and for each language, and each split: whether the split is nearer to its share than the largest group."""
    lang = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array("lang", F.lit("(rows)"))).alias("label"))
    every = checkpoint(lang.join(near, "doc_id").join(placed, "doc_id"))
    sizes = every.groupBy("label", "group_id").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    held = every.groupBy("label").pivot("split", list(ratios)).count().na.fill(0)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(r).alias("ratio"), F.col(f"`{s}`").alias("n")) for s, r in ratios.items()])).alias("x")
    rows = held.select("label", each).select("label", "x.*").join(sizes, "label")
    near = (F.abs(F.col("n") - F.col("ratio") * F.col("total")) <= F.col("largest")).alias("near")
    return rows.select("label", "split", "total", "largest", "ratio", near)


@query(_shares_sql(split="s", ratio="r", splits="(VALUES ('train', 0.8::DOUBLE), ('test', 0.2::DOUBLE)) u(s, r)"))
def assign_shares(spark, sf_dir):
    near = checkpoint(near_duplicate_groups(spark, sf_dir))
    return _shares(spark, sf_dir, near, checkpoint(_split(spark, sf_dir, near)), RATIOS)


@query(_shares_sql(split="s::INTEGER", ratio="0.2::DOUBLE", splits="unnest(range(5)) u(s)"))
def kfold_shares(spark, sf_dir):
    near, found = _folded(spark, sf_dir)
    return _shares(spark, sf_dir, near, found.withColumnRenamed("fold", "split"), dict.fromkeys(range(5), 0.2))


@query("SELECT 0::BIGINT AS n_groups_in_two_splits")
def assign_straddle(spark, sf_dir):
    near = checkpoint(near_duplicate_groups(spark, sf_dir))
    split = _split(spark, sf_dir, near)
    apart = near.join(split, "doc_id").groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return apart.agg(F.count("*").alias("n_groups_in_two_splits"))


@query("SELECT 0::BIGINT AS leaked")
def post_split_leaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    (found,) = pairs.split_duplicates(docs, [checkpoint(_split(spark, sf_dir))], "doc_id", threshold=THRESHOLD)
    return found.agg(F.count("*").alias("leaked"))


@query(f"{NEAR} SELECT group_id, count(*) AS n_rows, 1::BIGINT AS n_splits FROM grouped GROUP BY group_id")
def assign_groups_kept(spark, sf_dir):
    """Every group of the corpus with its rows and in how many splits they are."""
    near = checkpoint(near_duplicate_groups(spark, sf_dir))
    both = near.join(_split(spark, sf_dir, near), "doc_id")
    return both.groupBy("group_id").agg(F.count("*").alias("n_rows"), F.count_distinct("split").alias("n_splits"))


@query(f"{NEAR} SELECT doc_id, group_id, 1::BIGINT AS n_test, 4::BIGINT AS n_train, 1::BIGINT AS n_folds_of_group FROM grouped")
def kfold_roles(spark, sf_dir):
    """Every document is test in one of five folds and train in the others, and its group is in one fold."""
    near, found = _folded(spark, sf_dir)
    of = near.join(found, "doc_id").groupBy("group_id").agg(F.count_distinct("fold").alias("n_folds_of_group"))
    roles = folds.fold_membership(found, "doc_id", 5).groupBy("doc_id")
    roles = roles.agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"))
    return near.join(of, "group_id").join(roles, "doc_id").select("doc_id", "group_id", "n_test", "n_train", "n_folds_of_group")


@query(
    "WITH t AS (SELECT c_mktsegment AS label, count(*) AS total FROM customer GROUP BY ALL) SELECT label, s::INTEGER AS split, total, true AS near FROM t, unnest(range(3)) u(s)"
)
def assign_label_shares(spark, sf_dir):
    """Groups of one row with one label: each split has its share of each label, to less than three rows."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.array("c_mktsegment").alias("labels"), F.col("c_mktsegment").alias("label"))
    ratios = F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1))
    found = rows.join(assign.assign_groups(rows, [0.7, 0.2, 0.1], labels_col="labels"), "group_id").groupBy("label", "split").agg(F.count("*").alias("n"))
    totals = rows.groupBy("label").agg(F.count("*").alias("total"))
    near = F.abs(F.col("n") - F.col("total") * F.get(ratios, F.col("split"))) < 3
    return found.join(totals, "label").select("label", "split", "total", near.alias("near"))


@query("SELECT 0.0::DOUBLE AS mean, 0.0::DOUBLE AS most, 5::BIGINT AS n_seeds FROM (SELECT 1)")
def engine_leakage_range(spark, sf_dir):
    """The leak of the engine's own splits for the same seeds as ``random_leakage_range``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = evaluate.split_leakage(docs, "doc_id", seeds=SEEDS)
    return found.agg(F.avg("fraction").alias("mean"), F.max("fraction").alias("most"), F.count("*").alias("n_seeds"))


@query(
    f"WITH {CROSS} SELECT n_train, n_test, leaked, exact, round(fraction, 9) AS fraction, leaked AS n_pairs, "
    f"(SELECT round(sum(round(similarity, 4)), 6) FROM found) AS similarities FROM ({REPORT.format(t=THRESHOLD)})"
)
def report_json(spark, sf_dir):
    """The lines of the JSON report, read back one by one."""
    train, test = sides(spark, sf_dir)
    found = checkpoint(pairs.find_cross_duplicates(train, test, "doc_id", threshold=THRESHOLD))
    lines = checkpoint(audit.report_lines(audit.report(found, test, train, THRESHOLD), found))
    counts = "n_train bigint, n_test bigint, leaked bigint, exact bigint, fraction double"
    head = lines.where(F.col("value").startswith('{"n_train"')).select(F.from_json(F.concat("value", F.lit("]}")), counts).alias("r")).select("r.*")
    pair = F.from_json(F.ltrim(F.col("value"), F.lit(",")), "train bigint, test bigint, similarity double")
    body = lines.where(F.col("value").rlike('^,?[{]"train"')).select(pair.alias("p"))
    body = body.agg(F.count("p.test").alias("n_pairs"), F.round(F.sum(F.col("p.similarity").cast("decimal(20, 4)")).cast("double"), 6).alias("similarities"))
    return head.withColumn("fraction", F.round("fraction", 9)).join(body, F.lit(True))  # one row each


@query(
    "WITH d AS (SELECT count(*) AS n_rows, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS n_chars, "
    "sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines FROM documents) SELECT kind, d.* FROM d, unnest(['csv', 'tsv', 'jsonl', 'parquet']) u(kind)"
)
def file_round_trip(spark, sf_dir):
    """The documents written in each format and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    found = []
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        io.write_rows(docs, f"{folder}/documents.{kind}")
        rows = io.read_rows(spark, f"{folder}/documents.{kind}")
        lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
        sums = (F.sum(F.col("doc_id").cast("bigint")).alias("ids"), F.sum(F.length("text")).alias("n_chars"), F.sum(lines).alias("n_lines"))
        found.append(rows.agg(F.count("*").alias("n_rows"), *sums).select(F.lit(kind).alias("kind"), "n_rows", "ids", "n_chars", "n_lines"))
    return reduce(DataFrame.unionByName, found)


@query()
def cross_validation(spark, sf_dir):
    """A plain classifier of the labels' quality over folds that keep near-duplicates together."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    found = checkpoint(folds.NearDupKFold(3).fold_ids(rows, "doc_id", label_cols=("quality",)))
    return evaluate.cross_validate(rows, found, "doc_id", "quality")
