"""Secret scans over an incremental blob ledger.

A blob is a whole text under its SHA-256. The ledger is a Parquet folder that says for which rule versions each blob
was read already and what they found. A scan joins the ledger with the blobs' addresses, reads where they lie only the
texts that lack the current version of some rule, appends what it finds and joins the findings back to all rows that
hold a blob: to ids of documents as well as to every path and version of a history.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import chunks, read
from foldwright.runtime import broadcast_if_small, checkpoint, ensure_checkpoint_dir, written

#: Rule name -> (version, pattern, the group that is measured, its least length). In report order.
RULES = {
    "assign": (1, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]{24,}", 0, 24),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", 0, 60),
    "github": (1, r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
}
BASE = ("assign", "access", "hex")
ORDER = {name: k for k, name in enumerate(RULES)}

#: A ledger row: a blob, the "rule:version" pairs that one scan read it for, and what they found.
FOUND = "array<struct<rule: string, start: bigint, stop: bigint>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"
#: Findings that may be broadcast to the rows, and addresses of unread blobs: about 100 bytes each.
BROADCAST_FINDINGS = 100_000


def find(text: str, rule: tuple) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of a rule whose measured group is long enough; code points, end exclusive."""
    _, pattern, group, least = rule
    return [m.span() for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]


def address(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blob``, the SHA-256 of the whole text; null texts are empty blobs."""
    return docs.withColumn("blob", F.sha2(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"), 256))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _current() -> list[str]:
    return [f"{name}:{rule[0]}" for name, rule in RULES.items()]


def unseen(docs: DataFrame, ledger: DataFrame, text_col: str = "text") -> DataFrame:
    """``(blob, rules)``: each blob once, with the "rule:version" pairs that the ledger lacks; others not at all.

    Only addresses are moved; a blob that fills a third of the table is one address a task.
    """
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    blobs = address(docs.select(text_col), text_col).select("blob").distinct().join(seen, "blob", "left")
    lacking = F.array_except(F.array(*map(F.lit, _current())), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.select("blob", lacking.alias("rules")).where("size(rules) > 0")


def unread(docs: DataFrame, ledger: DataFrame, text_col: str = "text") -> DataFrame:
    """``(blob, text, rules)``: the rows whose blob lacks a rule. Copies of a blob are left to the reader to skip.

    With an empty ledger that is every row as it lies, no address is compared; else rows are kept by their address, and
    texts move only if more blobs are unread than may be broadcast.
    """
    rows = address(docs.select(F.col(text_col).alias("text")), "text")
    if ledger.isEmpty():
        return rows.select("blob", "text", F.array(*map(F.lit, _current())).alias("rules"))
    todo = broadcast_if_small(written(unseen(docs, ledger, text_col)), BROADCAST_FINDINGS)
    return rows.join(todo, "blob").select("blob", "text", "rules")


def scan(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Appends to the ledger at ``path`` what it lacks of ``docs``; returns its current ``(blob, found)``, hits only.

    A task reads each blob once; what several tasks found in copies of one blob is one entry.
    """
    spark = docs.sparkSession
    current = dict(RULES)  # goes to the tasks with the function
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        read_already: set[bytes] = set()  # 32 bytes for each blob of the partition
        for batch, texts in chunks(batches, "text"):
            blobs, rules, taken, found = batch.column("blob").to_pylist(), batch.column("rules").to_pylist(), [], []
            for i, (blob, text) in enumerate(zip(blobs, texts)):
                if (told := bytes.fromhex(blob)) not in read_already:
                    read_already.add(told)
                    taken.append(i)
                    names = [x.partition(":")[0] for x in rules[i]]
                    found.append([{"rule": n, "start": a, "stop": b} for n in names for a, b in find(text, current[n])])
            kept = batch.select(["blob", "rules"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, kind)], names=["blob", "rules", "found"])

    fresh = unread(docs, _table(spark, path, LEDGER), text_col).mapInArrow(run, LEDGER).dropDuplicates(["blob"])
    fresh.write.mode("append").parquet(path)
    entries = _table(spark, path, LEDGER).where("size(found) > 0").select("blob", F.posexplode("rules").alias("k", "rule"), "found")
    # A finding counts where its scan was made with the rule's current version.
    entries = entries.where(F.col("rule").isin(_current())).withColumn("rule", F.substring_index("rule", ":", 1))
    hits = entries.select("blob", F.expr("filter(found, x -> x.rule = rule)").alias("found"))
    return hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).where("size(found) > 0")


def secrets(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``(*keep, blob, found)`` for each row of ``docs``, ``found`` an array of ``(rule, start, stop)`` by start and rule.

    ``keep`` names a row: an id, or the path and the version of a history. Null texts are empty; texts without secrets
    have an empty array; null ids are kept; repeated rows give repeated results; an empty table gives none. Further
    columns are ignored.
    """
    found = broadcast_if_small(checkpoint(scan(docs, path, text_col)), BROADCAST_FINDINGS)
    rows = address(docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text")), "text").select("row", "blob")
    nothing = F.array().cast(FOUND)
    order = F.create_map(*[x for n, k in ORDER.items() for x in (F.lit(n), F.lit(k))])
    key = F.transform("found", lambda x: F.struct(x["start"], order[x["rule"]].alias("k"), x["rule"].alias("rule"), x["stop"]))
    ordered = F.transform(F.array_sort(key), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["stop"].alias("stop")))
    return rows.join(found, "blob", "left").withColumn("found", F.coalesce("found", nothing)).select("row.*", "blob", ordered.alias("found"))


def new_ledger(spark: SparkSession) -> str:
    """A fresh ledger folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ledger-{uuid.uuid4().hex}"


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets(read(spark, sf_dir, "documents"), new_ledger(spark))
    spans = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["stop"])), ",")
    base = F.filter("found", lambda x: x["rule"].isin(*BASE))
    count = lambda name: F.size(F.filter("found", lambda x: x["rule"] == name)).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(name).alias(f"n_{name}") for name in BASE),
        F.sha2(spans(base), 256).alias("base_sha256"),
        spans("found").alias("spans"),
    )


def secret_ledger_two_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after half of them have been scanned into the same ledger: the second scan reads only the other blobs."""
    docs, path = read(spark, sf_dir, "documents"), new_ledger(spark)
    scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), path)
    listed = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["rule"], x["start"], x["stop"])), ",")
    return secrets(docs, path).select("doc_id", F.size("found").cast("bigint").alias("n_found"), listed.alias("spans"))
