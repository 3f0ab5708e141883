import hashlib
import os
import subprocess
import sys

from foldwright.llm import stages
from foldwright.llm.common import read
from foldwright.runtime import written

from . import test_decontaminate, test_pii
from .fixtures import edge_table, empty_table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_stage_decides_on_its_own_input(spark):
    data = "/root/testdata/sf0.001"
    docs = read(spark, data, "documents")
    columns, items = docs.columns, [(r["item_id"], r["text"]) for r in read(spark, data, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(stages.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, data))
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(after) and set(after) <= set(before)
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert all(after[i]["text"] == before[i] for i in after)
        if name == "quality classifier":
            bad = {r["doc_id"] for r in read(spark, data, "labels").collect() if r["quality"] == 0}
            good = {r["doc_id"] for r in read(spark, data, "labels").collect() if r["quality"] == 1}
            assert len(bad & set(after)) <= 1 + len(bad) // 5 and len(good - set(after)) <= 1 + len(good) // 20
        if name == "SimHash near-dedup":
            from foldwright.llm.simhash import fingerprint

            fps = {i: fingerprint(t) for i, t in before.items()}
            for i in before:
                close = {j for j in before if bin(fps[i] ^ fps[j]).count("1") <= 3}
                assert (i in after) or any(j < i for j in close)
            assert all(bin(fps[i] ^ fps[j]).count("1") > 3 for i in after for j in after if i < j)
        if name == "benchmark decontamination":
            runs = {tuple(w[j : j + 13]) for _, t in items for w in [test_decontaminate.words(t)] for j in range(len(w) - 12)}
            for i in after:
                w = test_decontaminate.words(before[i])
                assert not any(tuple(w[j : j + 13]) in runs for j in range(len(w) - 12))
            dropped = sorted(set(before) - set(after), key=lambda i: len(before[i]))
            assert dropped and all(test_decontaminate.brute([(i, before[i])], items) for i in dropped[:3])
        if name == "PII":
            for i, text in before.items():
                spans, at, want = test_pii.brute(text), 0, ""
                for start, _, stop, kind in spans:
                    if start >= at:
                        want, at = want + text[at:start] + f"<{kind.upper()}>", stop
                assert after[i]["text"] == want + text[at:] and after[i]["n_chars"] == len(after[i]["text"])
        if k == 4:
            assert all(r["decoded_sha256"] == hashlib.sha256(before[i].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for i, r in after.items())
    assert len(texts) > len(after) > 0


def test_stages_take_edges_and_empty_tables(spark, data):
    for table in (edge_table(spark), empty_table(spark)):
        docs = table.select("doc_id", "text", "label", "kind").withColumnRenamed("label", "lang").withColumn("n_chars", table["doc_id"])
        for k, (_, stage) in enumerate(stages.STAGES):
            got = written(stage(spark, docs, data))
            assert k == 4 or got.columns == docs.columns
            docs = docs if k == 4 else got


def test_run(spark, data):
    import corpus_pipeline

    assert corpus_pipeline.STAGES is stages.STAGES
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and got.count() > 100


def test_entry_works_without_this_subpackage(tmp_path):
    """Everything but the two llm folders and the pipeline, in a copy."""
    for name in ("foldwright", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "foldwright" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'near_duplicate_groups' in q and not [n for n in q if n.startswith('op')], q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
