import json

import pytest
from pyspark.sql import functions as F

from foldwright import cli
from foldwright.operators import audit, labels
from foldwright.sources import io

ROWS = [
    ("The first message about the parcel that was lost on its way to the city", "x", "t1"),
    ("the first message about the parcel that was lost on its way to the city!", "x", None),
    ("A second text that has nothing to do with the others at all", "y", "t1"),
    ("Third one: a recipe for bread with flour, water, salt and a long night", "y", None),
    ("third one a recipe for bread with flour water salt and one long night", "x", None),
    ("Short note", "y", "t2"),
    ("Another short note, quite different", "x", "t2"),
    ("Weather will be fine tomorrow in most of the country", "y", None),
    ("Tickets for the concert are sold out since Monday", "x", None),
    ("He said \"no\", then\nleft; über 漢字", "y", None),
]


def write(path, rows, fields=("text", "label", "thread")):
    path.write_text("".join(json.dumps(dict(zip(fields, r))) + "\n" for r in rows))
    return str(path)


@pytest.mark.parametrize("name", ["a.csv", "a.tsv", "a.jsonl", "a.NDJSON", "a.json", "a.parquet"])
@pytest.mark.parametrize("single", [True, False])
def test_round_trip(spark, tmp_path, name, single):
    df = spark.createDataFrame([(r[0], i) for i, r in enumerate(ROWS)], "text string, n bigint")
    path = str(tmp_path / name)
    io.write_rows(df, path, single=single)
    got = io.read_rows(spark, path)
    assert sorted((r["text"], int(r["n"])) for r in got.collect()) == sorted((r[0], i) for i, r in enumerate(ROWS))
    io.write_rows(got, path, single=single)  # over what it was read from
    assert io.read_rows(spark, path).count() == len(ROWS)


def test_json_array_is_one_valid_file(spark, tmp_path):
    path = tmp_path / "x.json"
    for n in (0, 1, 3):
        io.write_rows(spark.createDataFrame([(i, None if i else "ü") for i in range(n)], "i int, s string"), str(path))
        assert json.loads(path.read_text()) == [{"i": i, "s": None if i else "ü"} for i in range(n)]


def test_json_array_from_many_tasks(spark, tmp_path):
    """Tasks write the parts, in order; no plan brings all rows to one."""
    for n, parts in ((1000, 7), (3, 8), (0, 3)):
        df = spark.range(n, numPartitions=parts)
        io.write_rows(df, str(tmp_path / "x.json"))
        assert json.loads((tmp_path / "x.json").read_text()) == [{"id": i} for i in range(n)]
        lines = io.array_lines(df.select(F.to_json(F.struct("*"))))
        assert lines.rdd.getNumPartitions() >= parts and "SinglePartition" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]


def test_a_report_of_many_pairs_is_written_in_order(spark, tmp_path):
    pairs = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("test_id"), F.col("id").alias("train_id"), (F.col("id") / 5000).alias("similarity")).repartition(6)
    report = audit.LeakageReport(10, 5000, 0.8, 5000, 0, pairs)
    io.write_lines(report.lines(), str(tmp_path / "report.txt"))
    got = json.loads((tmp_path / "report.txt").read_text())
    assert [p["test"] for p in got["pairs"]] == list(range(5000)) and got == report.to_dict()
    plan = report.lines()._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and report.lines().rdd.getNumPartitions() > 2


def test_nested_values_and_empty_fields(spark, tmp_path):
    io.write_rows(spark.createDataFrame([(["a", "b"], "")], "l array<string>, s string"), str(tmp_path / "x.csv"), single=True)
    row = io.read_rows(spark, str(tmp_path / "x.csv")).first()
    assert json.loads(row["l"]) == ["a", "b"] and row["s"] == ""


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_rows(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        io.read_rows(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n3\n')
    with pytest.raises(Exception):
        io.read_rows(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(TypeError):
        io.from_values(spark, ["a", 3])
    import numpy as np

    with pytest.raises(TypeError):
        io.from_values(spark, np.zeros((2, 2)))
    assert io.from_values(spark, np.array(["a", "b"], object)).count() == 2


def test_row_ids_follow_the_file(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", ROWS)
    assert [r["text"] for r in io.with_row_id(io.read_rows(spark, path)).orderBy("row_id").collect()] == [r[0] for r in ROWS]


def parts(path):
    return [json.loads(x) for f in sorted(path.glob("part-*.json")) for x in f.read_text().splitlines()]


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("more,column,names", [([], "split", {"train", "test"}), (["--folds", "3"], "fold", {0, 1, 2}), (["--ratios", "a=0.5,b=0.5", "--column", "to"], "to", {"a", "b"})])
def test_a_split_file_has_no_leak(spark, tmp_path, capsys, more, column, names, single):
    """Whatever the target: rows keep their order and fields, what belongs together stays, and an audit finds nothing."""
    source, out = write(tmp_path / "rows.jsonl", ROWS), tmp_path / "out.jsonl"
    args = ["split", source, "-o", str(out), "--label-field", "label", "--group-field", "thread", *more, *["--single"] * single]
    assert cli.main(args, spark) == 0
    said = capsys.readouterr().out
    assert "6 groups" in said and all(f"\n  {n}" in said for n in names)
    rows = [json.loads(x) for x in out.read_text().splitlines()] if single else parts(out)
    assert [(r["text"], r["label"], r["thread"]) for r in rows] == ROWS and {r[column] for r in rows} == names
    place = [r[column] for r in rows]
    assert place[0] == place[1] == place[2] and place[3] == place[4] and place[5] == place[6]
    for one in names:
        rest = ",".join(str(n) for n in names - {one})
        assert cli.main(["audit", str(out), "--split-field", column, "--train", rest, "--test", str(one)], spark) == 0


def test_an_audit_says_what_leaks(spark, tmp_path, capsys):
    train, test = write(tmp_path / "old.jsonl", ROWS[2:5]), write(tmp_path / "new.jsonl", [ROWS[4], ROWS[7], ROWS[3], ROWS[9], ROWS[0]])
    codes = [cli.main(["audit", train, test, "--max-leak", str(x)], spark) for x in (0.0, 0.39, 0.4, 1.0)]
    assert codes == [1, 1, 0, 0]
    said = capsys.readouterr().out
    assert "5 test rows against 3 train rows" in said and "leaked: 2 (40.0%)" in said and "Third one" in said
    assert cli.main(["audit", train, test, "--json", "--max-leak", "1"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert [p["test"] for p in report["pairs"]] == [0, 2] and report["exact"] == 2 and report["n_train"] == 3


def test_a_failed_write_keeps_what_was_there(spark, tmp_path):
    path = tmp_path / "kept.jsonl"
    io.write_rows(spark.range(3), str(path))
    broken = spark.range(3).select(F.raise_error(F.lit("broken on purpose")).alias("x"))
    with pytest.raises(Exception, match="on purpose"):
        io.write_rows(broken, str(path))
    assert io.read_rows(spark, str(path)).count() == 3 and not list(tmp_path.glob("*.old"))


def test_row_ids_of_many_partitions(spark):
    df = spark.range(1000, numPartitions=7).withColumnRenamed("id", "place").withColumn("row_id", F.lit("mine"))
    got = io.with_row_id(df, "n").collect()
    assert sorted((r["n"], r["place"]) for r in got) == [(i, i) for i in range(1000)] and got[0]["row_id"] == "mine"
    assert io.with_row_id(spark.createDataFrame([], "a int")).count() == 0


def test_a_broken_line_is_named(spark, tmp_path):
    for lines, n in ((['{"a": 1}', "", '{"a": ', '{"a": 2}'], 3), (['{"a": 1}', "[1]"], 2), (["nonsense"], 1)):
        (tmp_path / "b.jsonl").write_text("\n".join(lines) + "\n")
        with pytest.raises(ValueError, match=f"b.jsonl:{n}"):
            io.read_rows(spark, str(tmp_path / "b.jsonl")).collect()


def test_maps_with_equal_entries_are_equal_keys(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert df.select(labels.group_key(df, "m").alias("k")).distinct().count() == 1


@pytest.mark.parametrize(
    "args", [["audit", "none.jsonl"], ["audit", "a", "b", "c"], ["split", "DATA", "-o", "x.jsonl", "--folds", "1"], ["split", "DATA", "-o", "x.jsonl", "--text-field", "no"], ["split", "DATA", "-o", "x.jsonl", "--folds", "50"], ["audit", "DATA", "--split-field", "label"]]
)
def test_errors_exit_with_two(spark, tmp_path, capsys, args):
    path = write(tmp_path / "a.jsonl", ROWS)
    assert cli.main([path if a == "DATA" else a for a in args], spark) == 2
    assert "error" in capsys.readouterr().err


def test_wrong_ratios():
    for text in ("a=0.5", "a=0.5,a=0.5", "a=1.5,b=-0.5", "=1", "x"):
        with pytest.raises(SystemExit):
            cli.build_parser().parse_args(["split", "d", "-o", "o", "--ratios", text])
