"""Reading and writing rows as CSV, TSV, JSON Lines, JSON and Parquet, by the suffix of the path."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from foldwright.runtime import checkpoint

#: Suffix -> kind of file.
KINDS = {".csv": "csv", ".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".parquet": "parquet"}


def kind_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in KINDS:
        raise ValueError(f"{path}: the name must end in one of {', '.join(KINDS)}")
    return KINDS[suffix]


def _text_options(kind: str) -> dict:
    return {"header": True, "multiLine": True, "quote": '"', "escape": '"', "sep": "\t" if kind == "tsv" else ",", "encoding": "UTF-8"}


def _file(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark._jsc.hadoopConfiguration())


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows and columns of a file or a folder of files. CSV and TSV fields are strings, an empty one is "".

    A missing path is a FileNotFoundError; broken JSON is a ValueError, which names the line in JSON Lines.
    """
    kind = kind_of(path)
    name, system = _file(spark, path)
    if not system.exists(name):
        raise FileNotFoundError(path)
    if kind in ("csv", "tsv"):
        df = spark.read.options(**_text_options(kind)).csv(path)
        return df.na.fill("")
    if kind == "parquet":
        return spark.read.parquet(path)
    try:
        df = spark.read.options(mode="FAILFAST", multiLine=kind == "json").json(path)
    except (PySparkException, Py4JJavaError) as error:
        n = broken_line(spark, path) if kind == "jsonl" else None
        raise ValueError(f"{path}{'' if n is None else f':{n}'}: no JSON object") from error
    if kind == "jsonl" and not df.columns and (n := broken_line(spark, path)) is not None:
        raise ValueError(f"{path}:{n}: no JSON object")
    return df


def broken_line(spark: SparkSession, path: str) -> int | None:
    """The number, from 1, of the first line that is neither blank nor a JSON object."""
    lines = with_row_id(spark.read.text(path), "line")
    bad = (F.trim("value") != "") & (F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{"))
    first = lines.where(bad).agg(F.min("line").alias("n")).first()["n"]
    return None if first is None else first + 1


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """``df`` with the place of each row in reading order, from 0.

    Rows are written once with their partition and their place in it; a row for each partition says where it begins.
    """
    named = "place"
    while named in df.columns or named == out:
        named += "_"
    placed = checkpoint(df.withColumn(named, F.monotonically_increasing_id()))  # partition * 2 ** 33 + place
    part = F.shiftright(named, 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    begins, total = {}, 0
    for r in sizes:
        begins[r["part"]], total = total, total + r["n"]
    spark = df.sparkSession
    known = spark.createDataFrame(list(begins.items()), "part bigint, begin bigint")
    rows = placed.select(F.struct(*df.columns).alias("row"), part.alias("part"), F.col(named).bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    numbered = rows.join(F.broadcast(known), "part")
    return numbered.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out), (F.col("begin") + F.col("at")).alias(out))


def from_values(spark: SparkSession, values, text_col: str = "text", out: str = "row_id") -> DataFrame:
    """``(row_id, text)`` of a list, tuple, one-dimensional array or series of strings; anything else is a TypeError."""
    if hasattr(values, "tocsr") or getattr(values, "ndim", 1) != 1:
        raise TypeError("texts must be one-dimensional; give the raw texts, not a matrix")
    texts = list(values.tolist() if hasattr(values, "tolist") else values)
    wrong = next((x for x in texts if not isinstance(x, str)), None)
    if wrong is not None:
        raise TypeError(f"texts must be strings, not {type(wrong).__name__}")
    return spark.createDataFrame(list(enumerate(texts)), f"{out} bigint, {text_col} string")


def array_lines(values: DataFrame, opening: str = "[", closing: str = "]") -> DataFrame:
    """``(value)``: lines that are a JSON array of the JSON texts in the first column of ``values``, in the order of its
    partitions. A line for each text, so any number of tasks can write them."""
    spark = values.sparkSession
    line = lambda text: spark.createDataFrame([(text,)], "value string")
    placed = checkpoint(values.select(F.col(f"`{values.columns[0]}`").alias("value"), F.monotonically_increasing_id().alias("at")))
    first = placed.agg(F.min("at").alias("at")).first()["at"]
    body = placed.select(F.when(F.col("at") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    return line(opening).union(body).union(line(closing))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes the one text column of ``lines`` as one file, in the order of its partitions. Tasks write parts, which the
    file system joins; where it can't, their bytes are copied one after the other."""
    spark, aside = lines.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    lines.write.text(aside)
    source, system = _file(spark, aside)
    _replace(spark, system, _joined(spark, system, source), path)
    system.delete(source, True)


def _joined(spark: SparkSession, system, source):
    """The part files of a folder as one file in it, in the order of their names."""
    found = sorted((s for s in system.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    parts = [s.getPath() for s in found if s.getLen() > 0] or [found[0].getPath()]
    if len(parts) == 1:
        return parts[0]
    gateway = spark.sparkContext._gateway
    rest = gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
    for k, part in enumerate(parts[1:]):
        rest[k] = part
    try:
        system.concat(parts[0], rest)
        return parts[0]
    except UnsupportedOperationException:
        pass
    whole = spark._jvm.org.apache.hadoop.fs.Path(source, "joined")
    out = system.create(whole)
    try:
        for part in parts:
            stream = system.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()
    return whole


def write_rows(df: DataFrame, path: str, *, single: bool = False) -> None:
    """Writes ``df`` by the suffix of ``path``: a folder of part files, or one file with ``single``, for small results.

    The rows are written beside the target, then take its place, and only then the old ones go: a file may be written
    over what it was read from, and what was there outlives a write that fails. CSV and TSV have
    nested values as JSON; JSON keeps non-ASCII characters; a ``.json`` file is an array and always a single file, whose
    parts many tasks write.
    """
    kind = kind_of(path)
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    if kind in ("csv", "tsv"):
        nested = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
        flat = df.withColumns({c: F.to_json(c) for c in nested})
        (flat.coalesce(1) if single else flat).write.options(**{k: v for k, v in _text_options(kind).items() if k != "multiLine"}).csv(aside)
    elif kind == "parquet":
        (df.coalesce(1) if single else df).write.parquet(aside)
    elif kind == "jsonl":
        (df.coalesce(1) if single else df).write.option("ignoreNullFields", False).json(aside)
    else:
        return write_lines(array_lines(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))), path)
    source, system = _file(spark, aside)
    made = source
    if single:
        made = next(s.getPath() for s in system.listStatus(source) if s.getPath().getName().startswith("part-"))
    _replace(spark, system, made, path)
    if single:
        system.delete(source, True)


def _replace(spark: SparkSession, system, made, path: str) -> None:
    """Moves ``made`` to ``path``; what is there steps aside first and comes back if that fails."""
    target, _ = _file(spark, path)
    old, _ = _file(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
    there = system.exists(target)
    if there and not system.rename(target, old):
        raise OSError(f"{path}: cannot be replaced")
    if not system.rename(made, target):
        if there:
            system.rename(old, target)
        raise OSError(f"{path}: cannot be written")
    if there:
        system.delete(old, True)
