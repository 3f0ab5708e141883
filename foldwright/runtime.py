"""Session helpers shared by every operator: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys (8 to 16 bytes each) that may be broadcast: about 16 MB at most.
BROADCAST_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``. Where none is named, a local master gets a temporary one;
    on a cluster that would be another folder on each machine, so it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foldwright-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet below the shared checkpoint folder and continue from there.

    Like ``checkpoint`` for wide rows: a third of the disk, and later readers fetch only the columns they need.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow ``df`` for broadcast when it has at most ``rows`` rows; leave a larger one to a shuffled join.

    Counts ``df`` once, so pass a checkpointed or cheap frame.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
