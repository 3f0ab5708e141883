"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.runtime import broadcast_if_small, checkpoint


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its listed neighbours.

    Partial aggregation tames hot nodes in the minimum. ``least`` is dealt out anew so that both sides of the join get
    an exchange of their own, without which a skewed join can't be split at run time.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.join(least.repartition(n), "u")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node on an edge; ``component`` is the least node reachable.

    Edges may repeat, point either way or be loops; rows with a null end are dropped. An empty edge table gives an
    empty result. Each round moves every node to the least label its neighbours know (O(log n) rounds in practice);
    rounds are cut with a checkpoint in the shared folder. Nothing but one count and one hash reaches the driver.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    loops = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    current = checkpoint(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _with_minimum(_both_ways(current)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _with_minimum(large)
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        current = checkpoint(small)
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return loops.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_updates(labels: DataFrame, edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``(node, component)`` of the nodes that new ``edges`` add to ``labels``, a result of ``connected_components``, or whose
    component they change; what is left out stays as it is.

    The edges are contracted: each end is the component that it had, or itself. Components of those few ends say which old
    components are one now, so old edges aren't read again, and of the labels only those of ends and of what they join.
    Rows with a null end are dropped; edges may repeat, point either way or be loops.
    """
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = checkpoint(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null"))
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    known = labels.join(broadcast_if_small(checkpoint(ends)), "node", "left_semi")
    placed = checkpoint(ends.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("old"), F.col("component").isNull().alias("new")))
    named = lambda c: spread(placed.select(F.col("node").alias(c), F.col("old").alias(f"{c}_old")))
    joined = pairs.join(named("u"), "u").join(named("v"), "v")
    merged = connected_components(joined, "u_old", "v_old").withColumnRenamed("component", "now")
    merged = checkpoint(merged)
    added = placed.where("new").select("node", "old").join(spread(merged.withColumnRenamed("node", "old")), "old").select("node", F.col("now").alias("component"))
    changed = merged.where("node <> now").select(F.col("node").alias("component"), "now")
    moved = labels.join(broadcast_if_small(checkpoint(changed)), "component").select("node", F.col("now").alias("component"))
    return added.unionByName(moved)


def updated_components(labels: DataFrame, edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``(node, component)`` as ``connected_components`` of the old and the new edges gives it."""
    updates = checkpoint(component_updates(labels, edges, left, right))
    rest = labels.select("node", "component").join(updates.select("node"), "node", "left_anti")
    return rest.unionByName(updates)
