"""Interpolated joins with curves of any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.ranking import ROW_BITS, ROWS_PER_BIN, ranged
from tidemark.session import broadcast_if_small, materialize

TASK_ROWS = 200_000  # that a task deals out; smaller parts are cut inside it


def interpolated_rates(flows: DataFrame, points: DataFrame, key: str, t: str = "t", z: str = "z", out: str = "rate", rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """``flows`` (key, t, ...) with the rate of their curve at their time: linear between nodes, flat beyond both ends.

    Nodes (key, t, z) and the different times of the flows are laid in one order of curve and time and dealt out by range. Every row
    sees the last node before it and the next one after it inside its part; beyond that a curve's parts hand their outermost nodes
    on, one row per curve and part. So neither a curve nor the flows at one time gather in a task. Of nodes at one time the
    largest rate counts; flows without a curve, without a time or on a curve without nodes have no rate.
    """
    nodes = points.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col(z).cast("double").alias("z"))
    times = flows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.lit(None).cast("double").alias("z"))
    both = nodes.union(times).where("key is not null and t is not null").groupBy("key", "t").agg(F.max("z").alias("z"))
    dealt = ranged(materialize(both), ["key", "t"], max(rows_per_bin, TASK_ROWS))
    cut = F.floor((F.col("_at") - 1) / rows_per_bin)  # parts of fewer rows than a task's are stretches of its order
    dealt = dealt.select("key", "t", "z", (F.shiftleft("_part", ROW_BITS - 1) + cut).alias("_part"))
    node = F.when(F.col("z").isNotNull(), F.struct("t", "z"))
    part = Window.partitionBy("_part", "key").orderBy("t")
    near = dealt.select(
        "key", "t", "_part", F.last(node, ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)).alias("low"),
        F.first(node, ignorenulls=True).over(part.rowsBetween(0, Window.unboundedFollowing)).alias("high"),
    )
    ends = dealt.groupBy("key", "_part").agg(F.min(node).alias("first"), F.max(node).alias("last"))
    along = Window.partitionBy("key").orderBy("_part")  # the parts of a curve
    handed = ends.select(
        "key", "_part", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    whole = near.join(broadcast_if_small(materialize(handed)), ["key", "_part"])
    low, high = F.coalesce("low", "earlier"), F.coalesce("high", "later")
    slope = (high["z"] - low["z"]) / F.nullif(high["t"] - low["t"], F.lit(0.0))
    rate = F.coalesce(low["z"] + slope * (F.col("t") - low["t"]), low["z"], high["z"])
    rates = materialize(whole.select(F.col("key").alias("_key"), F.col("t").alias("_t"), rate.alias(out)))
    same = (F.col(key) == F.col("_key")) & (F.col(t).cast("double") == F.col("_t"))
    return flows.join(broadcast_if_small(rates), same, "left").drop("_key", "_t")
