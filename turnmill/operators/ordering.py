"""Row numbers, running totals and ranks over a whole table without one task that sees it all.

Rows are range partitioned and sorted by their keys and checkpointed, so that a
row's partition and place are fixed. What is joined back is one row per
partition: its offset.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE_BITS = 33  # monotonically_increasing_id holds the partition above these bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the session's folder; where none is set and Spark runs on this machine alone (tests), to one of it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="turnmill-"))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in order of ``keys`` with partition ``_p`` and place ``_k`` in it."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    fixed = ordered.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    place = F.col("_m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return fixed.withColumn("_p", F.shiftright("_m", _PLACE_BITS)).withColumn("_k", place).drop("_m")


def _with_offset(placed: DataFrame, value) -> DataFrame:
    """``_before``: the sum of ``value`` over all earlier partitions; as many rows as partitions are broadcast."""
    sums = placed.groupBy(F.col("_p").alias("_q")).agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_q", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sums), F.col("_p") == F.col("_q")).drop("_q")


def numbered(rows: DataFrame, *keys: str, name: str = "ord") -> DataFrame:
    """``rows`` with ``name``: their place from 0 in order of ``keys``, which must be unique."""
    placed = _with_offset(_placed(rows, list(keys)), F.lit(1))
    return placed.withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_p", "_k", "_before")


def average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ranks from 1; ties share their mean rank."""
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    within = Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("_c").over(within)
    ranks = _with_offset(_placed(counts, ["_v"]), F.col("_c")).select("_v", (upto - (F.col("_c") - 1) / 2).alias(name))
    return rows.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")
