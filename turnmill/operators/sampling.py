"""Samples of pairs and of judged items, drawn by md5 so that every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order
from .neighbours import dot, edges, present
from .ordering import ensure_checkpoint_dir
from .stats import banded, per_band


def _draw(seed: int, n: int, *key) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(max(1, n)))


def stratified_pairs(vectors: DataFrame, n_pairs: int, n_bins: int = 10, seed: int = 42, neighbours: int = 14) -> DataFrame:
    """(bin, i, j, cos): up to n_pairs / n_bins pairs of each bin of cosines, over vectors numbered from 0.

    Candidates are six random draws a wanted pair, and each row's nearest
    neighbours for the bins that random pairs miss; a pair found twice counts twice.
    """
    vectors = present(vectors)
    n = vectors.count()
    draws = vectors.sparkSession.range(n_pairs * 6).withColumnRenamed("id", "d")
    draws = draws.select(F.concat_ws(":", F.lit("draw"), "d").alias("key"), _draw(seed, n, "d", F.lit("i")).alias("i"), _draw(seed, n, "d", F.lit("j")).alias("j"))
    a = vectors.select(F.col("ord").alias("i"), F.col("v").alias("vi"))
    b = vectors.select(F.col("ord").alias("j"), F.col("v").alias("vj"))
    drawn = draws.where("i <> j").join(a, "i").join(b, "j").select("key", "i", "j", dot(F.col("vi"), F.col("vj")).alias("cos"))
    near = edges(vectors, k=neighbours).select(F.concat_ws(":", F.lit("near"), "i", "j").alias("key"), "i", "j", "cos")
    place = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), (F.col("cos") * n_bins).cast("int")))
    every = drawn.unionByName(near).withColumn("bin", place)
    nth = F.row_number().over(Window.partitionBy("bin").orderBy(md5_order(seed, F.col("key")), "key"))
    return every.withColumn("nth", nth).where(F.col("nth") <= max(1, n_pairs // n_bins)).select("bin", "i", "j", "cos")


def banded_items(vectors: DataFrame, records: DataFrame, bands, n: int, seed: int = 42, neighbours: int = 19) -> DataFrame:
    """(band, i, j, prompt_b, response_a): the reply to i and its neighbour j's prompt, n of each band.

    The candidates of a band are the first 3 n edges by (i, rank); n of them are drawn.
    """
    near = edges(vectors, k=neighbours).withColumn("band", banded(F.col("cos"), bands))
    pool = per_band(near, "band", F.struct("i", "rank"), 3 * n)
    picked = per_band(pool, "band", F.struct(md5_order(seed, F.col("i"), F.col("j")), "i", "j"), n)
    a = records.select(F.col("ord").alias("i"), F.col("response").alias("response_a"))
    b = records.select(F.col("ord").alias("j"), F.col("prompt").alias("prompt_b"))
    return picked.join(a, "i").join(b, "j").select("band", "i", "j", "prompt_b", "response_a")


def audit_sample(calls: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Calls of the subject arm (or of no arm) for people to check.

    All where there are fewer than n; else as many of each band as n allows, n at
    most; without bands n at random.
    """
    ensure_checkpoint_dir(calls.sparkSession)
    pool = calls.where(F.coalesce("arm", F.lit("subject")) == "subject").checkpoint()  # read twice
    counts = pool.agg(F.count("*"), F.count_distinct(F.coalesce("band", F.lit("unknown"))), F.count("band"))
    size, bands, named = counts.first()
    if size < n:
        return pool
    order = F.struct(md5_order(seed, F.col(key)), F.col(key))
    if named:
        pool = per_band(pool.withColumn("_band", F.coalesce("band", F.lit("unknown"))), "_band", order, max(1, n // bands)).drop("_band")
    return pool.orderBy(md5_order(f"{seed}:cut", F.col(key)), key).limit(n)
