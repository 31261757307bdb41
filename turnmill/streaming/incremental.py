"""Incremental exact dedup and samples over a stream of records (an extension of ours).

Each micro-batch writes to a folder named by its id and overwrites it when Spark
runs the batch again, so a replay after a failure changes nothing. What was seen
is a table of 32-byte keys, partitioned by batch: no state is held in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order, normalise


def _read_before(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """Rows that earlier batches wrote below ``path``; those of later or repeated ones are left out."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < batch)


def first_seen(key: str, order: str, root: str):
    """A ``foreachBatch`` function that keeps the first record of each normalised ``key``.

    Kept records go to ``root``/records/batch=N and their keys to ``root``/keys/batch=N.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_key", F.sha2(normalise(F.col(key)), 256))
        nth = F.row_number().over(Window.partitionBy("_key").orderBy(order))
        rows = rows.withColumn("_n", nth).where("_n = 1").drop("_n")
        seen = _read_before(spark, f"{root}/keys", "_key string", number).select("_key")
        fresh = rows.join(seen, "_key", "left_anti").persist()
        fresh.drop("_key").write.mode("overwrite").parquet(f"{root}/records/batch={number}")
        fresh.select("_key").write.mode("overwrite").parquet(f"{root}/keys/batch={number}")
        fresh.unpersist()

    return run


def running_sample(key: str, n: int, root: str, seed: int = 42):
    """A ``foreachBatch`` function that keeps the n keys of smallest md5 among all seen.

    ``root``/batch=N holds the sample after batch N; only the one before it is read.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(key).cast("string").alias("key"))
        before = _read_before(spark, root, "key string", number)
        last = before.agg(F.max("batch")).first()[0]
        if last is not None:
            rows = rows.unionByName(before.where(F.col("batch") == last).select("key"))
        picked = rows.distinct().orderBy(md5_order(seed, F.col("key")), "key").limit(n)
        picked.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return run
