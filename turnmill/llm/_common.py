"""Helpers shared by the training-data operators.

Every operator reads only the columns it names and names its own with a prefix
where rows travel whole, so extra columns of an input do not clash with them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts' word pattern has it.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    session runs on this machine alone, as in tests, a folder of it is set instead.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnmill-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Slim rows of a part, where a table has more of them than two parts a core.
PART_ROWS = 250_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts for a written table of ``rows`` slim rows: two a core, more only beyond PART_ROWS rows each.

    On a local file system each file costs an executor three forks (``chmod``), and a small table comes out of a
    shuffle in as many files as that has partitions.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def materialise(df: DataFrame, label: str, codec: str | None = None, parts: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in at most ``parts`` files if given, and read it back.

    This cuts the lineage: a lost executor costs the tasks that it ran, and what
    comes after never repeats the work before.
    """
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    back._turnmill_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_turnmill_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


#: Rows of a batch that a Python worker turns into objects at once.
SLICE_ROWS = 1024


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches cut into shorter ones, so that a worker holds the texts of few rows as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
