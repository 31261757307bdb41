"""Readers: tables, chat exports, judge transcripts."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped

EXPORT_SCHEMA = (
    "uuid string, name string, created_at string, chat_messages array<struct<sender string, text string, "
    "content array<struct<text string>>>>"
)
TRANSCRIPT_SCHEMA = "kind string, prompt string, reply string, band string, arm string, serve_cosine double, i long, j long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message_text(text: Column, content: Column) -> Column:
    """A message's own text, or its content parts joined by line ends where that is blank."""
    parts = F.filter(F.transform(content, lambda p: stripped(p["text"])), lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(F.nullif(stripped(text), F.lit("")), F.array_join(parts, "\n"), F.lit(""))


def in_language(rows: DataFrame, language: str = "English", column: str = "language") -> DataFrame:
    """Rows of one language; a plain comparison, which reaches the scan."""
    return rows.where(F.col(column) == language)


def conversation_turns(raw: DataFrame, language: str | None = "English") -> DataFrame:
    """(conv_id, turn, role, text) of raw conversations (language, conversation array<struct<role, content>>, ids).

    The id is conversation_hash, else conversation_id, else the md5 of the first user turn.
    """
    raw = raw if language is None else in_language(raw, language)
    said = F.filter("conversation", lambda t: (t["role"] == "user") & (stripped(F.coalesce(t["content"], F.lit(""))) != ""))
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("conversation_hash", "conversation_id") if c in raw.columns]
    own = F.coalesce(*ids, F.md5(stripped(F.get(said, F.lit(0))["content"])))
    return raw.select(own.alias("conv_id"), F.posexplode("conversation").alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.content").alias("text")
    )


def cached(spark: SparkSession, path: str | None, make) -> DataFrame:
    """What ``make()`` gives, from Parquet at ``path`` where an earlier call wrote it whole."""
    if path is None:
        return make()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sample_path(folder: str, kind: str, n: int, seed: int) -> str:
    """Where a sample is cached; the seed is part of its name."""
    return f"{folder.rstrip('/')}/{kind}_n{n}_seed{seed}.parquet"


def read_export_zip(spark: SparkSession, path: str, member: str = "conversations.json") -> DataFrame:
    """(conv_id, created, turn, role, text) of a personal chat export, a single-user file."""
    with zipfile.ZipFile(path) as archive:
        name = next(n for n in archive.namelist() if n.endswith(member))
        conversations = json.loads(archive.read(name))
    raw = spark.createDataFrame([(n, json.dumps(c)) for n, c in enumerate(conversations)], "ord long, raw string")
    return export_turns(raw)


def export_turns(raw: DataFrame) -> DataFrame:
    """Turns of (ord, raw JSON) conversations; an unreadable time is null, which sorts first."""
    c = raw.select("ord", F.from_json("raw", EXPORT_SCHEMA).alias("c"))
    turns = c.select(
        "ord", F.col("c.uuid").alias("conv_id"), F.expr("try_to_timestamp(c.created_at)").alias("created"),
        F.posexplode("c.chat_messages").alias("turn", "m"),
    )
    role = F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender"))
    return turns.select(
        "ord", "conv_id", "created", F.col("turn").cast("long").alias("turn"), role.alias("role"),
        message_text(F.col("m.text"), F.col("m.content")).alias("text"),
    )


def read_transcript(spark: SparkSession, path: str, kind: str = "h5") -> DataFrame:
    """Judge calls of one kind from JSON lines."""
    return spark.read.schema(TRANSCRIPT_SCHEMA).json(path).where(F.col("kind") == kind)


def append_transcript(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def write_pareto_csv(cells: DataFrame, path: str) -> None:
    """Pareto cells with four decimals, as one CSV with a header."""
    four = [F.format_string("%.4f", c).alias(c) for c in ("hit_rate", "quality", "effective", "roi")]
    cells.select("k", "t_pred", "t_serve", "c_speculate", *four, "feasible").coalesce(1).write.csv(path, header=True)
