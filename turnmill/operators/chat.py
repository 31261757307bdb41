"""Chat operators: pairing, exact dedup, control samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order, normalise, stripped


def _spoken(turns: DataFrame) -> DataFrame:
    text = stripped(F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", text.alias("text")).where(
        (F.col("text") != "") & F.col("role").isin("user", "assistant")
    )


def first_turn_records(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt, response): the first user turn and the first assistant turn after it."""
    spoken = _spoken(turns)
    conv = Window.partitionBy("conv_id")
    at = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(conv)
    after = spoken.withColumn("at", at)
    return (
        after.groupBy("conv_id")
        .agg(
            F.min(F.when(F.col("turn") == F.col("at"), F.col("text"))).alias("prompt"),
            F.min(
                F.when((F.col("role") == "assistant") & (F.col("turn") > F.col("at")), F.struct("turn", "text"))
            )["text"].alias("response"),
        )
        .where("prompt is not null and response is not null")
    )


def qa_pairs(turns: DataFrame, min_user_turns: int = 1) -> DataFrame:
    """(conv_id, k, prompt, response): each assistant turn right after a user turn, k from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = _spoken(turns).withColumn("last_role", F.lag("role").over(order)).withColumn("prompt", F.lag("text").over(order))
    paired = paired.where("role = 'assistant' and last_role = 'user'")
    pairs = paired.select(
        "conv_id", (F.row_number().over(order) - 1).cast("int").alias("k"), "prompt", F.col("text").alias("response"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
    )
    return pairs.where(F.col("n") >= min_user_turns).drop("n")


def turn_pairs(turns: DataFrame, with_reply: bool = False) -> DataFrame:
    """(conv_id, turn_idx, anchor, target[, target_response]): consecutive answered prompts."""
    order = Window.partitionBy("conv_id").orderBy("k")
    pairs = qa_pairs(turns, 2).withColumn("target", F.lead("prompt").over(order))
    pairs = pairs.withColumn("target_response", F.lead("response").over(order)).where("target is not null")
    got = pairs.select("conv_id", F.col("k").alias("turn_idx"), F.col("prompt").alias("anchor"), "target", "target_response")
    return got if with_reply else got.drop("target_response")


def first_answers(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt, response): the first answered prompt of each conversation."""
    return qa_pairs(turns).where("k = 0").select("conv_id", "prompt", "response")


def nested(turns: DataFrame, min_user_turns: int = 2) -> DataFrame:
    """(conv_id, user_turns, asst_turns): answered prompts and their answers, oldest first."""
    pairs = qa_pairs(turns, min_user_turns).groupBy("conv_id")
    both = pairs.agg(F.sort_array(F.collect_list(F.struct("k", "prompt", "response"))).alias("p"))
    return both.select(
        "conv_id", F.transform("p", lambda x: x["prompt"]).alias("user_turns"), F.transform("p", lambda x: x["response"]).alias("asst_turns")
    )


def sampled_records(turns: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n first-turn records, the smallest ids by md5."""
    return sample(first_turn_records(turns), "conv_id", n, seed)


def sampled_turns(turns: DataFrame, n: int, seed: int = 42, min_user_turns: int = 2) -> DataFrame:
    """Turns of n conversations with that many answered prompts; ids are drawn before any text is gathered."""
    ids = qa_pairs(turns, min_user_turns).select("conv_id").distinct()
    picked = sample(ids, "conv_id", n, seed).withColumnRenamed("conv_id", "_picked")
    return turns.join(picked, F.col("conv_id") == F.col("_picked"), "left_semi")


def sampled_conversations(turns: DataFrame, n: int, seed: int = 42, min_user_turns: int = 2) -> DataFrame:
    """``nested`` conversations, n of them."""
    return nested(sampled_turns(turns, n, seed, min_user_turns), min_user_turns)


def exact_dedup(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record by ``order`` of each normalised ``key``; its SHA-256 is shuffled in its place."""
    firsts = Window.partitionBy("_key").orderBy(order)
    rows = records.withColumn("_key", F.sha2(normalise(F.col(key)), 256))
    return rows.withColumn("_n", F.row_number().over(firsts)).where("_n = 1").drop("_n", "_key")


def dedup_stats(records: DataFrame, key: str) -> DataFrame:
    counts = records.agg(F.count("*").alias("before"), F.countDistinct(F.sha2(normalise(F.col(key)), 256)).alias("after"))
    return counts.withColumn("rate", F.when(F.col("before") == 0, 0.0).otherwise(1 - F.col("after") / F.col("before")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer: the smallest by md5."""
    return rows.orderBy(md5_order(seed, F.col(key)), key).limit(n)


def scrambled(rows: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """``text`` with its words in md5 order, joined by single spaces."""
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    dealt = F.transform(
        words,
        lambda w, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))).alias("o"), w.alias("w")),
    )
    return rows.withColumn(text, F.array_join(F.transform(F.sort_array(dealt), lambda p: p["w"]), " "))
