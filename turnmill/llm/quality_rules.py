"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is a table of (measure, least, most, words from which it holds). ``measures`` turns every whole
text into counts and ratios of its length, symbols, stop words and lines with
built-in functions alone, and ``verdict`` folds the table into one boolean
column, so that the plan is a scan, projections and nothing else: no shuffle, no
user function, no Python.

Five-word windows are compared by the chained XXH64 of their words. Most texts
repeat no window, which one distinct over 64-bit values shows; only the others
sort (hash, place) pairs to mark the words in repeated windows.

Defined cases: a null text has no words and so fails the base rule; empty texts
do likewise; null ids stay null; repeated rows repeat; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, read_table, words_of

#: Base rule: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: measure, least, most (None leaves a side open), and the fewest words of a text that the
#: rule judges: a short one has too few for a ratio of stop words to tell. A text fails outside of any.
RULES: list[tuple[str, float | None, float | None, int]] = [
    ("mean_word_chars", 2.0, 15.0, 0),
    ("symbol_char_ratio", None, 0.10, 0),
    ("symbol_word_ratio", None, 0.30, 0),
    ("bang_word_ratio", None, 0.30, 0),
    ("dup_line_ratio", None, 0.50, 0),
    ("stop_word_ratio", 0.02, None, 50),
]
# Frequent words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "as", "at", "by",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "für", "auf",
    "le", "la", "les", "de", "des", "et", "que", "un", "une", "en", "pour", "dans", "sur", "par", "pas",
    "el", "los", "las", "y", "del", "se", "no", "una", "por", "con", "para", "su", "al", "lo",
]


def window_keys(words: Column) -> Column:
    """The hash of each window of WINDOW words, from the hashes of its words.

    ``words`` (hashes) must be a plain column, since it is used more than once.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))

    def key(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))

    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(at, key))


def _covered(keys: Column) -> tuple[Column, Column]:
    """Sorted (key, place) pairs, then the places of windows whose key repeats.

    The second column reads the first as ``_pairs``, so that the sort runs once.
    """
    pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    same = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size(F.col("_pairs")) - 1),
            lambda k: F.when(
                (F.get(F.col("_pairs"), k)["h"] == F.get(F.col("_pairs"), k - 1)["h"])
                | (F.get(F.col("_pairs"), k)["h"] == F.get(F.col("_pairs"), k + 1)["h"]),
                F.get(F.col("_pairs"), k)["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return pairs, F.sort_array(same)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the contract's counts and the table's ratios."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    got = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", "_text", words_of(F.col("_text")).alias("_words"), lines.alias("_lines")
    )
    words = F.col("_words")
    hashes = F.transform(words, lambda w: F.xxhash64(w)).alias("_hashes")
    symbols = F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))
    got = got.select("*", hashes, symbols.cast("long").alias("n_symbols"))
    got = got.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("_stops"),
        F.when(F.col("n_symbols") == 0, F.lit(0)).otherwise(F.size(F.filter(words, lambda w: w.rlike(r"[#*$%&|<>]")))).cast("long").alias("_symbol_words"),
        F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("long").alias("_bang_words"),
        window_keys(F.col("_hashes")).alias("_keys"),
    )
    # Only texts in which a window repeats go on to the sort.
    twice = F.size("_keys") > F.size(F.array_distinct("_keys"))
    got = got.withColumn("_keys", F.when(twice, F.col("_keys")))
    pairs, places = _covered(F.col("_keys"))
    got = got.withColumn("_pairs", pairs).drop("_keys")
    got = got.withColumn("_at", places).drop("_pairs")
    at = F.col("_at")
    cover = F.aggregate(
        F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    got = got.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_at")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_char_ratio"),
        (F.col("_symbol_words") / n).alias("symbol_word_ratio"),
        (F.col("_bang_words") / n).alias("bang_word_ratio"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("_stops") / n).alias("stop_word_ratio"),
    )


def verdict(rules=RULES) -> Column:
    """The rule table as one boolean column: true where every measure is in range."""
    ok = F.lit(True)
    for measure, least, most, words in rules:
        inside = F.lit(True)
        if least is not None:
            inside = inside & (F.col(measure) >= least)
        if most is not None:
            inside = inside & (F.col(measure) <= most)
        ok = ok & (inside if not words else (F.col("n_words") < words) | inside)
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts, ratios, base_failed and kept of every document."""
    got = measures(docs)
    return got.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(read_table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *(F.round(r[0], 9).alias(r[0]) for r in RULES),
    )


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, in one pass without a join."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    packed = docs.select(row.alias("doc_id"), docs["text"])
    # Optimizer barrier: a filter does not move below a projection with a row number, which
    # would write the nested array expressions out once more at each of their uses.
    judged = judge(packed, rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.where("kept and _row >= 0").select("doc_id.*")
