"""Text vectors: TF-IDF with a bounded vocabulary, hashed token vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import streams
from .ordering import ensure_checkpoint_dir, numbered
from .streams import lists

MAX_FEATURES = 20_000
DIMS = 64
#: Rows of a task at least, and of its rows that meet a block of the others at once.
BLOCK_ROWS = 256
#: The most frequent terms, whose weights are multiplied as a matrix; others are met by lists.
COMMON = 128


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def ngrams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))
    )
    return F.when(F.size(words) < 2, words).otherwise(F.concat(words, pairs))


def tfidf(rows: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(ord, term, w) of rows (ord, text): smooth idf, unit length, most frequent terms only."""
    words = rows.select("ord", tokens(F.col("text")).alias("ws"))
    tf = words.select("ord", F.explode(ngrams(F.col("ws"))).alias("term")).groupBy("ord", "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    vocabulary = stats.orderBy(F.desc("total"), "term").limit(max_features)
    n = rows.count()
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    weighed = tf.join(vocabulary, "term").select("ord", "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("ord")))
    return weighed.select("ord", "term", (F.col("w") / norm).alias("w"))


def hashed_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(ord, v): unit vectors of token counts by md5 bucket; zero for texts without tokens."""
    words = rows.select("ord", F.explode_outer(tokens(F.col("text"))).alias("t"))
    bucket = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    counts = words.groupBy("ord").agg(*(F.count_if(bucket == d).cast("double").alias(f"c{d}") for d in range(dims)))
    v = F.array(*(F.col(f"c{d}") for d in range(dims)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return counts.select("ord", v.alias("v")).select(
        "ord", F.transform("v", lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0))).alias("v")
    )


def _read_sparse(table) -> tuple:
    """Rows' weights of the COMMON first terms as a matrix, and those of the others as (row, term, w) by term and by row."""
    terms, at = lists(table.column("terms"))
    ws, _ = lists(table.column("ws"))
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    common = terms < COMMON
    dense = np.zeros((len(at) - 1, COMMON))
    dense[rows[common], terms[common]] = ws[common]
    rare = rows[~common], terms[~common], ws[~common]
    by_term = np.argsort(rare[1], kind="stable")
    return dense, rare, tuple(x[by_term] for x in rare)


def _sparse_product(own: tuple, part: slice, block: tuple) -> np.ndarray:
    """Scores of some own rows with a block: a product over the common terms, and what is listed for the others."""
    (dense, (rows, terms, ws), _), (others, _, (cols, listed, theirs)) = own, block
    scores = dense[part] @ others.T
    some = slice(*np.searchsorted(rows, (part.start, part.stop)))
    rows, terms, ws = rows[some] - part.start, terms[some], ws[some]
    first, last = np.searchsorted(listed, terms), np.searchsorted(listed, terms, side="right")
    many = last - first
    # Places in the block's lists, one run for each of the own weights.
    at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    np.add.at(scores.reshape(-1), np.repeat(rows * scores.shape[1], many) + cols[at], np.repeat(ws, many) * theirs[at])
    return scores


def sparse_edges(weights: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(i, j, cos, rank): k nearest by sparse vectors (ord, term, w); terms are numbered, the most frequent first."""
    ensure_checkpoint_dir(rows.sparkSession)
    weights = weights.checkpoint()
    counts = weights.groupBy("term").agg((-F.count("*")).alias("_less"))
    places = numbered(counts, "_less", "term", name="_t").select("term", F.col("_t").cast("int").alias("t"))
    vectors = weights.join(places, "term").groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("p"))
    vectors = rows.select("ord").join(vectors, "ord", "left").select(
        "ord", F.coalesce(F.transform("p", lambda x: x["t"]), F.array().cast("array<int>")).alias("terms"),
        F.coalesce(F.transform("p", lambda x: x["w"]), F.array().cast("array<double>")).alias("ws"),
    ).checkpoint()
    groups, narrow = streams.groups_for(vectors, BLOCK_ROWS)
    run = streams.nearest(_read_sparse, _sparse_product, k, None, "other", BLOCK_ROWS)
    return streams.arranged(streams.dealt(vectors, groups), groups, narrow).mapInArrow(run, "i long, j long, cos double, rank int")
