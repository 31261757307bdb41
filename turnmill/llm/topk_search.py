"""Exact top-k search: norm-bucketed retrieval with local cosine thresholds.

Vectors become integers floor(1024 x). They are grouped by length (quarter
octaves of the norm) and dealt by a hash into blocks of about ``BLOCK_ROWS``;
queries stand in blocks of about ``QUERY_ROWS``. A tile is one candidate block and
one query block, so neither the queries nor a popular vector makes a task
unbounded, and no side is broadcast.

First, tiles of the longest candidates alone give each query its k-th best score
so far, a floor under its final one. A tile whose longest candidate cannot reach the floor
of any of its queries is dropped before anything is copied to it. In a tile, the floor over (query
length * candidate length) is a candidate's local cosine threshold. Above 1 it is
pruned by its length alone, which cuts a prefix of the block, ordered by falling length. What is
left may be pruned by coordinates: the products over the query's largest coordinates (those
that hold ``FOCUS`` of its squared length) plus the product of the lengths of
the rests bound the score. Each query and block chooses: where of ``PROBES`` candidates, evenly taken from the
prefix, no more than ``SURVIVORS`` pass the bound, coordinates prune; else length
alone does. Candidates that survive are verified by exact integer products. A tile
hands on k rows a query, and a window per query merges them.

Bounds carry a relative slack of 1e-9, far above rounding in doubles, so they
never lose a result; products are integers below 2^53 and exact (larger ones are
computed in 64-bit integers).

Defined cases: null vectors and vectors with null or non-finite components take
no part, nor do rows without vec_id; vectors of different dimension have no
score; rows that repeat a vec_id with the same vector count once; of query rows that
repeat an id with other vectors the one with the smallest vector is searched; ties go to the
smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, read_table

K = 10
QUERY_STEP = 100
SCALE = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Norm buckets per doubling of the norm.
PER_OCTAVE = 4
#: Share of a query's squared length in the coordinates that prune.
FOCUS = 0.9
#: Largest estimated share of survivors with which coordinates prune, and the candidates that it is estimated from.
SURVIVORS = 0.5
PROBES = 128
SLACK = 1e-9
_PER_CHUNK = 256


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, norm, v): integers floor(1024 x) of the vectors that take part."""
    x = vectors["embedding"].cast("array<double>")
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    slim = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & whole
    )
    v = F.transform("x", lambda c: F.floor(c * SCALE).cast("double"))
    slim = slim.select("vec_id", F.size("x").alias("dim"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return slim.select("vec_id", "dim", norm.alias("norm"), "v")


def blocked(vectors: DataFrame) -> DataFrame:
    """Candidates with ``bucket`` (a floor under it bounds lengths) and ``block`` (of about BLOCK_ROWS)."""
    bucket = F.when(F.col("norm") > 0, F.ceil(F.log2("norm") * PER_OCTAVE)).otherwise(-1_000_000).cast("long")
    rows = vectors.withColumn("bucket", bucket)
    n = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    n = n.select(F.col("dim").alias("d"), F.col("bucket").alias("b"), "parts")
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts"))
    rows = rows.join(n, (F.col("dim") == F.col("d")) & (F.col("bucket") == F.col("b"))).withColumn("part", part)
    return rows.drop("d", "b", "parts")


def top_of_tile(q_ids, q, floors, c_ids, c, k: int = K, work: dict | None = None):
    """Rows (query_id, vec_id, score) of one tile: each query's k best, or fewer.

    ``work`` gets the numbers of (query, candidate) pairs: all, ``within`` those that length leaves,
    ``verified`` by a whole product, and of queries that were pruned by ``coordinate``.
    """
    work = {} if work is None else work
    for name in ("all", "within", "verified", "coordinate"):
        work.setdefault(name, 0)
    q_norm, c_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((c_ids, -c_norm))
    c, c_ids, c_norm = c[order], c_ids[order], c_norm[order]
    # Rows with the id and vector of another count once.
    by_id = np.argsort(c_ids, kind="stable")
    twin = np.zeros(len(c), dtype=bool)
    for n in np.flatnonzero(c_ids[by_id][1:] == c_ids[by_id][:-1]):
        twin[by_id[n + 1]] = np.array_equal(c[by_id[n]], c[by_id[n + 1]])
    c, c_ids, c_norm = c[~twin], c_ids[~twin], c_norm[~twin]
    exact = c.shape[1] == 0 or (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * c.shape[1] < 2**53)
    across = np.ascontiguousarray(c.T)
    squares = across * across
    # Candidates shorter than this cannot reach the floor.
    need = np.where(np.isneginf(floors) | (q_norm == 0) | (floors <= 0), 0.0, floors / np.where(q_norm > 0, q_norm, 1.0))
    lost = (q_norm == 0) & (floors > 0)
    prefix = np.where(lost, 0, np.searchsorted(-c_norm, -need * (1 - SLACK), side="right"))
    work["all"] += len(q) * len(c)
    work["within"] += int(prefix.sum())
    out = []

    def keep(i, ids, scores):
        # A rank below k, or a tie at k, may still enter: ties go to smaller ids.
        good = (ids != q_ids[i]) & (scores >= floors[i])
        ids, scores = ids[good], scores[good]
        if len(ids) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= least
            ids, scores = ids[near], scores[near]
        best = np.lexsort((ids, -scores))[:k]
        out.append((np.full(len(best), q_ids[i]), ids[best], scores[best]))

    def product(a, b):
        return b @ a if exact else b.astype(np.int64) @ a.astype(np.int64)

    def passing(i, focus, rest, places):
        """Of candidates at ``places`` (a slice) those whose bound reaches the floor."""
        part = q[i, focus] @ across[focus, places]
        left = np.maximum(c_norm[places] ** 2 - squares[focus, places].sum(axis=0), 0.0)
        slack = SLACK * (q_norm[i] * c_norm[places] + 1.0)
        return part + rest * np.sqrt(left + SLACK * c_norm[places] ** 2) + slack >= floors[i]

    by_length = []
    for i in np.flatnonzero(prefix):
        if need[i] <= 0 or prefix[i] < 2 * PROBES:
            by_length.append(i)
            continue
        largest = np.argsort(-np.abs(q[i]), kind="stable")
        held = np.cumsum(q[i, largest] ** 2)
        focus = np.sort(largest[: 1 + np.searchsorted(held, FOCUS * held[-1])])
        rest = np.sqrt(max(0.0, held[-1] - held[len(focus) - 1])) * (1 + SLACK)
        step = prefix[i] // PROBES
        if passing(i, focus, rest, slice(0, step * PROBES, step)).mean() > SURVIVORS:
            by_length.append(i)
            continue
        left = np.flatnonzero(passing(i, focus, rest, slice(0, prefix[i])))
        work["coordinate"] += 1
        work["verified"] += len(left)
        keep(i, c_ids[left], product(q[i], c[left]))
    by_length = np.array(by_length, dtype=np.int64)
    for start in range(0, len(by_length), _PER_CHUNK):
        chunk = by_length[start : start + _PER_CHUNK]
        longest = prefix[chunk].max()
        work["verified"] += int(longest) * len(chunk)
        scores = product(q[chunk].T, c[:longest]).T
        for i, s in zip(chunk, scores):
            keep(i, c_ids[:longest], s)
    return out


def _tile(k: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks()
        v = np.asarray(flat.values, dtype=np.float64).reshape(len(ids), -1) if len(flat.values) else np.zeros((len(ids), 0))
        floors = table.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        is_q = side == 1
        out = []
        if is_q.any() and not is_q.all():
            out = top_of_tile(ids[is_q], v[is_q], floors[is_q], ids[~is_q], v[~is_q], k)
        parts = [np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in range(3)]
        return pa.table({n: pa.array(p.astype(np.int64)) for n, p in zip(("query_id", "vec_id", "score"), parts)})

    return run


def _tiles(queries: DataFrame, candidates: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each of ``tiles`` (dim, bucket, part, q_part)."""
    tiles = tiles.select(*(F.col(c).alias(f"t_{c}") for c in ("dim", "bucket", "part", "q_part")))
    names = ["t_dim", "t_bucket", "t_part", "t_q_part"]
    dealt_q = queries.join(tiles, (F.col("dim") == F.col("t_dim")) & (F.col("q_part") == F.col("t_q_part"))).select(
        *names, F.lit(1).alias("side"), "vec_id", "floor", "v"
    )
    at = (F.col("dim") == F.col("t_dim")) & (F.col("bucket") == F.col("t_bucket")) & (F.col("part") == F.col("t_part"))
    dealt_c = candidates.join(tiles, at).select(
        *names, F.lit(0).alias("side"), "vec_id", F.lit(float("-inf")).alias("floor"), "v"
    )
    return dealt_q.unionByName(dealt_c).groupBy(*names).applyInArrow(_tile(k), "query_id long, vec_id long, score long")


def reachable(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tiles (dim, bucket, part, q_part) in which the longest candidate can reach the floor of a query."""
    need = F.when(F.col("floor") <= 0, 0.0).when(F.col("norm") == 0, float("inf")).otherwise(F.col("floor") / F.col("norm"))
    parts = queries.groupBy(F.col("dim").alias("d"), "q_part").agg(F.min(need).alias("need"))
    met = blocks.join(parts, (F.col("dim") == F.col("d")) & (F.col("longest") * (1 + SLACK) >= F.col("need")))
    return met.select("dim", "bucket", "part", "q_part")


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products."""
    rows = materialise(blocked(quantised(vectors)), "vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "norm")).alias("x"))
    queries = materialise(queries.select("vec_id", "x.dim", "x.norm", "x.v"), "queries")
    q_parts = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("q_part", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(q_parts)).cast("int"))
    blocks = materialise(rows.groupBy("dim", "bucket", "part").agg(F.max("norm").alias("longest")), "blocks")

    # One block of the longest vectors of each dimension gives every query a floor.
    first = blocks.groupBy(F.col("dim").alias("d")).agg(F.max(F.struct("bucket", "part")).alias("f"))
    parts = queries.select("dim", "q_part").distinct()
    first = first.join(parts, F.col("d") == F.col("dim")).select("dim", "f.bucket", "f.part", "q_part")
    seen = _tiles(queries.withColumn("floor", F.lit(float("-inf"))), rows, first, k)
    floors = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    floors = materialise(floors.where(F.col("n") >= k).select("query_id", F.col("low").cast("double").alias("low")), "floors")
    floored = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn(
        "floor", F.coalesce("low", F.lit(float("-inf")))
    )
    found = _tiles(floored, rows, reachable(floored, blocks), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rank = F.row_number().over(best)
    ranked = found.select("query_id", "vec_id", "score", rank.cast("int").alias("rank"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
