"""What is shuffled, written and read again may grow with the rows, not with their square."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill.operators import neighbours, sampling, textvec
from turnmill.operators.components import components


def shuffled(df, metric):
    """A metric of all exchanges of ``df`` after it has run."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        own = plan.metrics().apply(metric).value() if name == "Exchange" else 0
        below = plan.children()
        return own + sum(walk(below.apply(n)) for n in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def vectors(spark, n, dims=8):
    x = np.random.default_rng(5).standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ord long, v array<double>"), x


@pytest.mark.parametrize("how", [{"k": 15}, {"k": 1}, {"k": 1, "mode": "prior"}])
def test_neighbours_shuffle_grows_with_the_rows(spark, monkeypatch, how):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    few, many = (shuffled(neighbours.edges(vectors(spark, n)[0], **how), "shuffleRecordsWritten") for n in (512, 1024))
    assert 0 < many <= 2.2 * few


def test_sparse_neighbours_shuffle_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(textvec, "BLOCK_ROWS", 16)
    counts = []
    for n in (512, 1024):
        rows = spark.range(n).select(F.col("id").alias("ord"), F.concat_ws(" ", F.lit("word"), (F.col("id") % 40).cast("string")).alias("text"))
        counts.append(shuffled(textvec.sparse_edges(textvec.tfidf(rows), rows, 3), "shuffleRecordsWritten"))
    assert 0 < counts[1] <= 2.4 * counts[0]


def test_sparse_neighbours_equal_a_whole_product(spark, monkeypatch):
    monkeypatch.setattr(textvec, "BLOCK_ROWS", 7)
    monkeypatch.setattr(textvec, "COMMON", 4)
    rng = np.random.default_rng(2)
    n, terms, k = 90, 30, 6
    w = np.where(rng.random((n, terms)) < 0.15, rng.integers(1, 4, (n, terms)), 0).astype(float)
    w[5] = w[6] = 0  # rows without terms meet the first rows
    w[40:60] = w[20:40]  # and ties go to them
    cells = [(int(i), f"t{t:02d}", float(w[i, t])) for i, t in zip(*np.nonzero(w))]
    rows = spark.range(n).withColumnRenamed("id", "ord")
    got = textvec.sparse_edges(spark.createDataFrame(cells, "ord long, term string, w double"), rows, k).collect()
    cos = w @ w.T
    want = {(i, j, r + 1) for i in range(n) for r, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: (-cos[i, j], j))[:k])}
    assert {(r.i, r.j, r.rank) for r in got} == want and len(got) == n * k


def test_candidates_take_no_vectors_along(spark):
    n, guesses = 1000, 70
    v, _ = vectors(spark, n, 64)
    pairs = v.select("ord", (F.col("ord") % 10).alias("conv"), F.col("v").alias("target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = neighbours.cross_candidates(neighbours.random_edges(pairs, guesses), pairs, 50)
        assert shuffled(met, "shuffleBytesWritten") < 20_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_with_nulls_and_texts_as_conversations(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "b", None), (2, "b", [0.6, 0.8]), (3, None, [1.0, 0.0]), (4, "a", [1.0, 0.0])]
    pairs = spark.createDataFrame(rows, "ord long, conv string, target array<double>")
    edge = spark.createDataFrame([(0, 1, 1), (0, 4, 2), (0, 3, 3), (0, 2, 4), (0, 9, 5), (2, 0, 1), (7, 0, 1)], "i long, j long, rank int")
    got = sorted(tuple(r) for r in neighbours.cross_candidates(edge, pairs, 9).collect())
    assert got == [(0, 1, 1, None), (0, 2, 2, 0.6), (2, 0, 1, 0.6)]


def test_dedup_writes_no_pairs(spark):
    n = 3000
    alike = spark.range(n).select(F.col("id").alias("ord"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    assert [r.ord for r in neighbours.greedy_dedup(alike).collect()] == [0]
    assert size() - before < 1_000_000


def test_dedup_in_many_rounds_equals_the_walk(spark):
    v, x = vectors(spark, 700)
    cos, gone = np.round(x @ x.T, 12), np.zeros(700, bool)
    for i in range(700):
        if not gone[i]:
            gone[i + 1 :] |= cos[i, i + 1 :] >= 0.6
    odd = v.unionByName(spark.createDataFrame([(700, None)], v.schema))
    got = sorted(r.ord for r in neighbours.greedy_dedup(odd, 0.6, walk_edges=3000).collect())
    assert got == [*np.flatnonzero(~gone).tolist(), 700]


def test_audit_reads_its_calls_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    calls = spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 3).cast("string").alias("band"), F.lit("subject").alias("arm"))
    calls = calls.mapInPandas(count, calls.schema)
    assert sampling.audit_sample(calls, "i", 9).count() == 9 and read.value == 50


def test_components_of_graphs_that_fit_a_task_need_no_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(u), int(v)) for g, u, v in zip(rng.integers(0, 3, 900), *rng.integers(-200, 400, (2, 900)))]
    links = spark.createDataFrame([*rows, (7, 5, 5)], "g int, u long, v long")
    want = components(links, ["g"])
    got = components(links, ["g"], nodes=600)
    assert got.schema == want.schema or got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    long = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert [tuple(r) for r in components(long, ["g"], nodes=5001, max_rounds=0).groupBy("root").count().collect()] == [(0, 5001)]
