"""Reduction and density clusters of vectors.

Substitutes: principal components for a learnt manifold, and for a hierarchy
over all pairs one over the graph of nearest neighbours, cut at a fixed number of
distances. All stages are joins and aggregates; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .neighbours import dot, edges
from .ordering import ensure_checkpoint_dir

NEIGHBOURS = 15
LEVELS = 8


def _unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def reduce(vectors: DataFrame, n_components: int) -> DataFrame:
    """(ord, v): the first principal components of (ord, v), scaled to unit length."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("ord", array_to_vector(F.col("v").cast("array<double>")).alias("x"))
    model = PCA(k=n_components, inputCol="x", outputCol="y").fit(rows)
    return model.transform(rows).select("ord", vector_to_array("y").alias("v")).select("ord", _unit(F.col("v")).alias("v"))


def _reach(vectors: DataFrame, samples: list[int]) -> DataFrame:
    """(ms, u, v, d): neighbours with their mutual reachability for each min_samples."""
    near = edges(vectors, k=max(NEIGHBOURS, *samples))
    near = near.select("i", "j", "rank", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cos"))).alias("d")).checkpoint()
    core = near.where(F.col("rank").isin(samples)).select(F.col("rank").alias("ms"), F.col("i").alias("o"), F.col("d").alias("core"))
    a = core.select("ms", F.col("o").alias("i"), F.col("core").alias("ci"))
    b = core.select("ms", F.col("o").alias("j"), F.col("core").alias("cj"))
    met = near.join(a, "i").join(b, ["ms", "j"])
    return met.select("ms", F.col("i").alias("u"), F.col("j").alias("v"), F.greatest("d", "ci", "cj").alias("d"))


def _levels(reach: DataFrame, levels: int) -> DataFrame:
    """(ms, level, eps, gain): distances from loose to tight, and the density gained over the last."""
    shares = F.array(*(F.lit(1 - n / levels) for n in range(levels)))
    cuts = reach.groupBy("ms").agg(F.percentile_approx("d", shares, 10_000).alias("e"))
    cuts = cuts.select("ms", F.posexplode("e").alias("level", "eps"))
    density = 1 / F.greatest("eps", F.lit(1e-9))
    looser = F.lag(density).over(Window.partitionBy("ms").orderBy("level"))
    return cuts.withColumn("gain", F.coalesce(density - looser, F.lit(0.0)))


def density_clusters(vectors: DataFrame, cells=((20, 5),), levels: int = LEVELS) -> DataFrame:
    """(mcs, ms, ord, cluster) of unit vectors (ord, v) for cells (min_cluster_size, min_samples).

    A cluster is named by its smallest ``ord``; -1 is noise. At each of ``levels``
    distances the components of mcs rows or more are tree nodes below the looser
    level's. A node that has siblings starts a cluster, whose mass is the sum of size
    times density gained down to its own split; it is chosen where that is not less
    than the mass chosen below it. A lone root is never chosen.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    cell = ["mcs", "ms"]
    grid = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(m).alias("mcs"), F.lit(s).alias("ms")) for m, s in cells))).alias("c")).select("c.*")
    every = vectors.select("ord").crossJoin(F.broadcast(grid))  # a literal grid
    reach = _reach(vectors, sorted({s for _, s in cells})).checkpoint()
    cuts = _levels(reach, levels).checkpoint()
    links = reach.join(F.broadcast(cuts), "ms").where("d <= eps").select("ms", "level", "u", "v")
    parts = components(links, ["ms", "level"], nodes=vectors.count()).checkpoint()
    sizes = parts.groupBy("ms", "level", "root").agg(F.count("*").alias("size"))
    above = parts.select("ms", (F.col("level") + 1).alias("level"), F.col("node").alias("root"), F.col("root").alias("parent"))
    big = sizes.join(F.broadcast(grid), "ms").where("size >= mcs").join(above, ["ms", "level", "root"], "left")
    big = big.join(F.broadcast(cuts), ["ms", "level"]).withColumn("mass", F.col("size") * F.col("gain"))
    siblings = F.count("*").over(Window.partitionBy(*cell, "level", "parent"))
    big = big.select(*cell, "level", "root", "parent", "mass", (siblings > 1).alias("starts")).checkpoint()

    tree, below = [], None
    for level in reversed(range(levels)):  # masses, from tight to loose
        here = big.where(F.col("level") == level)
        if below is None:
            here = here.withColumn("chain", F.col("mass")).withColumn("under", F.lit(0.0))
        else:
            kids = below.groupBy(*cell, F.col("parent").alias("root")).agg(
                F.count("*").alias("n"), F.sum("chain").alias("c"), F.sum("under").alias("u"),
                F.sum(F.greatest("chain", "under")).alias("split"),
            )
            lone = F.col("n") == 1
            here = here.join(kids, [*cell, "root"], "left")
            here = here.withColumn("chain", F.col("mass") + F.when(lone, F.col("c")).otherwise(0.0))
            here = here.withColumn("under", F.when(lone, F.col("u")).otherwise(F.coalesce("split", F.lit(0.0))))
        below = here.select(*cell, "level", "root", "parent", "starts", "chain", "under").checkpoint()
        tree.append(below)
    chosen = last = None
    for here in reversed(tree):  # choices, from loose to tight
        good = F.col("starts") & (F.col("chain") >= F.col("under"))
        if last is None:
            here = here.withColumn("taken", F.lit(False)).withColumn("pick", good)
        else:
            up = last.select(*cell, F.col("root").alias("parent"), (F.col("taken") | F.col("pick")).alias("had"))
            here = here.join(up, [*cell, "parent"], "left").withColumn("taken", F.coalesce("had", F.lit(False))).drop("had")
            here = here.withColumn("pick", good & ~F.col("taken"))
        last = here.checkpoint()
        picked = last.where("pick").select(*cell, "level", "root")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    named = chosen.join(parts, ["ms", "level", "root"]).select(*cell, F.col("node").alias("ord"), F.col("root").alias("cluster"))
    return every.join(named, [*cell, "ord"], "left").select(*cell, "ord", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def sweep_cells(vectors: DataFrame, n_components, cells, top: int = 50, levels: int = LEVELS) -> DataFrame:
    """(n_components, mcs, ms, coverage, noise, n_clusters) of every cell of the sweep."""
    out = None
    for nc in n_components:
        labels = density_clusters(reduce(vectors, nc).checkpoint(), cells, levels)
        sizes = labels.groupBy("mcs", "ms", "cluster").agg(F.count("*").alias("size"))
        nth = F.row_number().over(Window.partitionBy("mcs", "ms").orderBy((F.col("cluster") == -1).cast("int"), F.desc("size"), "cluster"))
        real = F.col("cluster") != -1
        got = sizes.withColumn("nth", nth).groupBy("mcs", "ms").agg(
            (F.coalesce(F.sum(F.when(real & (F.col("nth") <= top), F.col("size"))), F.lit(0)) / F.sum("size")).alias("coverage"),
            (F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)) / F.sum("size")).alias("noise"),
            F.count_if(real).alias("n_clusters"),
        )
        got = got.select(F.lit(nc).alias("n_components"), "*")
        out = got if out is None else out.unionByName(got)
    return out
