"""Connected components of many graphs at once: one task a graph where its vertices fit, else star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ensure_checkpoint_dir


#: Vertices of a graph that one task may hold (some 200 bytes each); its links pass by and are not held.
TASK_NODES = 2_000_000


def _united(graph: list[str]):
    def run(batches):
        above: dict[tuple, dict[int, int]] = {}

        def root(up, x):
            y = up.setdefault(x, x)
            while y != x:
                up[x] = up[y]
                x, y = up[x], up[up[x]]
            return x

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in graph))
            for key, u, v in zip(keys, batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                up = above.get(key)
                if up is None:
                    up = above[key] = {}
                a, b = root(up, u), root(up, v)
                if a < b:
                    up[b] = a
                elif b < a:
                    up[a] = b
        for key, up in above.items():
            nodes = list(up)
            for at in range(0, len(nodes), 100_000):
                some = nodes[at : at + 100_000]
                columns = {c: pa.array([x] * len(some), pa.int64()) for c, x in zip(graph, key)}
                columns |= {"node": pa.array(some, pa.int64()), "root": pa.array([root(up, x) for x in some], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def components(links: DataFrame, graph: list[str], max_rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """(*graph, node, root) of links (*graph, u, v): every linked vertex with the smallest one it reaches.

    Where ``nodes`` bounds the vertices of a graph by TASK_NODES, each graph's links go to one task, which unites
    their ends. Otherwise each round hangs a vertex's neighbours on their smallest (Kiveris et al. 2014)
    and is checkpointed, so a lost executor repeats one round at most.
    """
    ensure_checkpoint_dir(links.sparkSession)
    if nodes is not None and nodes <= TASK_NODES:
        kinds = dict(links.dtypes)
        whole = links.where("u <> v").select(*(F.col(c).cast("long").alias(c) for c in (*graph, "u", "v")))
        parts = 4 * links.sparkSession.sparkContext.defaultParallelism
        schema = ", ".join(f"{c} long" for c in (*graph, "node", "root"))
        found = whole.repartition(parts, *graph).mapInArrow(_united(graph), schema)
        like = {**{c: kinds[c] for c in graph}, "node": kinds["u"], "root": kinds["u"]}
        return found.select(*(F.col(c).cast(kind).alias(c) for c, kind in like.items()))

    def tidy(df: DataFrame) -> DataFrame:
        df = df.where("u <> v").select(*graph, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return df.distinct().checkpoint()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*graph, "u", "v"))).first())

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy(*graph, "u").agg(F.min("v").alias("m")).select(*graph, "u", F.least("u", "m").alias("m"))

    now = tidy(links)
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(*graph, F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(smallest(both), [*graph, "u"])
        large = tidy(large.select(*graph, F.col("v").alias("u"), F.col("m").alias("v")))
        low = smallest(large)
        hung = large.join(low, [*graph, "u"]).select(*graph, F.col("v").alias("u"), F.col("m").alias("v"))
        now = tidy(hung.unionByName(low.withColumnRenamed("m", "v")))
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(*graph, F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(*graph, F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)
