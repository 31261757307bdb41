"""Aggregates: thresholds, correlation with NaN rules, distributions, clusters, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import average_rank


def fraction_above(value: Column, threshold: float) -> Column:
    """Share of values >= threshold; 0 for none."""
    return F.coalesce(F.avg((value >= threshold).cast("double")), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Correlation; NaN for fewer than two rows or a constant column."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    flat = (F.count(x) < 2) | (sx == 0) | (sy == 0)
    return F.when(flat, float("nan")).otherwise(F.covar_pop(x, y) / F.when(~flat, sx * sy))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n_pairs, spearman, pearson)."""
    ranked = average_rank(average_rank(rows, x, "_rx"), y, "_ry")
    return ranked.agg(F.count("*").alias("n_pairs"), pearson("_rx", "_ry").alias("spearman"), pearson(x, y).alias("pearson"))


def distribution(column: str, above: tuple[float, ...]) -> list[Column]:
    """Mean, median, 10th and 90th percentile (linear), and shares at or above thresholds."""
    named = [F.count("*").alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median")]
    named += [F.percentile(column, p).alias(f"p{int(p * 100)}") for p in (0.1, 0.9)]
    return named + [fraction_above(F.col(column), t).alias(f"ge_{int(round(t * 100))}") for t in above]


def cluster_sizes(labels: DataFrame, cluster: str, order: str) -> DataFrame:
    """(cluster, size, pos): sizes without noise (-1), largest first, ties by first appearance."""
    sizes = labels.where(F.col(cluster) != -1).groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), F.min(order).alias("first")
    )
    pos = F.row_number().over(Window.orderBy(F.desc("size"), "first"))
    return sizes.withColumn("pos", pos).select("cluster", "size", "pos")


def coverage(labels: DataFrame, cluster: str, order: str, n: int) -> DataFrame:
    """(coverage, noise, n_clusters): share of the n largest clusters in all rows; 0 and 1 for no rows."""
    top = cluster_sizes(labels, cluster, order).agg(
        F.sum(F.when(F.col("pos") <= n, F.col("size"))).alias("top"), F.count("*").alias("n_clusters")
    )
    total = labels.agg(F.count("*").alias("n"), F.count_if(F.col(cluster) == -1).alias("noisy"))
    return total.crossJoin(top).select(
        F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce("top", F.lit(0)) / F.col("n")).alias("coverage"),
        F.when(F.col("n") == 0, 1.0).otherwise(F.col("noisy") / F.col("n")).alias("noise"), "n_clusters",
    )


def is_degenerate(cov_min: Column, cov_max: Column, noise_median: Column) -> Column:
    return (cov_min >= 0.99) & (noise_median <= 0.01) & (cov_max - cov_min < 0.01)


def sweep_envelope(cells: DataFrame) -> DataFrame:
    """One row over sweep cells (coverage, noise): medians, bounds, separable, degenerate."""
    got = cells.agg(
        F.median("coverage").alias("coverage_median"), F.min("coverage").alias("coverage_min"),
        F.max("coverage").alias("coverage_max"), F.median("noise").alias("noise_median"),
        (F.count_if(F.col("noise") > 0.60) <= F.floor(F.count("*") / 2)).alias("separable"),
    )
    return got.withColumn("degenerate", is_degenerate(F.col("coverage_min"), F.col("coverage_max"), F.col("noise_median")))


def cluster_members(labels: DataFrame, cluster: str, order: str, top_k: int, per_cluster: int) -> DataFrame:
    """The first rows by ``order`` of the largest clusters, with the cluster's size and position."""
    top = cluster_sizes(labels, cluster, order).where(F.col("pos") <= top_k)
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(order))
    rows = labels.withColumnRenamed(cluster, "cluster").withColumn("nth", nth).where(F.col("nth") <= per_cluster)
    return rows.join(top, "cluster")


def cluster_examples(labels: DataFrame, rows: DataFrame, cluster: str, order: str, text: str, top_k: int = 10, each: int = 5, shown: int = 300) -> DataFrame:
    """(cluster, size, pos, examples): the largest clusters with the beginnings of their first texts."""
    some = cluster_members(labels.select(order, cluster), cluster, order, top_k, each).join(rows.select(order, text), order)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", F.substring(text, 1, shown).alias("t")))), lambda x: x["t"])
    return some.groupBy("cluster", "size", "pos").agg(listed.alias("examples")).orderBy("pos")


def banded(value: Column, bands) -> Column:
    """Name lo-hi of the first half-open band lo <= value < hi, or null."""
    out = None
    for lo, hi in bands:
        inside = (value >= lo) & (value < hi)
        name = f"{lo:.2f}-{hi:.2f}"
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def per_band(rows: DataFrame, band: str, key: Column, n: int) -> DataFrame:
    """n rows of each band, the smallest by ``key``."""
    nth = F.row_number().over(Window.partitionBy(band).orderBy(key))
    return rows.where(F.col(band).isNotNull()).withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def quality_by_threshold(judged: DataFrame, thresholds) -> DataFrame:
    """(t_serve, n, quality) of judged rows (serve_cosine, score) at or above each threshold; 0 for none."""
    cells = F.explode(F.array(*map(F.lit, thresholds))).alias("t_serve")
    t = judged.sparkSession.range(1).select(cells)
    met = t.join(judged, F.col("serve_cosine") >= F.col("t_serve"), "left")
    return met.groupBy("t_serve").agg(F.count("score").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("quality"))


def templated(verdicts: DataFrame) -> DataFrame:
    """(n_yes, n_clusters, passed) over one YES or NO per cluster; six in ten must be YES."""
    got = verdicts.agg(F.count_if(F.col("verdict") == "YES").alias("n_yes"), F.count("*").alias("n_clusters"))
    need = F.greatest(F.lit(1), F.bround(0.6 * F.col("n_clusters")))
    return got.withColumn("passed", (F.col("n_clusters") > 0) & (F.col("n_yes") >= need))


def agreement(rows: DataFrame, a: str, b: str, valid) -> DataFrame:
    """(n_auditable, agreements, rate): rate is null where no row has two valid verdicts."""
    both = rows.where(F.col(a).isin(*valid) & F.col(b).isin(*valid))
    got = both.agg(F.count("*").alias("n_auditable"), F.count_if(F.col(a) == F.col(b)).alias("agreements"))
    return got.withColumn("rate", F.try_divide("agreements", "n_auditable"))
