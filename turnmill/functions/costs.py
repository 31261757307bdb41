"""Cost models as columns: cache economics, prefetch return, decision rubrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cost constants and grids.
C_CACHE, C_SMALL, P_SMALL, S_TARGET = 0.002, 0.20, 0.50, 0.50
SENSITIVITY = {"c_small": (0.02, 0.05, 0.10, 0.20), "p_small": (0.25, 0.50, 0.75)}
LATENCY_VALUE = 0.30
C_SPECULATE = (0.20, 0.50, 1.00)
K_GRID = (1, 3, 5, 10, 25)
T_PRED = (0.70, 0.80, 0.90, 0.95)
T_SERVE = (0.90, 0.95, 0.98)


@dataclass(frozen=True)
class Prices:
    """Costs as shares of the frontier model's, and the savings that make a cache worthwhile."""

    c_cache: float = C_CACHE
    c_small: float = C_SMALL
    p_small: float = P_SMALL
    s_target: float = S_TARGET


def savings(p_cache: Column, p_small: Column, c_cache: Column, c_small: Column) -> Column:
    """What is saved of a frontier call: all pay the lookup, and misses a mix of the small and the frontier model."""
    return 1.0 - c_cache - (1.0 - p_cache) * (1.0 - p_small + p_small * c_small)


def min_p_cache(s_target: Column, p_small: Column, c_cache: Column, c_small: Column) -> Column:
    """struct(min_p_cache, feasible): least cache-hit rate with ``savings`` of s_target.

    Savings grow by a straight line from those without a hit to 1 - c_cache at a hit rate of 1.
    """
    none, all_ = (savings(F.lit(p), p_small, c_cache, c_small) for p in (0.0, 1.0))
    feasible = all_ > s_target
    return F.struct(
        F.when(~feasible, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (all_ - s_target) / (all_ - none))).alias("min_p_cache"),
        feasible.alias("feasible"),
    )


def derived_thresholds(spark: SparkSession, prices: Prices | None = None) -> dict:
    """The least cache-hit rate as the threshold of studies' coverage and of their share of near prompts."""
    x = prices or Prices()
    solved = min_p_cache(*(F.lit(float(v)) for v in (x.s_target, x.p_small, x.c_cache, x.c_small)))
    rate, feasible = spark.range(1).select(solved.alias("s")).select(F.round("s.min_p_cache", 4), "s.feasible").first()
    note = f"least cache-hit rate at p_small {x.p_small}" if feasible else "savings stay below 1 - c_cache: no hit rate is enough"
    return {"coverage": rate, "near_share": rate, "feasible": feasible, "note": note}


def grid(spark: SparkSession, **axes) -> DataFrame:
    """Cross product of literal axes, in the axes' order."""
    arrays = [F.explode(F.array(*map(F.lit, v))).alias(k) for k, v in axes.items()]
    df = spark.range(1).select(arrays[0])
    for a in arrays[1:]:
        df = df.select("*", a)
    return df


def sensitivity(spark: SparkSession, prices: Prices | None = None) -> DataFrame:
    x = prices or Prices()
    solved = min_p_cache(F.lit(x.s_target), F.col("p_small"), F.lit(x.c_cache), F.col("c_small"))
    cells = grid(spark, **SENSITIVITY).withColumn("s", solved)
    return cells.select("c_small", "p_small", F.round("s.min_p_cache", 4).alias("min_p_cache"), "s.feasible")


def pareto(spark: SparkSession, hits: DataFrame, quality: DataFrame) -> DataFrame:
    """All cells with their return; hits (k, t_pred, hit_rate), quality (t_serve, quality), absent is 0."""
    cells = grid(spark, k=K_GRID, t_pred=T_PRED, t_serve=T_SERVE, c_speculate=C_SPECULATE)
    cells = cells.join(hits, ["k", "t_pred"], "left").join(quality, ["t_serve"], "left").na.fill(0.0, ["hit_rate", "quality"])
    roi = F.col("hit_rate") * F.col("quality") * LATENCY_VALUE - F.col("k") * F.col("c_speculate")
    return cells.withColumn("effective", F.col("hit_rate") * F.col("quality")).withColumn("roi", roi).withColumn(
        "feasible", F.col("roi") > 0
    )


def best_cell(cells: DataFrame) -> DataFrame:
    return cells.where("feasible").orderBy(F.desc("roi"), "k", "t_pred", "t_serve", "c_speculate").limit(1)


def rubric_a(h1: Column, h2: Column, h3: Column, h4: Column, h5: Column) -> Column:
    return (
        F.when(~h5, "Abandon")
        .when(h1 & h2 & h3 & h4, "Strong positive")
        .when(h1 & h2 & ~h3 & h4, "Weak positive")
        .when(~h1 & h2 & h4, "Domain mismatch")
        .when(~h1 & ~h2 & ~h3 & ~h4, "Marginal")
        .otherwise("Anomalous")
    )


def rubric_c(hp1: Column, hp2: Column, hp3: Column, hp4: Column) -> Column:
    return (
        F.when(~hp1 | ~hp2, "Abandon")
        .when(hp4, "Commit to prefetch project")
        .when(hp3, "Re-scope to within-session only")
        .otherwise("Re-scope to narrower domain")
    )


def rubric_d(hp1: Column, hp2: Column, hp3: Column, hp4: Column) -> Column:
    return (
        F.when(~hp1 | ~hp2, "Abandon")
        .when(hp4 & hp3, "Commit to project")
        .when(hp4, "Commit, power-user-only")
        .when(hp3, "Commit power-user-only")
        .otherwise("Re-scope to KV-warm-only")
    )


def calibrate_s3(bands: DataFrame, t5: float) -> DataFrame:
    """Lower edge of the lowest band whose rate is at least t5; null if none."""
    return bands.agg(F.min(F.when(F.col("rate") >= t5, F.col("lo"))).alias("s3"))


# What each outcome of a rubric asks for.
ACTIONS = {
    "A": {
        "Abandon": "write up the negative result; a failed H5 is not scoped anew",
        "Strong positive": "commit to the project and design its architecture",
        "Weak positive": "cache within a conversation, not across users",
        "Domain mismatch": "run again on a narrower slice",
        "Marginal": "one attempt at the narrowest viable slice",
        "Anomalous": "investigate, then decide again",
    },
    "C": {
        "Abandon": "prediction across users does not hold, or no threshold serves good answers",
        "Commit to prefetch project": "design the architecture around the best cell",
        "Re-scope to within-session only": "prefetch for one user within a session",
        "Re-scope to narrower domain": "try a narrower domain: no cell pays",
    },
    "D": {
        "Abandon": "first prompts do not recur, or no threshold serves good answers",
        "Commit to project": "build the personal prefetcher",
        "Commit, power-user-only": "build it for users with a long history",
        "Commit power-user-only": "build it for users with a long history, where it pays",
        "Re-scope to KV-warm-only": "warm the model's cache rather than serve answers",
    },
}
