"""Studies over chat tables: plans of operators, and one row of figures collected at the end.

Vectors are hashed token counts unless ``embed`` gives others. A judge is an
``ask`` function (see ``operators.judging``); without one, what it would decide
does not pass and the outcome says so. ``transcripts`` is a folder of JSON lines that judge
calls are appended to, for ``plans.audit``. Each study returns a plain dict; frames for figures and
examples go into ``frames`` where a dict is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import costs, text
from ..operators import chat, density, judging, neighbours, sampling, stats, textvec
from ..operators.ordering import numbered
from ..sources.tables import append_transcript
from . import reports, rules
from .rules import Limits


# Grids and bands of the studies.
@dataclass(frozen=True)
class Grids:
    n_components: tuple = (5, 10, 20)
    min_cluster_size: tuple = (15, 20, 30, 50)
    min_samples: tuple = (3, 5, 10)
    k: tuple = (1, 5, 10, 50)
    t: tuple = (0.7, 0.8, 0.9)
    judge_bands: tuple = ((0.70, 0.80), (0.80, 0.90), (0.90, 0.95), (0.95, 1.00))
    serve_bands: tuple = ((0.90, 0.95), (0.95, 0.98), (0.98, 1.01))
    personal_bands: tuple = ((0.85, 0.90), (0.90, 0.95), (0.95, 1.01))
    h4_pairs: int = 10_000
    per_band: int = 300
    serve_per_band: int = 100
    personal_per_band: int = 40
    buffer: int = 69
    levels: int = field(default=density.LEVELS)

    def cells(self):
        return [(m, s) for m in self.min_cluster_size for s in self.min_samples]


Ask = Callable[[str], str]
Embed = Callable[[DataFrame], DataFrame]


def fixed(df: DataFrame) -> DataFrame:
    """A frame that several branches read: written once to the checkpoint folder."""
    from ..operators.ordering import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def _arm(rows: DataFrame, embed: Embed) -> tuple[DataFrame, DataFrame, dict]:
    """Rows of an arm after near-dedup, numbered anew, with their vectors; and the counts."""
    v = fixed(embed(rows.select("ord", F.col("prompt").alias("text"))))
    keep = neighbours.greedy_dedup(v).withColumnRenamed("ord", "old")
    ids = fixed(numbered(keep, "old"))
    left = rows.withColumnRenamed("ord", "old").join(ids, "old").drop("old")
    vectors = v.withColumnRenamed("ord", "old").join(ids, "old").select("ord", "v")
    return fixed(left), fixed(vectors), {"before": rows.count(), "after": left.count()}


def priced(spark, limits: Limits, prices: costs.Prices | None = None) -> tuple[Limits, dict]:
    """``limits`` with what prices decide, and how."""
    found = costs.derived_thresholds(spark, prices)
    missing = {n: found[n] for n in ("coverage", "near_share") if getattr(limits, n) is None}
    return replace(limits, **missing), found


def _judged(items: DataFrame, ask: Ask, kind: str, transcripts: str | None) -> DataFrame:
    """Judged items (prompt, ...), written once and appended to the transcripts."""
    judged = fixed(judging.judge(items, ask))
    if transcripts:
        append_transcript(judged.withColumn("kind", F.lit(kind)), transcripts)
    return judged


def _substitution(items: DataFrame) -> DataFrame:
    return items.withColumn("prompt", judging.substitution_prompt(F.col("prompt_b"), F.col("response_a")))


def _rates(items: DataFrame, ask: Ask, arm: str, transcripts: str | None) -> list[dict]:
    judged = _judged(_substitution(items).withColumn("arm", F.lit(arm)), ask, "h5", transcripts)
    got = judged.groupBy("band").agg(F.avg(text.verdict_score(F.col("verdict"))).alias("rate"), F.count("*").alias("n"))
    return [r.asDict() for r in got.orderBy("band").collect()]  # one row a band


def study_a(records: DataFrame, keep: Callable = text.is_writing_strict, ask: Ask | None = None, embed: Embed = textvec.hashed_vectors,
            limits: Limits = Limits(), grids: Grids = Grids(), seed: int = 42, prices: costs.Prices | None = None,
            transcripts: str | None = None, frames: dict | None = None) -> dict:
    """Concentration of prompts (ord, prompt, response) that ``keep`` picks, against two controls.

    The controls: as many prompts of any kind, and the picked ones with their words scrambled.
    """
    limits, thresholds = priced(records.sparkSession, limits, prices)
    records = fixed(chat.exact_dedup(records, "prompt", "ord"))
    subject = fixed(records.where(keep(F.col("prompt"))))
    n = subject.count()
    if n < limits.fewest:
        raise ValueError(f"{n} prompts pass the filter; {limits.fewest} are needed")
    s, sv, s_dedup = _arm(subject, embed)
    if s_dedup["after"] < limits.fewest:
        raise ValueError(f"{s_dedup['after']} prompts are left after near-dedup; {limits.fewest} are needed")
    _, uv, u_dedup = _arm(chat.sample(records, "ord", n, seed), embed)
    z, zv, z_dedup = _arm(chat.scrambled(subject, "ord", "prompt", seed), embed)

    def envelope(v):
        cells = density.sweep_cells(v, grids.n_components, grids.cells(), levels=grids.levels)
        return _one(stats.sweep_envelope(cells))

    h1, h1_control = envelope(sv), envelope(uv)
    h1["gap"] = h1["coverage_median"] - h1_control["coverage_median"]
    h1["pass"] = rules.concentrated(h1, limits)
    nearest = {name: fixed(neighbours.edges(v, k=1)) for name, v in (("subject", sv), ("scrambled", zv))}
    share = {name: e.agg(stats.fraction_above(F.col("cos"), limits.near)).first()[0] for name, e in nearest.items()}
    h3 = {"fraction": share["subject"], "control": share["scrambled"]}
    h3["pass"] = rules.near_enough(h3, limits)
    pairs = sampling.stratified_pairs(sv, grids.h4_pairs, seed=seed).select("i", "j", F.col("cos").alias("pc"))
    rv = fixed(embed(s.select("ord", F.col("response").alias("text"))))
    a, b = (rv.select(F.col("ord").alias(x), F.col("v").alias(f"v{x}")) for x in "ij")
    both = pairs.join(a, "i").join(b, "j").select("pc", neighbours.dot(F.col("vi"), F.col("vj")).alias("rc"))
    both = fixed(both)
    h4 = _one(stats.correlations(both, "pc", "rc"))
    h4["pass"] = rules.correlated(h4, limits)
    out = {"kind": "A", "n": n, "thresholds": thresholds, "dedup": {"subject": s_dedup, "unfiltered": u_dedup, "scrambled": z_dedup},
           "H1": h1, "H1_control": h1_control, "H3": h3, "H4": h4}
    labels = fixed(density.density_clusters(density.reduce(sv, grids.n_components[1]), levels=grids.levels))
    if frames is not None:
        frames["cluster_sizes"] = stats.cluster_sizes(labels, "cluster", "ord")
        frames["nn_similarity"] = reports.histograms(nearest, "cos")
        frames["prompt_vs_response"] = both.select(F.col("pc").alias("prompt_cosine"), F.col("rc").alias("response_cosine"))
        frames["cluster_examples"] = stats.cluster_examples(labels, s, "cluster", "ord", "prompt")
    if ask is None:
        return out | {"outcome": "Pilot: no decision without a judge"}

    members = stats.cluster_members(labels, "cluster", "ord", 10, 8).join(s.select("ord", "response"), "ord")
    shown = members.groupBy("cluster").agg(F.concat_ws("\n---\n", F.sort_array(F.collect_list(F.substring("response", 1, 800)))).alias("r"))
    asked = shown.select("cluster", F.concat(F.lit("Do these responses follow one template? End with VERDICT: YES or NO.\n\n"), "r").alias("prompt"))
    h2 = _one(stats.templated(_judged(asked, ask, "h2", transcripts)))
    h2["pass"] = h2.pop("passed")
    bands = _rates(sampling.banded_items(sv, s, grids.judge_bands, grids.per_band, seed), ask, "subject", transcripts)
    control = _rates(sampling.banded_items(zv, z, grids.judge_bands, grids.per_band, seed), ask, "scrambled", transcripts)
    best, floor = (max((x["rate"] for x in r), default=0.0) for r in (bands, control))
    calibrated = min((float(x["band"].split("-")[0]) for x in bands if x["rate"] >= limits.accepted), default=None)
    h5 = {"bands": bands, "best": best, "control": floor, "s3": calibrated}
    h5["pass"] = rules.accepted(h5, limits)
    passed = [F.lit(bool(h["pass"])) for h in (h1, h2, h3, h4, h5)]
    outcome = records.sparkSession.range(1).select(costs.rubric_a(*passed)).first()[0]
    return out | {"H2": h2, "H5": h5, "outcome": outcome}


def _quality(judged: DataFrame) -> DataFrame:
    scored = judged.withColumn("score", text.verdict_score(F.col("verdict")))
    return stats.quality_by_threshold(scored, costs.T_SERVE).select("t_serve", "quality")


def _no_quality(spark) -> DataFrame:
    return costs.grid(spark, t_serve=costs.T_SERVE).withColumn("quality", F.lit(0.0))


def _economics(spark, hits: DataFrame, quality: DataFrame) -> tuple[list[dict], dict, DataFrame]:
    """Quality by serve threshold (three rows), what the 180 cells come to, and the cells."""
    quality = fixed(quality)
    cells = fixed(costs.pareto(spark, hits, quality))
    best = costs.best_cell(cells).first()
    figures = {"n_cells": cells.count(), "n_feasible": cells.where("feasible").count(), "best": best.asDict() if best else None}
    return [r.asDict() for r in quality.orderBy("t_serve").collect()], figures | {"pass": best is not None}, cells


@dataclass
class Retrieval:
    """What studies B and C find: numbered pairs, the dense edges, hit tables by retriever and the pairs' own cosines."""

    base: DataFrame
    pairs: DataFrame
    dense: DataFrame
    tables: dict
    rates: dict
    own: dict

    def hits(self) -> dict:
        return {name: [{"k": k, "t": t, "rate": r} for (k, t), r in sorted(rate.items())] for name, rate in self.rates.items()}


def retrieval(turns: DataFrame, embed: Embed, grids: Grids, seed: int) -> Retrieval:
    """Hit tables of consecutive prompts by dense, TF-IDF and random retrievers."""
    raw = chat.turn_pairs(turns, with_reply=True)
    ids = numbered(raw.select("conv_id", "turn_idx"), "conv_id", "turn_idx")
    base = fixed(raw.join(ids, ["conv_id", "turn_idx"]))
    if base.isEmpty():
        raise ValueError("no conversation has two answered prompts")
    anchors, targets = (base.select("ord", F.col(c).alias("text")) for c in ("anchor", "target"))
    goal = embed(targets).select("ord", F.col("v").alias("target"))
    av = fixed(embed(anchors))
    pairs = fixed(base.select("ord", F.col("conv_id").alias("conv")).join(goal, "ord"))
    dense = fixed(neighbours.edges(av, k=grids.buffer))
    arms = {
        "dense": dense,
        "tfidf": textvec.sparse_edges(textvec.tfidf(anchors), anchors, grids.buffer),
        "random": neighbours.random_edges(anchors, grids.buffer + 1, seed),
    }
    tables = {name: fixed(neighbours.hit_table(e, pairs, grids.k, grids.t)) for name, e in arms.items()}
    rates = {name: {(r.k, r.t): r.rate for r in t.collect()} for name, t in tables.items()}  # a literal grid
    own = pairs.join(av, "ord").select(neighbours.dot(F.col("v"), F.col("target")).alias("c"))
    return Retrieval(base, pairs, dense, tables, rates, _one(own.agg(*stats.distribution("c", (0.7, 0.9)))))


def study_b(turns: DataFrame, embed: Embed = textvec.hashed_vectors, grids: Grids = Grids(), seed: int = 42) -> dict:
    """How well other conversations' next prompts predict one's own; no decision is taken."""
    got = retrieval(turns, embed, grids, seed)
    n = got.base.select("conv_id").distinct().count()
    return {"kind": "B", "n_conversations": n, "n_pairs": got.pairs.count(), "hits": got.hits(), "consecutive": got.own,
            "outcome": "No decision: answers are not judged here"}


def best_lift(rates: dict, name: str) -> dict:
    """The cell in which a retriever beats chance by most; of equals the first of the grid."""
    cells = [(rate - rates["random"].get(c, 0.0), rate, c) for c, rate in sorted(rates[name].items())]
    lift, rate, (k, t) = max(cells, key=lambda x: x[0])
    return {"k": k, "t": t, "rate": rate, "random": rates["random"].get((k, t), 0.0), "lift": lift}


def study_c(turns: DataFrame, ask: Ask | None = None, embed: Embed = textvec.hashed_vectors, limits: Limits = Limits(),
            grids: Grids = Grids(), seed: int = 42, transcripts: str | None = None, frames: dict | None = None) -> dict:
    """Whether other conversations' next prompts predict one's own well enough to pay for it."""
    spark = turns.sparkSession
    got = retrieval(turns, embed, grids, seed)
    best = {name: best_lift(got.rates, name) for name in ("dense", "tfidf")}
    hp1 = best | {"best_lift": max(b["lift"] for b in best.values())}
    hp1["pass"] = rules.lifted(hp1, limits)
    hp3 = dict(got.own)
    hp3["pass"] = rules.same_session(hp3, limits)

    quality, judged_n = _no_quality(spark), 0
    if ask is not None:
        found = neighbours.best_cross_neighbour(got.dense, got.pairs).where("j <> -1")
        picked = serve_sample(found, grids.serve_bands, grids.serve_per_band, seed)
        a = got.base.select(F.col("ord").alias("i"), F.col("target").alias("prompt_b"))
        b = got.base.select(F.col("ord").alias("j"), F.col("target_response").alias("response_a"))
        items = picked.join(a, "i").join(b, "j").withColumnRenamed("cos", "serve_cosine")
        judged = _judged(_substitution(items), ask, "hp2", transcripts)
        quality, judged_n = _quality(judged), judged.count()
    hits = got.tables["dense"].select("k", "t", "rate").toDF("k", "t_pred", "hit_rate")
    served, hp4, cells = _economics(spark, hits, quality)
    if frames is not None:
        frames["pareto"] = cells
    hp2 = {"quality": served, "n_judged": judged_n}
    hp2["pass"] = rules.served(hp2, limits)
    passed = [F.lit(bool(h["pass"])) for h in (hp1, hp2, hp3, hp4)]
    outcome = spark.range(1).select(costs.rubric_c(*passed)).first()[0]
    return {"kind": "C", "n_pairs": got.pairs.count(), "hits": got.hits(), "HP1": hp1, "HP2": hp2, "HP3": hp3, "HP4": hp4, "outcome": outcome}


def serve_sample(matches: DataFrame, bands, per_band: int, seed: int) -> DataFrame:
    """Matches (i, j, cos) by serve band, ``per_band`` of each, the smallest by md5."""
    banded = matches.withColumn("band", stats.banded(F.col("cos"), bands))
    return stats.per_band(banded, "band", F.struct(text.md5_order(seed, F.col("i")), F.col("i")), per_band)


def one_guess_hits(spark, matches: DataFrame, ts=costs.T_PRED) -> DataFrame:
    """(k, t_pred, hit_rate) for one guess: the share of matches at or above each threshold."""
    shares = matches.agg(*(stats.fraction_above(F.col("cos"), t).alias(str(n)) for n, t in enumerate(ts)))
    cells = F.array(*(F.struct(F.lit(1).alias("k"), F.lit(t).alias("t_pred"), F.col(str(n)).alias("hit_rate")) for n, t in enumerate(ts)))
    return shares.select(F.explode(cells).alias("c")).select("c.*")


def study_d(conversations: DataFrame, ask: Ask | None = None, embed: Embed = textvec.hashed_vectors, limits: Limits = Limits(),
            grids: Grids = Grids(), seed: int = 42, transcripts: str | None = None, frames: dict | None = None) -> dict:
    """Whether one person's first prompts recur, over (ord, prompt, response) in order of time.

    The judge is asked only where enough of them recur; hits are known for one guess only.
    """
    spark = conversations.sparkSession
    rows = fixed(conversations.select("ord", "prompt", "response"))
    n = rows.count()
    if n < limits.fewest_conversations:
        raise ValueError(f"{n} conversations; {limits.fewest_conversations} are needed")
    every = fixed(neighbours.prior_matches(embed(rows.select("ord", F.col("prompt").alias("text")))))
    matches = every.where("j <> -1")
    near = stats.fraction_above(F.col("cos"), limits.recurring_cos).alias("fraction")
    hp1 = _one(matches.agg(F.count("*").alias("n_eligible"), near))
    hp1["pass"] = rules.recurs(hp1, limits)
    hp3 = _one(every.where("i between 1 and 5").agg(F.count("*").alias("n"), near))
    hp3["pass"] = rules.early(hp3, limits)
    quality, judged_n = _no_quality(spark), 0
    if ask is not None and hp1["pass"]:
        picked = serve_sample(matches, grids.personal_bands, grids.personal_per_band, seed)
        a = rows.select(F.col("ord").alias("i"), F.col("prompt").alias("prompt_b"))
        b = rows.select(F.col("ord").alias("j"), F.col("response").alias("response_a"))
        items = picked.join(a, "i").join(b, "j").withColumnRenamed("cos", "serve_cosine")
        judged = _judged(_substitution(items), ask, "hp2", transcripts)
        quality, judged_n = _quality(judged), judged.count()
    served, hp4, cells = _economics(spark, one_guess_hits(spark, matches), quality)
    if frames is not None:
        frames["pareto"] = cells
        frames["recurring_pairs"] = recurring_pairs(matches, rows, limits.recurring_cos)
    hp2 = {"quality": served, "n_judged": judged_n}
    hp2["pass"] = rules.served(hp2, limits)
    passed = [F.lit(bool(h["pass"])) for h in (hp1, hp2, hp3, hp4)]
    outcome = spark.range(1).select(costs.rubric_d(*passed)).first()[0]
    distribution = _one(matches.agg(*stats.distribution("cos", (0.7, 0.85, 0.95))))
    return {"kind": "D", "n": n, "HP1": hp1, "HP2": hp2, "HP3": hp3, "HP4": hp4, "distribution": distribution, "outcome": outcome}


def recurring_pairs(matches: DataFrame, rows: DataFrame, least: float, n: int = 20, shown: int = 300) -> DataFrame:
    """(cos, i, j, prompt, prior): the n nearest recurring prompts, the earlier of equals first."""
    top = matches.where(F.col("cos") >= least).orderBy(F.desc("cos"), "i").limit(n)
    a = rows.select(F.col("ord").alias("i"), F.substring("prompt", 1, shown).alias("prompt"))
    b = rows.select(F.col("ord").alias("j"), F.substring("prompt", 1, shown).alias("prior"))
    return top.join(a, "i").join(b, "j").select("cos", "i", "j", "prompt", "prior").orderBy(F.desc("cos"), "i")
