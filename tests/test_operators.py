"""Reference operators on literal fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill.functions import costs, text
from turnmill.operators import chat, neighbours, stats, textvec
from turnmill.sources import tables


def one(df):
    return df.collect()[0]


def test_normalise_collapses_unicode_space(spark):
    df = spark.createDataFrame([("  Write   an\nEMAIL ",), ("a\u00a0 b",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalise(F.col("t"))).collect()] == ["write an email", "a b", ""]


def test_exact_dedup_keeps_first(spark):
    df = spark.createDataFrame([(0, "Hi  there"), (1, "hi there"), (2, " HI THERE "), (3, "other")], "ord long, prompt string")
    assert sorted(r.ord for r in chat.exact_dedup(df, "prompt", "ord").collect()) == [0, 3]
    got = one(chat.dedup_stats(df, "prompt"))
    assert (got.before, got.after, got.rate) == (4, 2, 0.5)
    assert one(chat.dedup_stats(df.where("ord < 0"), "prompt")).rate == 0.0


def test_writing_filters(spark):
    rows = [("Write an email to Ann",), ("What is 2 + 2?",), ("Rewrite this so it sounds more confident.",),
            ("please help me with a speech",), ("x" * 500 + " write an email",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(text.is_writing_strict(F.col("t")), text.is_writing_recall(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [(True, True), (False, False), (False, True), (False, True), (False, False), (False, False)]


def test_content_flag_and_verdicts(spark):
    df = spark.createDataFrame([("a naked truth", "verdict: acceptable"), ("class assignment", "none"), (None, None)], "t string, r string")
    got = df.select(text.has_content(F.col("t")), text.verdict(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(True, "ACCEPTABLE"), (False, "UNKNOWN"), (False, "UNKNOWN")]


def test_prompt_parts_and_hit_key(spark):
    df = spark.createDataFrame([("PROMPT_B:\nask\nmore\n\nRESPONSE:\n reply ", "K=5@T=0.8")], "p string, k string")
    got = one(df.select(text.prompt_parts(F.col("p")).alias("p"), text.hit_key(F.col("k")).alias("k")))
    assert (got.p.prompt_b, got.p.response_a, got.k.k, got.k.t) == ("ask\nmore", "reply", 5, 0.8)


def test_pairing_state_machines(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "user", "u2"), (1, 3, "assistant", "a"), (1, 4, "assistant", "b"),
            (1, 5, "user", " "), (1, 6, "user", "u3"), (1, 7, "assistant", "c"), (2, 0, "assistant", "z"), (2, 1, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in chat.first_turn_records(turns).collect()] == [(1, "u1", "a")]
    assert [tuple(r) for r in chat.qa_pairs(turns).orderBy("k").collect()] == [(1, 0, "u2", "a"), (1, 1, "u3", "c")]
    assert [tuple(r) for r in chat.turn_pairs(turns, True).collect()] == [(1, 0, "u2", "u3", "c")]


def test_scramble_keeps_words(spark):
    df = spark.createDataFrame([(1, " a b\tc  d ")], "id long, t string")
    assert sorted(one(chat.scrambled(df, "id", "t")).t.split(" ")) == ["a", "b", "c", "d"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "ord long, v array<double>")


def test_greedy_dedup_chain_and_blob(spark):
    turn = lambda a: [math.cos(a), math.sin(a)]
    assert sorted(r.ord for r in neighbours.greedy_dedup(vectors(spark, [turn(0), turn(0.15), turn(0.3)])).collect()) == [0, 2]
    assert sorted(r.ord for r in neighbours.greedy_dedup(vectors(spark, [turn(0), turn(0.01), turn(0.02), turn(math.pi / 2)])).collect()) == [0, 3]


def test_greedy_dedup_equals_walk(spark, sf):
    v = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"))
    rows = sorted(v.collect())
    m = np.array([r.v for r in rows], dtype=np.float64)
    cos, gone, keep = m @ m.T, np.zeros(len(m), bool), []
    for i in range(len(m)):
        if not gone[i]:
            keep.append(rows[i].ord)
            gone[i + 1 :] |= cos[i, i + 1 :] >= 0.25
    assert sorted(r.ord for r in neighbours.greedy_dedup(v, 0.25).collect()) == keep


def test_greedy_dedup_decides_every_row_of_a_drift(spark):
    drift = vectors(spark, [[math.cos(0.006 * i), math.sin(0.006 * i)] for i in range(500)])
    radius = math.cos(0.009)  # each row meets the next one only
    assert sorted(r.ord for r in neighbours.greedy_dedup(drift, radius).collect()) == list(range(0, 500, 2))
    short = drift.where("ord < 12")  # by rounds alone
    assert sorted(r.ord for r in neighbours.greedy_dedup(short, radius, walk_edges=0).collect()) == list(range(0, 12, 2))


def test_prior_match_ties_to_lowest(spark):
    got = {r.i: (r.j, r.cos) for r in neighbours.prior_matches(vectors(spark, [[1, 0], [1, 0], [1, 0]])).collect()}
    assert got == {0: (-1, 0.0), 1: (0, 1.0), 2: (0, 1.0)}


def test_hit_table_excludes_own_conversation(spark):
    pairs = spark.createDataFrame([(0, 7, [1.0, 0.0]), (1, 7, [1.0, 0.0]), (2, 8, [1.0, 0.0])], "ord long, conv long, target array<double>")
    edge = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 2, 1), (2, 2, 1)], "i long, j long, rank int")
    got = {(r.k, r.t): r.rate for r in neighbours.hit_table(edge, pairs, (1, 2), (0.9,)).collect()}
    assert got == {(1, 0.9): pytest.approx(2 / 3), (2, 0.9): pytest.approx(2 / 3)}
    alone = pairs.withColumn("conv", F.lit(1))
    assert all(r.rate == 0 for r in neighbours.hit_table(edge, alone, (1, 2), (0.9,)).collect())


def test_correlations(spark):
    df = spark.createDataFrame([(float(x), float(x) ** 3, 5.0) for x in range(1, 11)], "x double, y double, c double")
    got = one(stats.correlations(df, "x", "y"))
    assert got.spearman == pytest.approx(1.0) and got.pearson < 0.99
    assert math.isnan(one(stats.correlations(df, "x", "c")).pearson)
    assert math.isnan(one(stats.correlations(df.limit(1), "x", "y")).spearman)
    ranks = stats.average_rank(spark.createDataFrame([(5.0,), (5.0,), (9.0,)], "a double"), "a", "r")
    assert sorted(r.r for r in ranks.collect()) == [1.5, 1.5, 3.0]


def test_fraction_and_coverage_sentinels(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (0.95,), (1.0,)], "v double")
    assert one(df.agg(stats.fraction_above(F.col("v"), 0.9)))[0] == pytest.approx(0.6)
    assert one(df.limit(0).agg(stats.fraction_above(F.col("v"), 0.9)))[0] == 0.0
    none = spark.createDataFrame([], "ord long, c int")
    got = one(stats.coverage(none, "c", "ord", 5))
    assert (got.coverage, got.noise) == (0.0, 1.0)


def test_sweep_envelope(spark):
    flat = spark.createDataFrame([(1.0, 0.0)] * 4, "coverage double, noise double")
    assert one(stats.sweep_envelope(flat)).degenerate
    noisy = spark.createDataFrame([(0.5, 0.7), (0.6, 0.7), (0.7, 0.1)], "coverage double, noise double")
    got = one(stats.sweep_envelope(noisy))
    assert not got.separable and not got.degenerate and got.coverage_median == 0.6


def test_costs(spark):
    got = {(r.c_small, r.p_small): r.min_p_cache for r in costs.sensitivity(spark).collect()}
    assert len(got) == 12 and got[(0.20, 0.50)] == 0.17
    df = spark.range(1).select(costs.min_p_cache(F.lit(0.999), F.lit(0.5), F.lit(0.05), F.lit(0.05)).alias("s"))
    assert one(df).s.asDict() == {"min_p_cache": 1.0, "feasible": False}
    s = spark.range(1).select(costs.savings(F.lit(1.0), F.lit(0.5), F.lit(0.002), F.lit(0.05)))
    assert one(s)[0] == pytest.approx(0.998)


def test_pareto_feasible_only_for_one_guess(spark):
    hits = costs.grid(spark, k=costs.K_GRID, t_pred=costs.T_PRED).withColumn("hit_rate", F.lit(1.0))
    quality = costs.grid(spark, t_serve=costs.T_SERVE).withColumn("quality", F.lit(1.0))
    cells = costs.pareto(spark, hits, quality)
    good = cells.where("feasible").select("k", "c_speculate").distinct().collect()
    assert cells.count() == 180 and [tuple(r) for r in good] == [(1, 0.2)]
    assert one(costs.best_cell(cells)).roi == pytest.approx(0.10)


def test_calibration(spark):
    bands = spark.createDataFrame([(0.7, 0.1), (0.8, 0.8), (0.9, 0.75), (0.95, 0.9)], "lo double, rate double")
    assert one(costs.calibrate_s3(bands, 0.7)).s3 == 0.8
    assert one(costs.calibrate_s3(bands, 0.99)).s3 is None


def test_templated_and_agreement(spark):
    yes = spark.createDataFrame([("YES",)] * 6 + [("NO",)] * 4, "verdict string")
    assert one(stats.templated(yes)).passed and not one(stats.templated(yes.limit(0))).passed
    rows = spark.createDataFrame([("ACCEPTABLE", "_"), ("UNKNOWN", "ACCEPTABLE")], "a string, b string")
    assert one(stats.agreement(rows, "a", "b", ("ACCEPTABLE",))).rate is None


def test_tfidf_unit_length(spark):
    rows = spark.createDataFrame([(0, "red fox red"), (1, "blue fox"), (2, "")], "ord long, text string")
    w = textvec.tfidf(rows)
    norms = w.groupBy("ord").agg(F.sum(F.col("w") * F.col("w"))).collect()
    assert all(r[1] == pytest.approx(1.0) for r in norms)
    near = textvec.sparse_edges(w, rows, 1).where("i = 0").collect()
    assert near[0].j == 1


def test_export_turns(spark):
    raw = '{"uuid": "c", "created_at": "2025-01-02T03:04:05Z", "chat_messages": [{"sender": "human", "text": " ", "content": [{"text": "a"}, {"text": "b"}]}, {"sender": "assistant", "text": "ok"}]}'
    rows = spark.createDataFrame([(0, raw)], "ord long, raw string")
    got = tables.export_turns(rows).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("user", "a\nb"), ("assistant", "ok")]
