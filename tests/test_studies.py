"""Numbering, clusters, samples, judging, studies, reports and the incremental stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill import __main__ as command
from turnmill.functions import costs
from turnmill.operators import chat, density, judging, neighbours, ordering, sampling
from turnmill.operators.components import components
from turnmill.plans import audit, registry, reports, rules, studies
from turnmill.sources import tables
from turnmill.streaming import incremental


def unit(rows):
    x = np.array(rows, dtype=float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(groups=3, size=40, noise=15, dims=8):
    rng = np.random.default_rng(3)
    parts = [np.eye(dims)[k] + 0.03 * rng.standard_normal((size, dims)) for k in range(groups)]
    return unit(np.concatenate([*parts, rng.standard_normal((noise, dims))]))


def as_vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ord long, v array<double>")


def test_numbers_follow_the_order(spark):
    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("x")).repartition(5)
    got = ordering.numbered(rows, "x")
    assert got.count() == 2000 and got.where("x <> ord").count() == 0
    assert ordering.numbered(rows.limit(0), "x").count() == 0


def test_ranks_share_ties(spark):
    values = [5.0, 1.0, 5.0, 9.0, -0.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted(r.r for r in ordering.average_rank(df, "v", "r").collect())
    assert got == [1.5, 1.5, 3.0, 4.5, 4.5, 6.0]


def test_components_of_several_graphs(spark):
    chain = [(1, i, i + 1) for i in range(30)] + [(2, 5, 9), (2, 9, 7), (2, 1, 2)]
    got = {(r.g, r.node): r.root for r in components(spark.createDataFrame(chain, "g int, u long, v long"), ["g"]).collect()}
    assert {got[1, i] for i in range(31)} == {0}
    assert [got[2, n] for n in (1, 2, 5, 7, 9)] == [1, 1, 5, 5, 5] and len(got) == 36


def test_planted_clusters_are_found(spark):
    labels = density.density_clusters(as_vectors(spark, planted()), ((20, 5),)).orderBy("ord").collect()
    named = [r.cluster for r in labels]
    for k in range(3):
        own = named[40 * k : 40 * (k + 1)]
        assert sum(c == 40 * k for c in own) >= 36
    assert named[120:].count(-1) >= 13


def test_reduction_keeps_unit_length(spark):
    got = density.reduce(as_vectors(spark, planted()), 3).collect()
    assert all(np.linalg.norm(r.v) == pytest.approx(1.0) for r in got) and len(got[0].v) == 3


def test_fewer_rows_than_samples_are_noise(spark):
    got = density.density_clusters(as_vectors(spark, unit([[1, 0], [0, 1]])), ((2, 3),)).collect()
    assert [r.cluster for r in got] == [-1, -1]


def test_registered_sweep_covers_the_grid(monkeypatch):
    monkeypatch.setattr(registry, "_vectors", lambda spark, sf_dir: None)
    monkeypatch.setattr(density, "sweep_cells", lambda v, dims, cells, **_: [(d, *c) for d in dims for c in cells])
    grid = studies.Grids()
    got = registry.QUERIES["cluster_sweep"](None, "")
    assert sorted(got) == sorted((d, *c) for d in grid.n_components for c in grid.cells()) and len(set(got)) == 36


def test_audit_sample_takes_all_of_a_small_pool(spark):
    calls = spark.createDataFrame([(0, "h", "control")] + [(i, "a", "subject") for i in range(1, 4)], "i long, band string, arm string")
    assert sampling.audit_sample(calls, "i", 10).count() == 3
    assert sampling.audit_sample(calls, "i", 2).count() == 2


def test_judge_retries_and_gives_up():
    waits, left = [], [2]

    def ask(prompt):
        if left[0]:
            left[0] -= 1
            raise judging.Retry
        return prompt

    assert judging.ask_again(ask, "x", waits.append) == "x" and waits == [1.0, 2.0]
    left[0] = 99
    with pytest.raises(judging.Retry):
        judging.ask_again(ask, "x", waits.append)
    assert waits[-1] == 16.0


@pytest.fixture
def yes():
    # A lambda travels to the workers by value; a named function of a test module would not.
    return lambda prompt: "VERDICT: YES" if "template" in prompt else "fine. verdict: acceptable"


def test_judge_and_supplied_verdicts(spark, yes):
    items = spark.createDataFrame([(1, "p"), (2, "q")], "i long, prompt string")
    assert {r.verdict for r in judging.judge(items, yes).collect()} == {"ACCEPTABLE"}
    table = spark.createDataFrame([(1, "BORDERLINE")], "i long, verdict string")
    assert {(r.i, r.verdict) for r in judging.supplied(items, table, "i").collect()} == {(1, "BORDERLINE"), (2, "UNKNOWN")}


SMALL = studies.Grids(n_components=(3, 4), min_cluster_size=(5,), min_samples=(3,), h4_pairs=40, per_band=5, levels=4)


def test_study_a(spark, yes):
    words = "write a report on " "apples pears plums figs dates limes".split()
    rows = [(i, f"write a report on {words[i % 6]} number {i} {words[(i // 6) % 6]}", f"text on {words[i % 6]} {i}") for i in range(60)]
    records = spark.createDataFrame(rows, "ord long, prompt string, response string")
    got = studies.study_a(records, ask=yes, grids=SMALL)
    assert got["n"] == 60 and set(got) >= {"H1", "H2", "H3", "H4", "H5"} and got["outcome"]
    assert studies.study_a(records, grids=SMALL)["outcome"].startswith("Pilot")
    with pytest.raises(ValueError):
        studies.study_a(records.limit(10), grids=SMALL)


def test_study_c_and_its_files(spark, sf, tmp_path, yes):
    got = studies.study_c(spark.read.parquet(f"{sf}/conversations.parquet"), ask=yes)
    assert got["n_pairs"] == 18 and len(got["hits"]["dense"]) == 12 and got["HP4"]["n_cells"] == 180
    assert got["outcome"] == "Abandon" or got["HP1"]["pass"]
    folder = reports.write_run(got, tmp_path)
    assert json.loads((folder / "headline_numbers.json").read_text())["outcome"] == got["outcome"]
    assert reports.latest(tmp_path) == folder and got["outcome"] in (folder / "summary.md").read_text()


def test_study_d_asks_only_where_prompts_recur(spark):
    asked = spark.sparkContext.accumulator(0)

    def ask(prompt):
        asked.add(1)
        return "VERDICT: ACCEPTABLE"

    same = [(i, "how do I bake bread", f"reply {i}") for i in range(30)]
    got = studies.study_d(spark.createDataFrame(same, "ord long, prompt string, response string"), ask)
    assert got["HP1"]["fraction"] == 1.0 and got["HP2"]["pass"] and asked.value > 0
    assert got["HP4"]["best"]["k"] == 1 and got["outcome"] == "Commit to project"
    before = asked.value
    apart = [(i, f"w{i}a w{i}b w{i}c w{i}d", "r") for i in range(30)]
    got = studies.study_d(spark.createDataFrame(apart, "ord long, prompt string, response string"), ask)
    assert got["outcome"] == "Abandon" and asked.value == before


def test_histogram_counts_all(spark):
    got = reports.histogram(spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [2, 0, 1, 1]


def test_stream_keeps_first_and_survives_a_replay(spark, tmp_path):
    run = incremental.first_seen("text", "ord", str(tmp_path / "d"))
    pick = incremental.running_sample("ord", 2, str(tmp_path / "s"))
    batches = [[(0, "a"), (1, "A ")], [(2, "a"), (3, "b")]]
    frames = [spark.createDataFrame(b, "ord long, text string") for b in batches]
    for n in (0, 1, 1):  # the last batch comes twice
        run(frames[n], n)
        pick(frames[n], n)
    kept = spark.read.parquet(str(tmp_path / "d" / "records"))
    assert sorted(r.ord for r in kept.collect()) == [0, 3]
    assert spark.read.parquet(str(tmp_path / "s" / "batch=1")).count() == 2


def test_stream_over_files(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("ord"), F.lit("same").alias("text")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ord long, text string").parquet(str(tmp_path / "in"))
    run = incremental.first_seen("text", "ord", str(tmp_path / "out"))
    query = source.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.ord for r in spark.read.parquet(str(tmp_path / "out" / "records")).collect()] == [0]


# -- pass rules at and below their edges
LIMITS = rules.Limits(coverage=0.17, near_share=0.17)
GOOD = {
    "concentrated": {"separable": True, "degenerate": False, "coverage_median": 0.17, "gap": 0.10},
    "near_enough": {"fraction": 0.17, "control": 0.1199},
    "correlated": {"spearman": 0.50},
    "accepted": {"s3": 0.9, "best": 0.75, "control": 0.50},
    "lifted": {"best_lift": 0.10},
    "served": {"quality": [{"quality": 0.0}, {"quality": 0.60}]},
    "same_session": {"median": 0.60, "ge_70": 0.30},
    "recurs": {"fraction": 0.30},
    "early": {"fraction": 0.15},
}
BAD = [
    ("concentrated", {"separable": False}), ("concentrated", {"degenerate": True}), ("concentrated", {"coverage_median": 0.1699}),
    ("concentrated", {"gap": 0.0999}), ("near_enough", {"control": 0.1201}), ("near_enough", {"fraction": 0.1699, "control": 0.0}),
    ("correlated", {"spearman": 0.4999}), ("correlated", {"spearman": float("nan")}), ("accepted", {"s3": None}),
    ("accepted", {"best": 0.6999, "control": 0.0}), ("accepted", {"control": 0.5001}), ("lifted", {"best_lift": 0.0999}),
    ("served", {"quality": [{"quality": 0.5999}]}), ("served", {"quality": []}), ("same_session", {"median": 0.5999}),
    ("same_session", {"ge_70": 0.2999}), ("recurs", {"fraction": 0.2999}), ("early", {"fraction": 0.1499}),
]


@pytest.mark.parametrize("name", sorted(GOOD))
def test_rules_pass_at_their_edge(name):
    assert getattr(rules, name)(GOOD[name], LIMITS)


@pytest.mark.parametrize("name,change", BAD)
def test_rules_fail_below_their_edge(name, change):
    assert not getattr(rules, name)(GOOD[name] | change, LIMITS)


def test_thresholds_follow_prices(spark):
    assert studies.priced(spark, rules.Limits())[0].coverage == studies.priced(spark, rules.Limits())[0].near_share == 0.17
    cheap = costs.Prices(c_small=0.05)
    limits, found = studies.priced(spark, rules.Limits(near_share=0.4), cheap)
    assert limits.coverage == found["coverage"] == 0.0514 and limits.near_share == 0.4
    assert not studies.priced(spark, rules.Limits(), costs.Prices(s_target=0.999))[1]["feasible"]


def test_serve_samples_have_the_bands_of_their_study(spark):
    grids = studies.Grids()
    matches = spark.range(5000).select(F.col("id").alias("i"), F.lit(0).alias("j"), (0.8 + F.col("id") * 0.2 / 4999).alias("cos"))
    for bands, n, names in ((grids.serve_bands, grids.serve_per_band, ["0.90-0.95", "0.95-0.98", "0.98-1.01"]),
                            (grids.personal_bands, grids.personal_per_band, ["0.85-0.90", "0.90-0.95", "0.95-1.01"])):
        got = studies.serve_sample(matches, bands, n, 42).groupBy("band").agg(F.count("*").alias("n"), F.min("cos").alias("lo")).collect()
        assert {r.band: r.n for r in got} == dict.fromkeys(names, n) and min(r.lo for r in got) >= bands[0][0]
    assert (grids.serve_per_band, grids.personal_per_band) == (100, 40)


def test_study_b_and_its_summary(spark, sf, tmp_path):
    got = studies.study_b(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert got["n_pairs"] == 18 and got["n_conversations"] == 12 and {len(r) for r in got["hits"].values()} == {12}
    text = (reports.write_run(got, tmp_path) / "summary.md").read_text()
    assert text.count("| 50 | 0.9 |") == 1 and "lift" in text and "consecutive" in text


def export_zip(path, conversations):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("conversations.json", json.dumps(conversations))
    return str(path)


def test_export_prompts_pair_the_answered_one(spark, tmp_path):
    say = lambda who, t: {"sender": who, "text": t}
    path = export_zip(tmp_path / "e.zip", [
        {"uuid": "b", "created_at": "2025-02-01T00:00:00Z", "chat_messages": [say("human", "u1"), say("human", "u2"), say("assistant", "a")]},
        {"uuid": "a", "created_at": "2025-01-01T00:00:00Z", "chat_messages": [say("human", "\t\n"), say("human", "x"), say("assistant", "y")]},
        {"uuid": "c", "chat_messages": [say("human", "lone")]},
    ])
    got = command.export_prompts(spark, path).orderBy("ord").collect()
    assert [(r.prompt, r.response) for r in got] == [("x", "y"), ("u2", "a")]


def test_message_text_strips_any_white_space(spark):
    row = spark.createDataFrame([("\n\t", [(" a\u00a0",), ("\t",), ("b\n",)])], "t string, c array<struct<text: string>>")
    assert row.select(tables.message_text(F.col("t"), F.col("c"))).first()[0] == "a\nb"


def test_raw_conversations_by_language_and_id(spark, tmp_path):
    talk = [("user", " hi "), ("assistant", "yes"), ("user", "more"), ("assistant", "done")]
    rows = [("English", talk, "h1", None), ("English", talk, "", "c2"), ("English", talk, None, None), ("German", talk, "h4", None)]
    raw = spark.createDataFrame(rows, "language string, conversation array<struct<role: string, content: string>>, conversation_hash string, conversation_id string")
    turns = tables.conversation_turns(raw)
    import hashlib

    ids = {"h1", "c2", hashlib.md5(b"hi").hexdigest()}
    assert {r.conv_id for r in turns.collect()} == ids
    path = tables.sample_path(str(tmp_path), "records", 2, 7)
    first = tables.cached(spark, path, lambda: chat.sampled_records(turns, 2, 7)).collect()
    assert len(first) == 2 and first[0].prompt == "hi"
    again = tables.cached(spark, path, lambda: pytest.fail("read from the cache")).collect()
    assert sorted(first) == sorted(again) and path != tables.sample_path(str(tmp_path), "records", 2, 8)
    both = chat.sampled_conversations(turns, 10).collect()
    assert {r.conv_id for r in both} == ids and all(r.user_turns == ["hi", "more"] for r in both)


def test_transcripts_feed_the_audit(spark, tmp_path, yes):
    calls = spark.createDataFrame([(f"q {n}", "0.90-0.95" if n % 2 else "0.95-1.00", n) for n in range(8)], "prompt_b string, band string, i long")
    calls = calls.withColumn("response_a", F.when(F.col("i") == 3, "a naked truth").otherwise("fine"))
    run = tmp_path / "study_x"
    run.mkdir()
    rates = studies._rates(calls, yes, "subject", f"file://{run / audit.TRANSCRIPTS}")
    studies._rates(calls, lambda p: "VERDICT: NO", "scrambled", f"file://{run / audit.TRANSCRIPTS}")
    assert {r["rate"] for r in rates} == {1.0}
    sheet = audit.write_sample(spark, run, n=6)
    text = sheet.read_text()
    assert text.count("## Pair ") == 6 and audit.score(run)["verdict"] == "no pair has two verdicts"
    parts = text.split("**Your verdict:** _")
    marks = ["acceptable"] * 4 + ["BORDERLINE", "_"]
    sheet.write_text("".join(p + (f"**Your verdict:** {m}" if m else "") for p, m in zip(parts, marks + [""])))
    got = audit.score(run)
    assert (got["total"], got["labelled"], got["unlabelled"], got["auditable"], got["agreements"], got["agreement"]) == (6, 5, 1, 5, 4, 0.8)
    assert got["verdict"] == "validated"
    sheet.write_text(sheet.read_text().replace("Your verdict:** acceptable", "Your verdict:** BORDERLINE", 1))
    assert audit.score(run)["verdict"] == "not validated"
    other = audit.relabel(spark, run, lambda p: "VERDICT: borderline" if "q 1" in p else "VERDICT: ACCEPTABLE")
    assert other["n_total"] == other["n_auditable"] == 6 and other["agreements"] + other["confusion"].get("ACCEPTABLE->BORDERLINE", 0) == 6
    rule = audit.content_rule(spark, run)
    assert rule["n_flagged"] == rule["confusion"].get("ACCEPTABLE->UNACCEPTABLE", 0) <= 1 and rule["n_total"] == 6
    assert len((run / "audit_content_rule.jsonl").read_text().splitlines()) == 6


def test_sheet_reads_back_pair_by_pair():
    rows = [{"id": n, "band": "b", "judge_verdict": v, "prompt_b": "p\n## Pair 9\nq", "response_a": "r"} for n, v in ((1, "ACCEPTABLE"), (2, "UNKNOWN"))]
    assert audit.read_sheet(audit.sheet(rows)) == [(1, "ACCEPTABLE", "_"), (2, "UNKNOWN", "_")]


def test_runs_resolve_by_name_path_or_pointer(tmp_path):
    folder = reports.write_run({"kind": "B", "outcome": "x"}, tmp_path)
    assert reports.resolve(tmp_path) == reports.resolve(tmp_path, folder.name) == folder
    assert reports.resolve(tmp_path, "/elsewhere").name == "elsewhere"


def test_cost_documents_hold_the_derived_thresholds(spark):
    text = reports.cost_document(spark)
    assert "| coverage | 0.1700 |" in text and "| 0.2 | 0.5 | 0.17 | True |" in text and text.count("| True |") + text.count("| False |") == 12
    assert "c_speculate" in reports.prefetch_document()


def test_frames_become_documents_and_figure_data(spark, tmp_path):
    labels = spark.createDataFrame([(i, i // 4 if i < 8 else -1) for i in range(10)], "ord long, cluster int")
    rows = labels.select("ord", F.concat(F.lit("line\n"), F.col("ord").cast("string")).alias("prompt"))
    from turnmill.operators import stats

    frames = {"cluster_examples": stats.cluster_examples(labels, rows, "cluster", "ord", "prompt"), "cluster_sizes": stats.cluster_sizes(labels, "cluster", "ord")}
    run = reports.write_run({"kind": "A", "outcome": "Marginal", "H1": {"coverage_median": 0.5}, "H1_control": {"coverage_median": 0.25},
                             "H3": {"fraction": 0.1, "control": 0.0}}, tmp_path, frames=frames)
    text = (run / "cluster_examples.md").read_text()
    assert "## Cluster 0 (size 4)" in text and "- line 0" in text and "Next: one attempt" in (run / "summary.md").read_text()
    assert (run / "subset_vs_control.csv").read_text().splitlines()[1] == "H1 coverage,0.5,0.25"
    assert spark.read.csv(f"file://{run}/figures/cluster_sizes.csv", header=True).count() == 2


def test_null_and_missing_vectors_have_no_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, None]), (3, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "ord long, v array<double>")
    assert [(r.i, r.j) for r in neighbours.edges(v, k=2).orderBy("i").collect()] == [(0, 3), (3, 0)]
    none = v.limit(0)
    assert neighbours.edges(none, k=1).count() == 0 and sampling.stratified_pairs(none, 10).count() == 0


@pytest.mark.parametrize("how", [{"k": 3}, {"k": 2, "mode": "prior"}, {"radius": 0.5, "mode": "upper"}])
def test_tiles_give_what_one_block_gives(spark, monkeypatch, how):
    v = as_vectors(spark, planted())
    want = sorted((r.i, r.j, r.cos) for r in neighbours.edges(v, **how).collect())
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    assert sorted((r.i, r.j, r.cos) for r in neighbours.edges(v, **how).collect()) == want


def test_command_line(spark, sf, tmp_path, monkeypatch):
    (tmp_path / "asker.py").write_text("def ask(prompt):\n    return 'VERDICT: ACCEPTABLE'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    out = str(tmp_path / "out")
    command.main(["study-b", f"{sf}/conversations.parquet", "--out", out, "--n", "9", "--cache", str(tmp_path / "cache")])
    assert json.loads((reports.latest(out) / "headline_numbers.json").read_text())["n_conversations"] == 9
    assert len(list((tmp_path / "cache").iterdir())) == 1
    command.main(["costs", "--write", str(tmp_path / "docs")])
    assert (tmp_path / "docs" / "cost_model.md").exists()
    say = lambda who, t: {"sender": who, "text": t}
    talks = [{"uuid": str(n), "created_at": f"2025-01-01T00:{n:02d}:00Z", "chat_messages": [say("human", "bake bread"), say("assistant", "so")]} for n in range(30)]
    command.main(["study-d", export_zip(tmp_path / "e.zip", talks), "--out", out])
    run = reports.latest(out)
    assert (run / "recurring_pairs.md").read_text().count("Cosine 1.000") == 20 and (run / "pareto.csv").exists()
