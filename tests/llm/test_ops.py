"""Training-data operators against brute force, and on the odd cases each must define."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from turnmill.llm import (
    html_extract, license_scan, mixing, ordinal_toxicity, packing, pu_quality, quality_rules, queries, shard_store,
    simhash_dedup, topk_search,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string, h string, g string"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog by the river and the hill", "en", "b", 1, 0, "s", "h", "g"),
    (2, "THE quick brown fox jumps over the lazy dog by the river and the hill", "en", "a", 1, 0, "s", "h", "g"),
    (2, "THE quick brown fox jumps over the lazy dog by the river and the hill", "en", "a", 1, 0, "s", "h", "g"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 0, "", "", ""),
    (None, "one two three four five one two three four five six", "en", None, 1, 0, "s", "h", "g"),
    (None, None, None, None, None, None, None, None, None),
    (7, "word " * 30000, "en", "c", 1, 0, "s", "h", "g"),
    (8, "a  b\n\nc\td äö $%& !! Released under the MIT License.\nSPDX-License-Identifier: MIT OR (GPL-2.0-only AND Apache-2.0)", "de", "a", 1, 0, "s", "h", "g"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- op1
def slow_licences(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(w)) for p, label in license_scan.BASE_PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    starts = sorted(i for i, _ in at)
    return len(w), len(at), starts[0] if at else None, starts[-1] if at else None, ",".join(sorted({x for _, x in at}))


def test_licences_equal_brute_force(docs, odd):
    for df in (docs, odd):
        got = sorted(license_scan.scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), key=str)
        want = sorted(((r.doc_id, *slow_licences(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_licence_expressions(odd, none):
    assert license_scan.to_postfix("MIT OR (GPL-2.0-only AND Apache-2.0) */") == ["MIT", "GPL-2.0-only", "Apache-2.0", "and", "or"]
    assert license_scan.to_postfix("GPL-2.0 WITH Classpath-exception-2.0 AND MIT") == ["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "and"]
    assert license_scan.to_postfix("OR MIT") == []
    assert license_scan.evaluate(["GPL-2.0", "Classpath-exception-2.0", "with"])[0] == pytest.approx(0.7)
    row = license_scan.scan_licenses(odd).where("doc_id = 8").first()
    assert row.labels == "apache-2,gpl-2,mit" and row.base_labels == "mit" and row.score == 1.0
    assert license_scan.scan_licenses(none).count() == 0


def test_long_licence_expressions_are_whole():
    names = [f"Licence-{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    want = [names[0], *(x for n in names[1:] for x in (n, "or"))]
    assert license_scan.to_postfix(" OR ".join(names) + " and more words") == want  # "more" is no identifier
    assert license_scan.to_postfix(" OR ".join(names) + " and LicenseRef-more words") == want[:-1] + ["LicenseRef-more", "and", "or"]
    assert license_scan.to_postfix(" OR ".join(names) + " see below") == want
    assert license_scan.to_postfix("(" + " OR ".join(names) + ") see below") == want
    assert license_scan.to_postfix("MIT OR (" + " OR ".join(names) + " see below") == ["MIT"]
    assert license_scan.scan_text("SPDX-License-Identifier: (" + " OR ".join(names) + ") see")[5].count(",") == 59


def test_prose_after_a_tag_is_no_licence():
    assert license_scan.scan_text("SPDX-License-Identifier: The code is free")[5:] == ("", 0.0, 1, None)
    assert license_scan.scan_text("SPDX-License-Identifier: WTFPL OR unlicense")[5] == "unlicense,wtfpl"


def test_many_tags_on_one_line_are_linear():
    import time

    began = time.time()
    got = license_scan.scan_text("SPDX-License-Identifier: MIT AND Zlib " * 20_000 + "\nno more")
    assert got[5] == "mit,zlib" and got[7] == 20_000 and time.time() - began < 20


# -- op2
def test_toxicity(spark, sf, docs, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal_toxicity.train(docs, labels)
    assert np.all(np.diff(model["theta"]) > 0)
    got = ordinal_toxicity.score_documents(docs, model).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert np.mean([r.toxic == (r.y == 1) for r in got]) > 0.95
    assert all(r.severity == pytest.approx(r.p_grade_1 + r.p_grade_2 + r.p_grade_3) for r in got)
    assert ordinal_toxicity.score_documents(odd, model).count() == len(ODD)
    empty = ordinal_toxicity.train(none, labels.limit(0))
    assert [r.severity for r in ordinal_toxicity.score_documents(odd, empty).collect()] == [0.0] * len(ODD)


def test_ordinal_gradient_and_expected_severity(spark):
    rng = np.random.default_rng(8)
    grade = rng.integers(0, 4, 30)
    rows, cols, vals = rng.integers(0, 30, 90), rng.integers(0, 5, 90), rng.normal(size=90)
    p = rng.normal(size=8)
    _, grad = ordinal_toxicity.negative_log_likelihood(p, rows, cols, vals, grade, 5)
    for i in range(8):
        up, down = (ordinal_toxicity.negative_log_likelihood(p + d * np.eye(8)[i], rows, cols, vals, grade, 5)[0] for d in (1e-6, -1e-6))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    model = {"vocabulary": {b"vile": 0, b"rude": 1}, "w": np.array([1.5, 0.7]), "theta": np.array([1.0, 2.0, 4.5])}
    texts = ["a vile day", "rude and VILE words, rude", "good", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ordinal_toxicity.score_documents(df, model).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[a-z]+", (t or "").lower())
        s = sum(c * (1 + math.log(1 + 200 * w.count(x) / len(w))) for x, c in (("vile", 1.5), ("rude", 0.7)) if x in w)
        above = [1.0, *(1 / (1 + math.exp(k - s)) for k in (1.0, 2.0, 4.5)), 0.0]
        exact = [above[k] - above[k + 1] for k in range(4)]  # of each grade
        assert got[i].severity == pytest.approx(sum(k * q for k, q in enumerate(exact))) and got[i].toxic == (above[1] >= 0.5)


def test_grades_come_from_the_spread_over_sentences():
    assert ordinal_toxicity.spread("Vile one. Good two!\nviles three... ok", {b"vile", b"vile*"}) == 0.5
    assert ordinal_toxicity.spread(None, {b"vile"}) == 0.0
    share = np.array([0.9, 0.1, 0.5, 0.2, 0.8, 0.4, 0.0])
    assert ordinal_toxicity.grades(np.array([1, 1, 1, 1, 1, 1, 0], dtype=bool), share).tolist() == [3, 1, 2, 1, 3, 2, 0]


def test_toxicity_learns_one_text_of_an_id(spark):
    rows = [(i, "vile words here" if i % 2 else "kind words here") for i in range(200)] + [(1, "kind words"), (3, "so kind")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ordinal_toxicity.train(df, labels), ordinal_toxicity.train(df.repartition(5), labels)
    assert a["vocabulary"] == b["vocabulary"] and np.array_equal(a["w"], b["w"])


# -- op3
def slow_fingerprint(t):
    w = space_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    comp = slow_components(set(fp.values()))
    low = {}
    for i, f in fp.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    want = {(i, f"{f:016x}", low[comp[f]]) for i, f in fp.items()}
    assert {tuple(r) for r in simhash_dedup.op3_simhash_near_dedup(spark, sf).collect()} == want


def test_bit_sliced_links_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, (base[rng.integers(0, 5, 300)] ^ flips[:, 0]) ^ flips[:, 1]]))
    for radius in (0, 1, 2):
        i, j = simhash_dedup.links(fps, fps, radius)
        want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)  # many chunks: tiles must lose no link
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.link_fingerprints(df)).collect()}
    got = collections.defaultdict(set)
    for f in fps:
        s = int(f.view(np.int64))
        got[roots.get(s, s)].add(int(f))
    want = collections.defaultdict(set)
    for f, r in slow_components({int(f) for f in fps}).items():
        want[r].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each(odd, none):
    kept = simhash_dedup.one_of_each(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "7", "8", "None"]
    assert simhash_dedup.one_of_each(odd).columns == odd.columns
    assert simhash_dedup.one_of_each(none).count() == 0


def test_one_of_each_where_an_id_stands_on_two_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    c = "red green blue white black brown pink grey"
    rows = [(1, a), (1, b), (1, b), (2, b), (5, c), (1, None), (None, c)]
    got = simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (1, b), (5, c), (1, None)]))


def test_one_of_each_prefers_ids_to_rows_without(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta"
    for text in (a.upper(), a + " ", "\t" + a, a.title()):  # one of them has a smaller hash than a
        rows = [(None, text, 1), (4, a, 2), (4, a, 3), (9, text, 4), (None, a, 5)]
        df = spark.createDataFrame(rows, "doc_id long, text string, _keep int")
        got = simhash_dedup.one_of_each(df).collect()
        assert [(r.doc_id, r.text) for r in got] == [(4, a)] and got[0]["_keep"] == 2


def test_hot_band_keys_lose_no_link(spark, monkeypatch):
    """Fingerprints that share 32 bits and more, with small tiles: split by parts and then by chunks."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    low = rng.integers(0, 2**32, 150, dtype=np.uint64)
    fps = np.unique(np.r_[low, low ^ np.uint64(1 << 3), low[:40] ^ np.uint64(1 << 30 | 1 << 12), rng.integers(0, 2**10, 60, dtype=np.uint64)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.link_fingerprints(df)).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        got[roots.get(int(f.view(np.int64)), int(f.view(np.int64)))].add(int(f))
    for f, r in slow_components({int(f) for f in fps}).items():
        want[r].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_slim_tables_are_written_in_few_files(spark, monkeypatch, tmp_path):
    """A shuffle of many partitions does not make as many files of each table: each file costs an executor forks."""
    files, plain = {}, simhash_dedup.materialise

    def noted(df, label, *args, **kwargs):
        out = plain(df, label, *args, **kwargs)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash_dedup, "materialise", noted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[(i // 2 * k) % 59] + str(i // 2) for k in range(40)) + " tail" * (i % 2)) for i in range(600)]
    monkeypatch.setattr(simhash_dedup, "read_table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        simhash_dedup.op3_simhash_near_dedup(spark, "").write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    result = spark.read.parquet(f"{tmp_path}/out")
    files["result"] = len(result.inputFiles())
    most = 2 * spark.sparkContext.defaultParallelism
    assert result.count() == 600 and {"distinct", "edges", "least", "low", "named"} <= set(files) and max(files.values()) <= most
    fps = {f: slow_fingerprint(t) for f, t in rows}
    roots = slow_components(set(fps.values()))
    assert result.select("component_id").distinct().count() == len({roots[x] for x in fps.values()})


# -- op4
def test_shard_store(spark, tmp_path, odd, none):
    root = f"file://{tmp_path}/store"
    store = shard_store.ShardStore(spark, root, target_bytes=1 << 20, fanout=2)
    assert store.read(odd.schema).count() == 0
    for _ in range(3):
        store.append(odd.repartition(2))
    store.append(none)
    before = store.version()
    assert store.read(odd.schema).count() == 3 * len(ODD)
    after = store.compact(odd.schema)
    assert after > before and len(store.shards()) < len(store.shards(before))
    assert store.read(odd.schema, before).count() == 3 * len(ODD)
    rows = store.read(odd.schema).drop("shard_id", "tier", "shard_bytes").collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(3 * [tuple(r) for r in ODD])
    with pytest.raises(shard_store.Conflict):
        store.commit([], [], before)
    assert store.vacuum() == 0 and store.vacuum(0) > 0 and store.vacuum(0) == 0
    assert store.read(odd.schema).count() == 3 * len(ODD)


def test_vacuum_spares_a_writer_and_a_commit_misses_nothing(spark, tmp_path, odd):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/store")
    odd.write.parquet(f"{store.root}/data/x")
    assert store.vacuum() == 0  # the files are young: their writer has yet to commit
    files = store._found("data/x")
    assert store.adopt("data/x", files) == 1 and store.read(odd.schema).count() == len(ODD)
    odd.write.parquet(f"{store.root}/data/y")
    files = store._found("data/y")
    assert store.vacuum(0) > 0
    with pytest.raises(FileNotFoundError):
        store.adopt("data/y", files)
    assert store.version() == 1


def test_manifests_hold_changes(spark, tmp_path, odd):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/store", fanout=3)
    for _ in range(2 * shard_store.FULL_EVERY + 3):
        store.append(odd.coalesce(1))
    n = store.version()
    assert [("all" in store._manifest(v)) for v in (1, shard_store.FULL_EVERY, n)] == [False, True, False]
    assert len(store.shards()) == n and len(store.shards(5)) == 5 and len({s["id"] for s in store.shards()}) == n
    store.compact(odd.schema)
    assert store.read(odd.schema).count() == n * len(ODD) and len(store.shards()) < 3 and len(store.shards(n)) == n


def test_arrivals_of_rows_alike_are_even(spark, tmp_path):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, "x")] * 80, "doc_id long, text string").coalesce(1)
    assert len(store.append_split(rows, 8)) == 8 and store.read(rows.schema).count() == 80


def test_long_shard_list_is_salted(spark, tmp_path, odd, monkeypatch):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(odd.repartition(3))
    want = sorted(map(str, store.read(odd.schema).collect()))
    monkeypatch.setattr(shard_store, "BROADCAST_SHARDS", 1)
    assert sorted(map(str, store.read(odd.schema).collect())) == want and "shard_id=None" not in str(want)


def test_shard_query_round_trip(spark, sf, docs):
    got = shard_store.op4_sharding(spark, sf).collect()
    assert sorted((r.doc_id, r.text_crc32) for r in got) == sorted((r.doc_id, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert all(r.shard_id is not None for r in got)


# -- op5
def slow_rules(t):
    t = t or ""
    w = space_words(t)
    lines = [x for x in t.split("\n") if space_words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_equal_brute_force(docs, odd, none):
    for df in (docs, odd):
        got = quality_rules.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        want = []
        for r in df.select("doc_id", "text").collect():
            m = slow_rules(r.text)
            want.append(str((r.doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])))
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 8]


def test_quality_rules_are_native(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# -- op6
def check_packing(df):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(df).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    texts = collections.defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.doc_id].append(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    assert pieces.keys() == texts.keys()
    for doc_id, rows in pieces.items():
        assert sum(r.length for r in rows) == sum(map(len, texts[doc_id]))
        for r in rows:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[doc_id])
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
        padding += packing.LENGTH - at
    return padding / sum(r.length for r in got)


def test_packing(docs, odd, none):
    assert check_packing(docs) < 0.02
    check_packing(odd)
    assert packing.pack(none).count() == 0


def test_added_token_in_a_text(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"a{end}", end, f"{end}{end}x", f" \n{end}  y\n", f"<|{end}|>", "<|endoftext|", f"word {end}\u00a0{end} " * 700]
    for t in texts:
        assert np.frombuffer(packing.encoder()(t), dtype="<u2").tolist() == tok.encode(t, add_special_tokens=False).ids
    check_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_tournament_is_first_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 200).tolist()
    tree, free = packing.Tournament(200, 100), [100] * 200
    for n in lengths:
        want = next(b for b in range(200) if free[b] >= n)
        free[want] -= n
        assert tree.place(n) == want


def test_pieces_are_written_in_few_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} of many") for i in range(400)], "doc_id long, text string")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        packing.pack(df, group_rows=4).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("doc_id").distinct().count() == 400
    assert len(out.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism


def test_pack_lengths_loses_nothing():
    rng = np.random.default_rng(2)
    for _ in range(400):
        lengths = rng.integers(1, rng.integers(2, 101), rng.integers(1, 120)).tolist()
        bins = packing.pack_lengths(lengths, 100, int(rng.integers(1, 20)))
        pieces = collections.defaultdict(list)
        for b in bins:
            assert 0 < sum(n for _, _, n in b) <= 100
            for i, start, n in b:
                pieces[i].append((start, n))
        assert sorted(pieces) == list(range(len(lengths)))
        for i, parts in pieces.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == lengths[i]


def test_rows_that_repeat_by_thousands_are_dealt(spark):
    """A row repeated beyond a group's size is packed as often as it stands, over several groups."""
    text = "some words that repeat " * 150
    rows = [(1, text)] * 130 + [(None, None)] * 90 + [(i, f"text {i}") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, group_rows=40).collect()
    n = len(packing.encoder()(text)) // 2 + 1
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)[1, n] == 130
    assert sum(r.length for r in got if r.doc_id == 1) == 130 * n and sum(r.length for r in got if r.doc_id is None) == 90
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == 1}) > 3
    whole = packing.pack(df).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in got)


# -- op7
def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, capped = dict.fromkeys(names, 0.0), set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        for s in open_:
            goal[s] = rest * weight[s] / sum(weight[x] for x in open_)
        over = {s for s in open_ if goal[s] > 2 * sizes[s]}
        for s in over:
            goal[s] = 2.0 * sizes[s]
        if not over:
            return goal
        capped |= over


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        got = mixing.mix_counts(df).collect()
        sizes = collections.Counter()
        taken = collections.Counter()
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.size * len(r.shards)
            assert len(r.shards) <= 2
        want = slow_targets(sizes)
        for r in got:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        largest = max(r.size for r in got)
        assert all(abs(taken[s] - want[s]) <= largest for s in want)
        again = mixing.mix_counts(df.repartition(3)).collect()
        assert sorted(str((r.doc_id, r.size, r.shards)) for r in got) == sorted(str((r.doc_id, r.size, r.shards)) for r in again)
        copies = mixing.mixed_documents(df)
        assert copies.columns == df.columns and copies.count() == sum(len(r.shards) for r in got)
    assert mixing.mix_counts(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_repeated_rows_are_taken_to_the_target(spark):
    """Sources of identical rows alone: their copies are numbered, so takings meet the targets."""
    text = "one two three four five six seven eight nine ten"
    rows = [(i if s == "d" else 1, text, "en", s, i) for s, n in (("a", 600), ("b", 600), ("c", 600), ("d", 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = mixing.mix_counts(df).collect()
    taken, want = collections.Counter(), slow_targets(dict(a=6000, b=6000, c=6000, d=500))
    for r in got:
        taken[r.source] += 10 * len(r.shards)
        assert len(r.shards) <= 2
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 5 for s in want)
    copies = mixing.mixed_documents(df).groupBy("source").count().collect()
    assert {r.source: r["count"] * 10 for r in copies} == taken


def test_splitting_tree_is_exact(spark):
    units = spark.range(300).select(
        (F.col("id") % 3).alias("n"), F.floor(F.col("id") / 3).alias("place"), F.lit(100).cast("long").alias("words"),
    )
    got = mixing.split(units, shard_words=5000).collect()
    assert collections.Counter(r.shard for r in got) == dict.fromkeys(range(6), 50)
    assert collections.Counter(r.n for r in got) == dict.fromkeys(range(3), 100) and len({(r.n, r.place) for r in got}) == 300


def test_tree_quotas_are_hypergeometric(spark):
    """Against exact probabilities: 40 000 draws of 6 from 5 + 7, and wide ones by mean and variance."""
    u = (F.col("id") + 0.5) / 40_000
    long = lambda n: F.lit(n).cast("long")
    got = spark.range(40_000).select(mixing.hypergeometric(long(12), long(5), long(6), u).alias("x")).groupBy("x").count().collect()
    want = {x: math.comb(5, x) * math.comb(7, 6 - x) / math.comb(12, 6) for x in range(6)}
    assert {r.x: r["count"] / 40_000 for r in got} == pytest.approx({x: p for x, p in want.items() if p}, abs=1e-4)
    x = np.array([r.x for r in spark.range(2000).select(mixing.hypergeometric(long(10**6), long(3 * 10**5), long(5 * 10**5), (F.col("id") + 0.5) / 2000).alias("x")).collect()])
    assert x.mean() == pytest.approx(150_000, rel=1e-4) and x.var() == pytest.approx(52_500, rel=0.02)
    for total, good, drawn in ((0, 0, 0), (5, 0, 3), (5, 5, 3), (5, 2, 5), (5, 3, 0)):
        one = spark.range(1).select(mixing.hypergeometric(long(total), long(good), long(drawn), F.lit(0.999)).alias("x")).first().x
        assert one == min(good, drawn)
    quotas = spark.createDataFrame([(0, 1000), (1, 10), (2, 0), (3, 5000)], "n long, units long")
    leaves = mixing.tree(quotas, 37).collect()
    size = collections.Counter()
    for r in leaves:
        size[r.shard] += r.q
    assert sum(size.values()) == 6010 and max(size.values()) - min(size.values()) <= 7 and len(size) == 37
    for n, units in ((0, 1000), (1, 10), (3, 5000)):
        parts = sorted((r.first, r.q) for r in leaves if r.n == n)
        assert [p[0] for p in parts] == [sum(q for _, q in parts[:i]) for i in range(len(parts))] and sum(q for _, q in parts) == units


# -- op8
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article class="post p-%d"><h1>Head &amp; <b>bold</b>er</h1><p>First   para<br>graph &lt;one&gt;.
<p>Second<div class="ad">Buy</div><form><input value=x>Send</form><ul><li>a<li>b</ul><script>var t="</p><p>no";</script>
<!-- gone --><p title="a > b">Last &nbsp;one</p><section id="comments"><p>Nice post, I liked it a lot more than the article</p></section></article>
<aside>Side</aside><footer>&copy; me</footer>"""


def test_html(spark, sf):
    want = "Head & bolder First para graph <one>. Second a b Last one"
    assert html_extract.extract(PAGE % 1, None)[0] == want
    rows = [(1, "http://h/a", PAGE % 1, "x"), (2, "http://h/b", PAGE % 2, "x"), (3, None, PAGE % 3, "x"), (4, "http://h/c", None, "x"),
            (5, "http://h/d", "", "x"), (None, "junk", "plain <b>te</b>xt < 5", "x"), (7, "http://H/e", "<p" * 999, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 5)] == [want, want, want, "", ""]
    assert got[1].by_consensus and not got[3].by_consensus and got[None].text == "plain text < 5" and got[1].n_chars == len(want)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_pages_without_a_host_do_not_vote(spark):
    main, other = "A long main text, of many words and more. " * 9, "Another main text in a layout of its own. " * 9
    one = f'<body><div class="story"><p>{main}</p></div></body>'
    two = f'<body><div class="text"><p>{other}</p></div><div class="story"><p>A short note of few words</p></div></body>'
    rows = [(1, "/a", one), (2, "b.html", one), (3, "/c", two), (4, "http:///d", one), (5, "", one)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_extract.host_paths(pages).count() == 0
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert len(got) == 5 and not any(r.by_consensus for r in got.values())
    assert got[3].text == other.strip() and got[1].text == got[5].text == main.strip()


ARTICLE = "<p>" + "The article says this and then says that. " * 12 + "</p>"
SAID = ("The article says this and then says that. " * 12).strip()
LAYOUTS = [  # page with %s in the article's place, and how often its text is the result
    ('<div class="layout has-sidebar"><article>%s</article></div>', 1),
    ('<div class="no-sidebar">%s</div>', 1),
    ('<div class="post with-comments">%s</div>', 1),
    ('<div data-x="a hidden b">%s</div>', 1),
    ('<section class="social-policy">%s</section>', 1),
    ('<div><div title="the hidden truth">%s</div></div>', 1),
    ('<article>%s</article><article class="second">%s</article>', 2),
    ('<div class="sidebar-left"><main>%s</main></div>', 1),
    ('<form id="aspnet"><div id="c">%s</div></form>', 1),
    ('<div id="c"><section>%s</section><section>%s</section></div>', 2),
    ('<main><h1 id="comments">%s</h1></main>', 1),
    ('<body class="menu-open sidebar">%s<ol class="comment-list"><li><article>me too</article></ol>', 1),
    ('<table><tr><td class="left-menu">x<td>%s<tr><td>%s</table>', 2),
    ('<div class="related-posts"><article>Read on</article></div>%s<div class="cookieBanner">yes</div>', 1),
    ('<div class="ad">%s</div>', 0), ('<section id="comments">%s</section>', 0), ('<div hidden>%s</div>', 0),
    ('<div style="color:red; display : none">%s</div>', 0), ("<aside>%s</aside>", 0), ('<div class="site-footer">%s</div>', 0),
    ('<ul class="main-nav"><li>%s</ul>', 0), ('<div class="newsletter-signup">%s</div>', 0),
]


@pytest.mark.parametrize("layout,times", LAYOUTS)
def test_html_layouts(layout, times):
    n = layout.count("%s")
    page = "<html><body><nav><a href=x>m</a></nav>" + layout % ((ARTICLE,) * n) + "<div class=advert-slot>buy</div></body>"
    assert html_extract.extract(page, None)[0] == " ".join([SAID] * times)


def test_html_is_linear():
    import time

    for page in ("<div>" * 200_000, "</b>" * 250_000, "<div>" + "<i>" * 60_000 + "<hr>" * 60_000, '<a b">"' * 40_000,
                 "<ul>" + "<i>" * 60_000 + "<li></li>" * 60_000, "<b><section>" + "<i>" * 40_000 + "</b>" * 90_000):
        began = time.time()
        html_extract.extract(page, "html body")
        assert time.time() - began < 15


def test_lost_paths_without_broadcast(spark):
    """Pages of hosts with two layouts, and pages in a third; the result is that of the broadcast."""
    rows = []
    for i in range(60):
        body = (f'<div class="story">{ARTICLE}</div>' if i % 3 else f'<div class="text">{ARTICLE}</div><div class="story">{ARTICLE}</div>')
        rows.append((i, f"http://h{i % 4}/x", f'<body><div class="top">a few words</div>{body}</body>'))
    pages = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string")
    read = html_extract.materialise(html_extract.parsed(pages), "test-pages")
    one, other = (sorted(map(str, html_extract.with_host_path(read, n).select("page_id", "own", "path").collect())) for n in (1 << 20, 0))
    assert one == other and len(one) == 65
    got = html_extract.extract_pages(pages).collect()
    assert {r.text.count("and then") for r in got if r.page_id % 3} == {12} and len(got) == 65


def test_html_equals_plain_cut(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op8_html_extraction(spark, sf).collect():
        cut = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        cut = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", cut))
        assert r.text == re.sub(r"\s+", " ", html.unescape(cut)).strip()


# -- op9
def slow_top(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[(i, tuple(math.floor(1024 * float(x)) for x in v))] = None
    out = set()
    for i, q in good:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s)}
    return out


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.1, 1, 30])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(500, rows[0][1]), (500, rows[0][1])]
    rows += [(600, None), (700, [1.0, None] * 4), (701, [float("nan")] * 8), (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (900, []), (200000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = slow_top(rows)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk_search, "PROBES", 4)
    for share in (-1.0, 0.5, 1.0):  # by length alone, as estimated, by coordinates wherever there is a floor
        monkeypatch.setattr(topk_search, "SURVIVORS", share)
        got = topk_search.search(df, F.col("vec_id") % 100 == 0).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk_search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_coordinate_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    c = np.floor(1024 * rng.normal(size=(500, 6)))
    q = np.floor(1024 * rng.normal(size=(20, 6)))
    ids, q_ids = np.arange(500), np.arange(1000, 1020)
    scores = q @ c.T
    floors = np.sort(scores, axis=1)[:, -10]
    for i, (_, found, _) in zip(range(20), topk_search.top_of_tile(q_ids, q, floors, ids, c)):
        assert len(found) == 10
    got = {int(a[0]): sorted(s.tolist()) for a, _, s in topk_search.top_of_tile(q_ids, q, floors, ids, c)}
    assert all(got[1000 + i] == sorted(np.sort(scores[i])[-10:].tolist()) for i in range(20))


def test_pruning_verifies_fewer_candidates():
    """Skewed lengths are cut by length, skewed coordinates by coordinates; both keep the best."""
    rng = np.random.default_rng(9)
    ids, q_ids = np.arange(4000), np.arange(9000, 9040)
    longer, skewed = rng.lognormal(0, 1, (4000, 1)), 0.6 ** np.arange(32)
    cases = {"length": (rng.normal(size=(4000, 32)) * longer, rng.normal(size=(40, 32))),
             "coordinate": (rng.normal(size=(4000, 32)) * skewed, rng.normal(size=(40, 32)) * skewed)}
    for name, (c, q) in cases.items():
        c, q = np.floor(1024 * c), np.floor(1024 * q)
        scores, work = q @ c.T, {}
        floors = np.sort(scores, axis=1)[:, -10]
        found = topk_search.top_of_tile(q_ids, q, floors, ids, c, work=work)
        assert {int(a[0]): sorted(s.tolist()) for a, _, s in found} == {9000 + i: sorted(np.sort(scores[i])[-10:].tolist()) for i in range(40)}
        if name == "length":
            assert work["within"] < 0.6 * work["all"]
        else:
            assert work["coordinate"] > 10 and work["verified"] < 0.2 * work["all"]


def test_tiles_out_of_reach_are_dropped(spark):
    rows = [(i, [2.0 if i < 100 else 0.01, 0.0 if i % 2 else 0.001 * (i % 7)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk_search.blocked(topk_search.quantised(df))
    blocks = vectors.groupBy("dim", "bucket", "part").agg(F.max("norm").alias("longest"))
    queries = vectors.where("vec_id % 100 = 0").withColumn("q_part", F.lit(0)).withColumn("floor", F.col("norm") * 100.0)
    assert topk_search.reachable(queries, blocks).count() < blocks.count()
    assert {tuple(r) for r in topk_search.search(df, F.col("vec_id") % 100 == 0).collect()} == slow_top(rows)


# -- op10
def test_quality_classifier(spark, docs, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = pu_quality.train(docs, labels)
    got = pu_quality.score_documents(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.85
    assert pu_quality.score_documents(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert pu_quality.score_documents(none, model).count() == 0
    flat = pu_quality.train(none, labels.limit(0))
    assert {r.score for r in pu_quality.score_documents(odd, flat).collect()} == {0.5}
    kept = pu_quality.keep_predicted(odd, labels)
    assert kept.columns == odd.columns


def test_labels_of_held_out_and_negative_rows_do_not_matter(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b, c = pu_quality.train(docs, labels), pu_quality.train(docs, other), pu_quality.train(docs, labels.where("quality = 1"))
    assert np.array_equal(a["w"], b["w"]) and np.array_equal(a["w"], c["w"]) and a["prior"] == b["prior"] == c["prior"]


def test_risk_gradient_by_finite_differences(monkeypatch):
    """One step of the optimiser moves along the risk's gradient, on both sides of the zero of its second term."""
    rng = np.random.default_rng(6)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    for prior in (0.2, 0.95):
        w = rng.normal(0, 1, 3)

        def parts(w):
            gp, gu = p @ w, u @ w
            return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()

        slope = np.array([(np.subtract(parts(w + e), parts(w - e))) / 2e-6 for e in 1e-6 * np.eye(3)])
        want = slope[:, 0] + slope[:, 1] if parts(w)[1] >= 0 else -slope[:, 1]
        assert pu_quality.risk_gradient(p, u, w, prior) == pytest.approx(want, abs=1e-6)


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(7)
    for share in (0.2, 0.5, 0.9):
        p, u = rng.normal(2, 1, 4000), np.r_[rng.normal(2, 1, int(20_000 * share)), rng.normal(-2, 1, int(20_000 * (1 - share)))]
        edges = np.quantile(p, np.linspace(0, 1, 200))
        above = [np.array([(x >= e).sum() for e in edges]) for x in (u, p)]
        assert pu_quality.best_bin(above[0], len(u), above[1], len(p)) == pytest.approx(share, abs=0.04)


def test_nnpu_separates():
    rng = np.random.default_rng(5)
    positive = np.c_[rng.normal(1.5, 1, (500, 1)), np.ones(500)]
    unlabelled = np.c_[np.r_[rng.normal(1.5, 1, (600, 1)), rng.normal(-1.5, 1, (400, 1))], np.ones(1000)]
    w = pu_quality.fit_nnpu(positive, unlabelled, 0.6)
    right = np.r_[(unlabelled[:600] @ w) > 0, (unlabelled[600:] @ w) < 0]
    assert right.mean() > 0.88


# -- pipeline, registry
def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline

    now, names = docs, docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        rows = out.collect()
        if name == "quality_classifier":
            scored = pu_quality.score_documents(now, pu_quality.train(now, labels))
            assert {r.doc_id for r in rows} == {r.doc_id for r in scored.where("predicted = 1").collect()}
        if name == "quality_rules":
            assert all(slow_rules(r.text)[0] >= 10 and 100 * slow_rules(r.text)[4] <= 20 * slow_rules(r.text)[0] for r in rows)
        if name == "near_dedup":
            fp = {r.doc_id: slow_fingerprint(r.text) for r in now.collect()}
            comp = slow_components(set(fp.values()))
            low = {}
            for i, f in fp.items():
                low[comp[f]] = min(low.get(comp[f], i), i)
            assert sorted(r.doc_id for r in rows) == sorted(low.values())
        if name == "mixing":
            assert max(collections.Counter(r.doc_id for r in rows).values()) <= 2
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in now.collect()}
            break
        assert out.columns == names
        now = spark.createDataFrame(rows, out.schema)


def test_registered_names():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
