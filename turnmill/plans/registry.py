"""Registered queries and their oracle SQL (DuckDB).

Vectors of the supplied tables have nearest-neighbour cosines near 0.3, so the
queries scale the thresholds of the operators' defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs, text
from ..operators import chat, density, neighbours, sampling, stats, textvec
from ..operators.ordering import numbered
from ..sources.tables import conversation_turns, in_language, table
from . import audit, reports, studies

KS, TS = (1, 5, 10, 50), (0.2, 0.3, 0.4)
BUFFER = 69  # neighbours besides the row itself
PROBE = {"verbs": "the|der|les", "outputs": "ing|ung|que", "request": "and|und|et"}
BANDS = ((0.20, 0.25), (0.25, 0.30), (0.30, 0.40), (0.40, 1.01))
VALID = ("ACCEPTABLE", "BORDERLINE", "UNACCEPTABLE")

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- conversations -------------------------------------------------------------
_SPOKEN = """spoken AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations
  WHERE trim(text) <> '' AND role IN ('user', 'assistant'))"""
_QA = f"""{_SPOKEN},
lagged AS (SELECT *, lag(role) OVER w AS last_role, lag(text) OVER w AS prompt FROM spoken
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS k, prompt,
  text AS response FROM lagged WHERE role = 'assistant' AND last_role = 'user'),
tp AS (SELECT conv_id, k AS turn_idx, prompt AS anchor, lead(prompt) OVER w AS target, lead(response) OVER w AS target_response
  FROM qa WINDOW w AS (PARTITION BY conv_id ORDER BY k))"""


@query(f"""WITH {_SPOKEN},
u AS (SELECT conv_id, min(turn) AS first_turn FROM spoken WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id, min(turn) AS reply FROM spoken JOIN u USING (conv_id) WHERE role = 'assistant' AND turn > first_turn GROUP BY 1)
SELECT u.conv_id, p.text AS prompt, r.text AS response FROM u JOIN a USING (conv_id)
JOIN spoken p ON p.conv_id = u.conv_id AND p.turn = first_turn JOIN spoken r ON r.conv_id = u.conv_id AND r.turn = reply""")
def first_turn_records(spark, sf_dir):
    return chat.first_turn_records(table(spark, sf_dir, "conversations"))


@query(f"WITH {_QA} SELECT * FROM qa")
def qa_pairs(spark, sf_dir):
    return chat.qa_pairs(table(spark, sf_dir, "conversations"))


@query(f"WITH {_QA} SELECT conv_id, turn_idx, anchor, target FROM tp WHERE target IS NOT NULL")
def turn_pairs(spark, sf_dir):
    return chat.turn_pairs(table(spark, sf_dir, "conversations"))


@query(f"WITH {_QA} SELECT * FROM tp WHERE target IS NOT NULL")
def turn_pairs_with_reply(spark, sf_dir):
    return chat.turn_pairs(table(spark, sf_dir, "conversations"), with_reply=True)


@query(f"""WITH {_QA}, c AS (SELECT conv_id, count(*) AS n_pairs FROM qa GROUP BY 1 HAVING count(*) >= 2)
SELECT conv_id, n_pairs FROM c ORDER BY md5('42:' || conv_id), conv_id LIMIT 20""")
def conversation_sample(spark, sf_dir):
    pairs = chat.qa_pairs(table(spark, sf_dir, "conversations"), 2)
    return chat.sample(pairs.groupBy("conv_id").agg(F.count("*").alias("n_pairs")), "conv_id", 20)


@query(f"""WITH {_QA}, c AS (SELECT conv_id, array_agg(prompt ORDER BY k) AS u, array_agg(response ORDER BY k) AS a FROM qa GROUP BY 1 HAVING count(*) >= 2)
SELECT conv_id, array_to_string(u, '|') AS user_turns, array_to_string(a, '|') AS asst_turns FROM c ORDER BY md5('42:' || conv_id), conv_id LIMIT 15""")
def sampled_conversations(spark, sf_dir):
    """A seeded sample of nested conversations, their turns joined for comparison."""
    got = chat.sampled_conversations(table(spark, sf_dir, "conversations"), 15)
    return got.select("conv_id", *(F.array_join(c, "|").alias(c) for c in ("user_turns", "asst_turns")))


@query(f"""WITH raw AS (SELECT * FROM conversations WHERE conv_id % 3 = 0), {_SPOKEN.replace("FROM conversations", "FROM raw")},
u AS (SELECT conv_id, min(turn) AS first_turn FROM spoken WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id, min(turn) AS reply FROM spoken JOIN u USING (conv_id) WHERE role = 'assistant' AND turn > first_turn GROUP BY 1)
SELECT CASE WHEN u.conv_id % 2 = 0 THEN 'h' || u.conv_id ELSE md5(p.text) END AS conv_id, p.text AS prompt, r.text AS response FROM u JOIN a USING (conv_id)
JOIN spoken p ON p.conv_id = u.conv_id AND p.turn = first_turn JOIN spoken r ON r.conv_id = u.conv_id AND r.turn = reply
ORDER BY md5('42:' || CASE WHEN u.conv_id % 2 = 0 THEN 'h' || u.conv_id ELSE md5(p.text) END), 1 LIMIT 12""")
def sampled_records(spark, sf_dir):
    """A seeded sample of first-turn records of raw conversations: every third one is English, every other has an id."""
    turns = table(spark, sf_dir, "conversations")
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    raw = turns.groupBy("conv_id").agg(said.alias("conversation")).select(
        F.when(F.col("conv_id") % 3 == 0, "English").otherwise("Other").alias("language"), "conversation",
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("h"), "conv_id")).alias("conversation_hash"),
    )
    return chat.sampled_records(conversation_turns(raw), 12)


@query(f"WITH {_QA} SELECT conv_id, prompt, response FROM qa WHERE k = 0")
def first_answers(spark, sf_dir):
    return chat.first_answers(table(spark, sf_dir, "conversations"))


# -- documents -----------------------------------------------------------------
_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def document_sample(spark, sf_dir):
    return chat.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query(f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return chat.exact_dedup(docs, "text", "doc_id").select("doc_id", "lang", "source")


@query(f"SELECT count(*) AS before, count(DISTINCT {_NORM}) AS after, round(1 - count(DISTINCT {_NORM}) / count(*)::DOUBLE, 9) AS rate FROM documents")
def exact_dedup_stats(spark, sf_dir):
    return chat.dedup_stats(table(spark, sf_dir, "documents"), "text").withColumn("rate", F.round("rate", 9))


def _flag_sql(v, o, r):
    head = "substr(coalesce(text, ''), 1, 500)"
    m = lambda p: f"regexp_matches({head}, '(?i){p}')"
    return f"SELECT doc_id, {m(v)} AND {m(o)} AS strict, {m(v)} OR ({m(o)} AND {m(r)}) AS recall FROM documents"


@query(_flag_sql(text.VERBS, text.OUTPUTS, text.REQUEST))
def writing_filter_flags(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", text.is_writing_strict(t).alias("strict"), text.is_writing_recall(t).alias("recall"))


@query(_flag_sql(*PROBE.values()))
def probe_filter_flags(spark, sf_dir):
    """The filters with patterns that do occur in the documents."""
    d, t, (v, o, r) = table(spark, sf_dir, "documents"), F.col("text"), PROBE.values()
    return d.select("doc_id", text.is_writing_strict(t, v, o).alias("strict"), text.is_writing_recall(t, v, o, r).alias("recall"))


@query(rf"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i){text.CONTENT}') AS flag FROM documents")
def content_rule_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_content(F.col("text")).alias("flag"))


PROBE_CONTENT = "th[a-z]+ng|und|les"


@query(rf"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i){PROBE_CONTENT}') AS flag FROM documents")
def probe_content_flags(spark, sf_dir):
    """The content flag with a pattern that does occur in the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.has_content(F.col("text"), PROBE_CONTENT).alias("flag"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def english_documents(spark, sf_dir):
    return in_language(table(spark, sf_dir, "documents"), "en", "lang").select("doc_id", "source")


@query(rf"""WITH j AS (SELECT (['ACCEPTABLE', 'BORDERLINE', 'UNACCEPTABLE', 'UNKNOWN'])[CAST(doc_id % 4 AS INTEGER) + 1] AS judge_verdict,
  CASE WHEN regexp_matches(coalesce(text, ''), '(?i){PROBE_CONTENT}') OR regexp_matches(source, '(?i){PROBE_CONTENT}') THEN 'UNACCEPTABLE' ELSE 'ACCEPTABLE' END AS rule_verdict FROM documents)
SELECT judge_verdict, rule_verdict, count(*) AS n FROM j WHERE judge_verdict <> 'UNKNOWN' GROUP BY 1, 2""")
def content_rule_confusion(spark, sf_dir):
    """Made-up verdicts against those of the content rule, with a pattern that does occur."""
    names = F.array(*map(F.lit, (*VALID, "UNKNOWN")))
    rows = table(spark, sf_dir, "documents").select(
        F.get(names, (F.col("doc_id") % 4).cast("int")).alias("judge_verdict"), F.col("text").alias("prompt_b"), F.col("source").alias("response_a")
    )
    labelled = audit.by_content(rows, PROBE_CONTENT).where(F.col("judge_verdict").isin(*VALID))
    return labelled.groupBy("judge_verdict", "rule_verdict").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS raw,
  regexp_split_to_array(text, '\s+') AS cut FROM documents),
e AS (SELECT doc_id, unnest(raw) AS word, unnest(range(len(raw))) AS i FROM w)
SELECT w.doc_id, coalesce(string_agg(word, ' ' ORDER BY md5('42:' || w.doc_id || ':' || i), word), '') AS text
FROM w LEFT JOIN e USING (doc_id) GROUP BY w.doc_id""")
def scrambled_documents(spark, sf_dir):
    return chat.scrambled(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


# -- vectors -------------------------------------------------------------------
def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


_EDGES = f"""e AS (SELECT a.vec_id AS i, b.vec_id AS j, {_dot('a.embedding', 'b.embedding')} AS cos
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""
_PRIOR = f"""pm AS (SELECT e.vec_id AS i, coalesce(arg_max(j, (cos, -j)), -1) AS j, coalesce(max(cos), 0) AS cos FROM embeddings e
  LEFT JOIN (SELECT a.vec_id AS i, b.vec_id AS j, {_dot('a.embedding', 'b.embedding')} AS cos FROM embeddings a
    JOIN embeddings b ON b.vec_id < a.vec_id) s ON s.i = e.vec_id GROUP BY 1)"""
_LP = """lp0 AS (SELECT vec_id, label AS conv, embedding AS anchor, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS target FROM embeddings),
lp AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, conv, anchor, target FROM lp0 WHERE target IS NOT NULL)"""
_DENSE = f"""raw AS (SELECT i, j, rank FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS rank
  FROM (SELECT a.ord AS i, b.ord AS j, {_dot('a.anchor', 'b.anchor')} AS cos FROM lp a JOIN lp b ON a.ord <> b.ord)) WHERE rank <= {BUFFER})"""
_RANDOM = f"""n AS (SELECT count(*) AS n FROM lp),
raw AS (SELECT ord AS i, r AS rank, CAST(CAST('0x' || substr(md5('42:' || ord || ':' || r), 1, 12) AS BIGINT) % (SELECT n FROM n) AS BIGINT) AS j
  FROM lp, range(1, {BUFFER + 2}) t(r))"""
_CROSS = f"""cand AS (SELECT i, j, cos, row_number() OVER (PARTITION BY i ORDER BY raw_rank) AS rank FROM (
  SELECT raw.i, raw.j, raw.rank AS raw_rank, {_dot('a.target', 'b.target')} AS cos
  FROM raw JOIN lp a ON a.ord = raw.i JOIN lp b ON b.ord = raw.j WHERE a.conv <> b.conv AND raw.i <> raw.j))"""
_GRID = f"""g AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k), h AS (SELECT unnest([{', '.join(map(str, TS))}])::DOUBLE AS t)"""
_HITS = f"""{_GRID}, best AS (SELECT i, k, max(cos) AS m FROM cand JOIN g ON rank <= k GROUP BY 1, 2),
hits AS (SELECT CAST(g.k AS INTEGER) AS k, h.t, count(m) / (SELECT count(*) FROM lp)::DOUBLE AS rate FROM g CROSS JOIN h
  LEFT JOIN best ON best.k = g.k AND m >= h.t GROUP BY 1, 2)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"))


def _pairs(spark, sf_dir):
    return neighbours.label_pairs(table(spark, sf_dir, "embeddings"))


def _dense(pairs):
    return neighbours.edges(pairs.select("ord", F.col("anchor").alias("v")), k=BUFFER)


def _random(pairs):
    return neighbours.random_edges(pairs, BUFFER + 1)


@query(f"WITH {_EDGES} SELECT i, round(max(cos), 6) AS nn FROM e GROUP BY 1")
def nn_similarity(spark, sf_dir):
    return neighbours.edges(_vectors(spark, sf_dir), k=1).select("i", F.round("cos", 6).alias("nn"))


@query(f"""WITH {_EDGES}, m AS (SELECT i, max(cos) AS c FROM e GROUP BY 1)
SELECT t, round(avg((c >= t)::INT), 9) AS fraction FROM m, (SELECT unnest([0.2, 0.3, 0.4])::DOUBLE AS t) GROUP BY t""")
def nn_threshold_fractions(spark, sf_dir):
    near = neighbours.edges(_vectors(spark, sf_dir), k=1)
    row = near.agg(*(stats.fraction_above(F.col("cos"), t).alias(str(n)) for n, t in enumerate(TS)))
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.round(F.col(str(n)), 9).alias("fraction")) for n, t in enumerate(TS))))
    return row.select(cells.alias("c")).select("c.*")


@query(f"""WITH {_EDGES} SELECT i, CAST(rank AS INTEGER) AS rank, j, round(cos, 6) AS cos FROM
(SELECT *, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS rank FROM e) WHERE rank <= 15""")
def topk_neighbours(spark, sf_dir):
    return neighbours.edges(_vectors(spark, sf_dir), k=15).select("i", "rank", "j", F.round("cos", 6).alias("cos"))


@query(f"""WITH s AS (SELECT a.vec_id, {_dot('a.embedding', 'b.embedding')} AS pc, {_dot('b.embedding', 'c.embedding')} AS rc
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2),
r AS (SELECT pc, rc, rank() OVER (ORDER BY pc) + (count(*) OVER (PARTITION BY pc) - 1) / 2 AS rp,
  rank() OVER (ORDER BY rc) + (count(*) OVER (PARTITION BY rc) - 1) / 2 AS rr FROM s)
SELECT count(*) AS n_pairs, round(corr(rp, rr), 6) AS spearman, round(corr(pc, rc), 6) AS pearson FROM r""")
def prompt_response_correlation(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    at = lambda n: v.select((F.col("ord") - n).alias("ord"), F.col("v").alias(f"v{n}"))
    rows = at(0).join(at(1), "ord").join(at(2), "ord")
    rows = rows.select(neighbours.dot(F.col("v0"), F.col("v1")).alias("pc"), neighbours.dot(F.col("v1"), F.col("v2")).alias("rc"))
    got = stats.correlations(rows, "pc", "rc")
    return got.select("n_pairs", F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"))


@query(f"WITH {_LP}, {_DENSE}, {_CROSS}, {_HITS} SELECT k, t, round(rate, 6) AS rate FROM hits")
def hit_table_dense(spark, sf_dir):
    pairs = studies.fixed(_pairs(spark, sf_dir))
    return neighbours.hit_table(_dense(pairs), pairs, KS, TS).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_LP}, {_RANDOM}, {_CROSS}, {_HITS} SELECT k, t, round(rate, 6) AS rate FROM hits")
def hit_table_random(spark, sf_dir):
    pairs = studies.fixed(_pairs(spark, sf_dir))
    return neighbours.hit_table(_random(pairs), pairs, KS, TS).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_LP}, {_DENSE}, {_CROSS}, b AS (SELECT i, arg_max(j, (cos, -rank)) AS j, max(cos) AS cos FROM cand WHERE rank <= 25 GROUP BY 1)
SELECT ord AS i, coalesce(j, -1) AS j, round(coalesce(cos, 0), 6) AS cos FROM lp LEFT JOIN b ON b.i = ord""")
def best_cross_neighbour(spark, sf_dir):
    pairs = studies.fixed(_pairs(spark, sf_dir))
    return neighbours.best_cross_neighbour(_dense(pairs), pairs).withColumn("cos", F.round("cos", 6))


@query(f"""WITH {_LP}, d AS (WITH {_DENSE}, {_CROSS}, {_HITS} SELECT * FROM hits), r AS (WITH {_RANDOM}, {_CROSS}, {_HITS} SELECT * FROM hits)
SELECT k, t, round(d.rate, 6) AS hit, round(r.rate, 6) AS random, round(d.rate - r.rate, 6) AS lift
FROM d JOIN r USING (k, t) ORDER BY d.rate - r.rate DESC, k, t LIMIT 1""")
def best_lift(spark, sf_dir):
    pairs = studies.fixed(_pairs(spark, sf_dir))
    hit = neighbours.hit_table(_dense(pairs), pairs, KS, TS).withColumnRenamed("rate", "hit")
    rnd = neighbours.hit_table(_random(pairs), pairs, KS, TS).withColumnRenamed("rate", "random")
    met = hit.join(rnd, ["k", "t"], "left").na.fill(0.0, ["random"]).withColumn("lift", F.col("hit") - F.col("random"))
    top = met.orderBy(F.desc("lift"), "k", "t").limit(1)
    return top.select("k", "t", *(F.round(c, 6).alias(c) for c in ("hit", "random", "lift")))


@query(f"""WITH {_LP}, c AS (SELECT {_dot('anchor', 'target')} AS c FROM lp)
SELECT count(*) AS n, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.1), 6) AS p10,
round(quantile_cont(c, 0.9), 6) AS p90, round(avg((c >= 0.2)::INT), 6) AS ge_20, round(avg((c >= 0.3)::INT), 6) AS ge_30 FROM c""")
def consecutive_cosine_stats(spark, sf_dir):
    c = _pairs(spark, sf_dir).select(neighbours.dot(F.col("anchor"), F.col("target")).alias("c"))
    got = c.agg(*stats.distribution("c", (0.2, 0.3)))
    return got.select("n", *(F.round(x, 6).alias(x) for x in got.columns if x != "n"))


@query(f"WITH {_PRIOR} SELECT i, j, round(cos, 6) AS cos FROM pm")
def prior_matches(spark, sf_dir):
    return neighbours.prior_matches(_vectors(spark, sf_dir)).withColumn("cos", F.round("cos", 6))


@query(f"""WITH {_PRIOR} SELECT count_if(j <> -1) AS n_eligible, count_if(j <> -1 AND cos >= 0.3) AS n_recurring,
round(count_if(j <> -1 AND cos >= 0.3) / greatest(count_if(j <> -1), 1)::DOUBLE, 6) AS frac FROM pm""")
def recurring_fraction(spark, sf_dir):
    m = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1")
    got = m.agg(F.count("*").alias("n_eligible"), F.count_if(F.col("cos") >= 0.3).alias("n_recurring"))
    return got.withColumn("frac", F.round(F.col("n_recurring") / F.greatest("n_eligible", F.lit(1)), 6))


@query(f"WITH {_PRIOR} SELECT count(*) AS n, round(avg((cos >= 0.2)::INT), 6) AS frac FROM pm WHERE i BETWEEN 1 AND 5")
def cold_start(spark, sf_dir):
    m = neighbours.prior_matches(_vectors(spark, sf_dir)).where("i between 1 and 5")
    return m.agg(F.count("*").alias("n"), F.round(stats.fraction_above(F.col("cos"), 0.2), 6).alias("frac"))


@query(f"""WITH {_PRIOR} SELECT count(*) AS n, round(avg(cos), 6) AS mean, round(quantile_cont(cos, 0.5), 6) AS median,
round(quantile_cont(cos, 0.1), 6) AS p10, round(quantile_cont(cos, 0.9), 6) AS p90, round(avg((cos >= 0.2)::INT), 6) AS ge_20,
round(avg((cos >= 0.3)::INT), 6) AS ge_30, round(avg((cos >= 0.4)::INT), 6) AS ge_40 FROM pm WHERE j <> -1""")
def match_distribution(spark, sf_dir):
    got = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1").agg(*stats.distribution("cos", TS))
    return got.select("n", *(F.round(x, 6).alias(x) for x in got.columns if x != "n"))


@query(f"""WITH RECURSIVE near AS MATERIALIZED (SELECT b.vec_id AS j, list(a.vec_id) AS l FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE round({_dot('a.embedding', 'b.embedding')}, 12) >= 0.3 GROUP BY 1),
v AS MATERIALIZED (SELECT vec_id, coalesce(l, []) AS l, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings LEFT JOIN near ON j = vec_id),
walk(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT v.n, CASE WHEN list_has_any(kept, l) THEN kept ELSE list_append(kept, vec_id) END FROM walk JOIN v ON v.n = walk.n + 1)
SELECT unnest(kept) AS ord FROM walk WHERE n = (SELECT max(n) FROM v)""")
def near_dedup_embeddings(spark, sf_dir):
    """Kept rows of the ordered greedy walk at cosine 0.3."""
    return neighbours.greedy_dedup(_vectors(spark, sf_dir), 0.3)


@query(f"""WITH {_PRIOR}, b AS (SELECT i, CASE {' '.join(f"WHEN cos >= {lo} AND cos < {hi} THEN '{lo:.2f}-{hi:.2f}'" for lo, hi in BANDS)} END AS band FROM pm WHERE j <> -1)
SELECT i, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || i), i) AS n FROM b WHERE band IS NOT NULL) WHERE n <= 10""")
def banded_sample(spark, sf_dir):
    m = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1").withColumn("band", stats.banded(F.col("cos"), BANDS))
    return stats.per_band(m, "band", F.struct(text.md5_order(42, F.col("i")), F.col("i")), 10).select("i", "band")


SERVE = ((0.15, 0.25), (0.25, 0.30), (0.30, 1.01))
_SERVE = f"CASE {' '.join(f"WHEN cos >= {lo} AND cos < {hi} THEN '{lo:.2f}-{hi:.2f}'" for lo, hi in SERVE)} END"


@query(f"""WITH {_LP}, {_DENSE}, {_CROSS}, c AS (SELECT i, arg_max(j, (cos, -rank)) AS j, max(cos) AS cos FROM cand WHERE rank <= 25 GROUP BY 1),
b AS (SELECT i, j, {_SERVE} AS band FROM c)
SELECT i, j, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || i), i) AS n FROM b WHERE band IS NOT NULL) WHERE n <= 7""")
def serve_sample(spark, sf_dir):
    """Best neighbours in other conversations by serve band, as study C judges them, with bands scaled to these vectors."""
    pairs = studies.fixed(_pairs(spark, sf_dir))
    found = neighbours.best_cross_neighbour(_dense(pairs), pairs).where("j <> -1")
    return studies.serve_sample(found, SERVE, 7, 42).select("i", "j", "band")


@query(f"""WITH {_PRIOR} SELECT round(cos, 6) AS cos, i, j, 'prompt ' || i AS prompt, 'prompt ' || j AS prior FROM pm WHERE j <> -1 AND cos >= 0.25
ORDER BY pm.cos DESC, i LIMIT 20""")
def recurring_pairs(spark, sf_dir):
    """The twenty nearest prior matches with their prompts."""
    rows = _vectors(spark, sf_dir).select("ord", F.concat(F.lit("prompt "), "ord").alias("prompt"))
    matches = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1")
    return studies.recurring_pairs(matches, rows, 0.25).withColumn("cos", F.round("cos", 6))


@query(f"""WITH {_PRIOR}, g AS (SELECT unnest([0.7, 0.8, 0.9, 0.95])::DOUBLE AS t_pred), h AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS t)
SELECT 1 AS k, t, round(avg((cos >= t)::INT), 9) AS hit_rate FROM pm, h WHERE j <> -1 GROUP BY t""")
def one_guess_hits(spark, sf_dir):
    """Hit rates of one guess, as study D has them, at thresholds scaled to these vectors."""
    m = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1")
    got = studies.one_guess_hits(spark, m, (0.1, 0.2, 0.3, 0.4))
    return got.select("k", F.col("t_pred").alias("t"), F.round("hit_rate", 9).alias("hit_rate"))


@query(f"""WITH {_EDGES}, m AS (SELECT max(round(cos, 12)) AS c FROM e GROUP BY i), b AS (SELECT least(49, greatest(0, CAST(floor(c * 50) AS INTEGER))) AS bin FROM m)
SELECT CAST(r.bin AS INTEGER) AS bin, round(r.bin / 50.0, 6) AS lo, count(b.bin) AS n FROM range(50) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin""")
def nn_histogram(spark, sf_dir):
    near = neighbours.edges(_vectors(spark, sf_dir), k=1)
    return reports.histogram(near, "cos").withColumn("lo", F.round("lo", 6))


# -- clusters (labels as clusters) -----------------------------------------------
_CL = "c AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cl FROM embeddings)"
_SIZES = """s AS (SELECT cl, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) AS pos FROM c WHERE cl <> -1 GROUP BY 1)"""


def _labels(spark, sf_dir):
    cl = F.when(F.col("label") == 0, -1).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", cl.alias("cl"))


@query(f"WITH {_CL}, {_SIZES} SELECT CAST(cl AS INTEGER) AS cluster, size, CAST(pos AS INTEGER) AS pos FROM s")
def cluster_sizes(spark, sf_dir):
    return stats.cluster_sizes(_labels(spark, sf_dir), "cl", "vec_id")


@query(f"""WITH {_CL}, {_SIZES} SELECT round((SELECT sum(size) FROM s WHERE pos <= 5) / (SELECT count(*) FROM c)::DOUBLE, 9) AS coverage,
round((SELECT avg((cl = -1)::INT) FROM c), 9) AS noise, (SELECT count(*) FROM s) AS n_clusters""")
def cluster_coverage(spark, sf_dir):
    got = stats.coverage(_labels(spark, sf_dir), "cl", "vec_id", 5)
    return got.select(F.round("coverage", 9).alias("coverage"), F.round("noise", 9).alias("noise"), "n_clusters")


@query(f"""WITH {_CL}, {_SIZES}, m AS (SELECT *, row_number() OVER (PARTITION BY cl ORDER BY vec_id) AS nth FROM c)
SELECT CAST(cl AS INTEGER) AS cluster, vec_id, size, CAST(pos AS INTEGER) AS pos FROM m JOIN s USING (cl) WHERE nth <= 8 AND pos <= 5""")
def cluster_members(spark, sf_dir):
    return stats.cluster_members(_labels(spark, sf_dir), "cl", "vec_id", 5, 8).select("cluster", "vec_id", "size", "pos")


@query(f"""WITH {_CL}, {_SIZES}, m AS (SELECT *, row_number() OVER (PARTITION BY cl ORDER BY vec_id) AS nth FROM c)
SELECT CAST(cl AS INTEGER) AS cluster, any_value(size) AS size, CAST(any_value(pos) AS INTEGER) AS pos, string_agg(substr(repeat('text ' || vec_id || ' ', 60), 1, 300), '|' ORDER BY nth) AS examples
FROM m JOIN s USING (cl) WHERE nth <= 5 AND pos <= 10 GROUP BY cl""")
def cluster_examples(spark, sf_dir):
    """The largest clusters with the first 300 characters of their first five texts."""
    labels = _labels(spark, sf_dir)
    rows = labels.select("vec_id", F.repeat(F.concat(F.lit("text "), "vec_id", F.lit(" ")), 60).alias("t"))
    got = stats.cluster_examples(labels, rows, "cl", "vec_id", "t")
    return got.select("cluster", "size", "pos", F.array_join("examples", "|").alias("examples"))


# -- costs, rubrics ----------------------------------------------------------------
def _values(name, values):
    return f"(SELECT unnest([{', '.join(map(str, values))}])::DOUBLE AS {name})"


@query(f"""SELECT c_small, p_small, round(CASE WHEN 1 - {costs.S_TARGET} - {costs.C_CACHE} <= 0 THEN 1.0
  ELSE greatest(0, 1 - (1 - {costs.S_TARGET} - {costs.C_CACHE})::DOUBLE / (p_small * c_small + (1 - p_small))) END, 4) AS min_p_cache,
1 - {costs.S_TARGET} - {costs.C_CACHE} > 0 AS feasible
FROM {_values('c_small', costs.SENSITIVITY['c_small'])}, {_values('p_small', costs.SENSITIVITY['p_small'])}""")
def cost_sensitivity(spark, sf_dir):
    return costs.sensitivity(spark)


@query(f"""SELECT c_small, c_cache, s_target, round(CASE WHEN 1 - s_target - c_cache <= 0 THEN 1.0
  ELSE greatest(0, 1 - (1 - s_target - c_cache) / ({costs.P_SMALL}::DOUBLE * c_small + (1 - {costs.P_SMALL}::DOUBLE))) END, 4) AS threshold
FROM {_values('c_small', (0.05, 0.2, 0.4))}, {_values('c_cache', (0.002, 0.1))}, {_values('s_target', (0.3, 0.5, 0.95))}""")
def derived_thresholds(spark, sf_dir):
    """The thresholds that prices decide, over a grid of prices."""
    cells = costs.grid(spark, c_small=(0.05, 0.2, 0.4), c_cache=(0.002, 0.1), s_target=(0.3, 0.5, 0.95))
    solved = costs.min_p_cache(F.col("s_target"), F.lit(costs.P_SMALL), F.col("c_cache"), F.col("c_small"))
    return cells.select("c_small", "c_cache", "s_target", F.round(solved["min_p_cache"], 4).alias("threshold"))


_PARETO = f"""hq AS (SELECT k, t_pred, t_serve, c_speculate, CASE WHEN k IN (1, 5, 10) AND t_pred < 0.95 THEN 1.0 / (k * t_pred + 0.5) ELSE 0.0 END AS hit_rate,
  t_serve AS quality FROM {_values('k', costs.K_GRID)}, {_values('t_pred', costs.T_PRED)}, {_values('t_serve', costs.T_SERVE)}, {_values('c_speculate', costs.C_SPECULATE)}),
cells AS (SELECT CAST(k AS INTEGER) AS k, t_pred, t_serve, c_speculate, hit_rate, quality, hit_rate * quality AS effective,
  hit_rate * quality * {costs.LATENCY_VALUE}::DOUBLE - k * c_speculate AS roi FROM hq)"""
_CELL = "k, t_pred, t_serve, c_speculate, round(hit_rate, 6) AS hit_rate, round(quality, 6) AS quality, round(effective, 6) AS effective, round(roi, 6) AS roi, roi > 0 AS feasible"


def _cells(spark):
    """Pareto cells of made-up hit rates 1 / (k t + 0.5) at k 1, 5, 10 and quality equal to t_serve."""
    hits = costs.grid(spark, k=(1, 5, 10), t_pred=costs.T_PRED[:3])
    hits = hits.withColumn("hit_rate", 1.0 / (F.col("k") * F.col("t_pred") + 0.5))
    quality = costs.grid(spark, t_serve=costs.T_SERVE).withColumn("quality", F.col("t_serve"))
    return costs.pareto(spark, hits, quality)


def _rounded(cells):
    return cells.select("k", "t_pred", "t_serve", "c_speculate", *(F.round(c, 6).alias(c) for c in ("hit_rate", "quality", "effective", "roi")), "feasible")


@query(f"WITH {_PARETO} SELECT {_CELL} FROM cells")
def pareto_cells(spark, sf_dir):
    return _rounded(_cells(spark))


@query(f"WITH {_PARETO} SELECT {_CELL} FROM cells WHERE cells.roi > 0 ORDER BY cells.roi DESC, k, t_pred, t_serve, c_speculate LIMIT 1")
def pareto_best(spark, sf_dir):
    return _rounded(costs.best_cell(_cells(spark)))


def _bits(n, prefix):
    return [f"(id >> {i}) & 1 = 1 AS {prefix}{i + 1}" for i in range(n)]


@query(f"""WITH b AS (SELECT {', '.join(_bits(5, 'h'))} FROM range(32) t(id))
SELECT *, CASE WHEN NOT h5 THEN 'Abandon' WHEN h1 AND h2 AND h3 AND h4 THEN 'Strong positive' WHEN h1 AND h2 AND h4 THEN 'Weak positive'
WHEN NOT h1 AND h2 AND h4 THEN 'Domain mismatch' WHEN NOT (h1 OR h2 OR h3 OR h4) THEN 'Marginal' ELSE 'Anomalous' END AS outcome FROM b""")
def rubric_a(spark, sf_dir):
    b = spark.range(32).select(*((F.shiftright("id", i) % 2 == 1).alias(f"h{i + 1}") for i in range(5)))
    return b.withColumn("outcome", costs.rubric_a(*(F.col(f"h{i}") for i in range(1, 6))))


def _rubric(spark, rule):
    b = spark.range(16).select(*((F.shiftright("id", i) % 2 == 1).alias(f"hp{i + 1}") for i in range(4)))
    return b.withColumn("outcome", rule(*(F.col(f"hp{i}") for i in range(1, 5))))


_B16 = f"WITH b AS (SELECT {', '.join(_bits(4, 'hp'))} FROM range(16) t(id)) SELECT *, CASE WHEN NOT hp1 OR NOT hp2 THEN 'Abandon'"


@query(f"{_B16} WHEN hp4 THEN 'Commit to prefetch project' WHEN hp3 THEN 'Re-scope to within-session only' ELSE 'Re-scope to narrower domain' END AS outcome FROM b")
def rubric_c(spark, sf_dir):
    return _rubric(spark, costs.rubric_c)


@query(f"{_B16} WHEN NOT hp4 AND hp3 THEN 'Commit power-user-only' WHEN NOT hp4 THEN 'Re-scope to KV-warm-only' WHEN NOT hp3 THEN 'Commit, power-user-only' ELSE 'Commit to project' END AS outcome FROM b")
def rubric_d(spark, sf_dir):
    return _rubric(spark, costs.rubric_d)


# -- verdicts (a rule stands in for the judge) ----------------------------------------
_V = "['ACCEPTABLE', 'BORDERLINE', 'UNACCEPTABLE', 'UNKNOWN']"
_JUDGED = f"""judged AS (SELECT i, cos AS serve_cosine, ({_V})[i % 3 + 1] AS verdict, ({_V})[i % 4 + 1] AS other FROM pm WHERE j <> -1),
scored AS (SELECT *, CASE verdict WHEN 'ACCEPTABLE' THEN 1.0 WHEN 'BORDERLINE' THEN 0.5 ELSE 0.0 END AS score FROM judged)"""


def _judged(spark, sf_dir):
    """Prior matches with made-up verdicts that turn with the row number."""
    names = F.array(*map(F.lit, (*VALID, "UNKNOWN")))
    pick = lambda n: F.get(names, (F.col("i") % n).cast("int"))
    m = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1")
    m = m.select("i", F.col("cos").alias("serve_cosine"), pick(3).alias("verdict"), pick(4).alias("other"))
    return m.withColumn("score", text.verdict_score(F.col("verdict")))


@query(f"""WITH {_PRIOR}, {_JUDGED} SELECT t AS t_serve, count(score) AS n, round(coalesce(avg(score), 0), 6) AS quality
FROM (SELECT unnest([0.2, 0.3, 0.4, 0.9])::DOUBLE AS t) LEFT JOIN scored ON serve_cosine >= t GROUP BY 1""")
def quality_by_threshold(spark, sf_dir):
    got = stats.quality_by_threshold(_judged(spark, sf_dir), (0.2, 0.3, 0.4, 0.9))
    return got.withColumn("quality", F.round("quality", 6))


@query(f"""WITH {_PRIOR}, {_JUDGED} SELECT CASE {' '.join(f"WHEN serve_cosine >= {lo} AND serve_cosine < {hi} THEN '{lo:.2f}-{hi:.2f}'" for lo, hi in BANDS)} END AS band,
count(*) AS n, round(avg(score), 6) AS rate FROM scored GROUP BY 1""")
def band_acceptability(spark, sf_dir):
    judged = _judged(spark, sf_dir).withColumn("band", stats.banded(F.col("serve_cosine"), BANDS))
    return judged.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("rate"))


@query(f"WITH {_PRIOR}, {_JUDGED} SELECT verdict, other, count(*) AS n FROM scored WHERE other <> 'UNKNOWN' GROUP BY 1, 2")
def agreement_confusion(spark, sf_dir):
    judged = _judged(spark, sf_dir).where(F.col("verdict").isin(*VALID) & F.col("other").isin(*VALID))
    return judged.groupBy("verdict", "other").agg(F.count("*").alias("n"))


@query(f"""WITH {_PRIOR}, {_JUDGED} SELECT count(*) AS n_auditable, count_if(verdict = other) AS agreements,
round(avg((verdict = other)::INT), 6) AS rate FROM scored WHERE other <> 'UNKNOWN'""")
def agreement_rate(spark, sf_dir):
    return stats.agreement(_judged(spark, sf_dir), "verdict", "other", VALID).withColumn("rate", F.round("rate", 6))


# -- text vectors, study B ---------------------------------------------------------------
def _numbered(spark, sf_dir):
    pairs = chat.turn_pairs(table(spark, sf_dir, "conversations"))
    ids = numbered(pairs.select("conv_id", "turn_idx"), "conv_id", "turn_idx")
    return pairs.join(ids, ["conv_id", "turn_idx"])


_TERMS = r"""tp1 AS (SELECT row_number() OVER (ORDER BY conv_id, turn_idx) - 1 AS ord, anchor FROM tp WHERE target IS NOT NULL),
ws AS (SELECT ord, regexp_extract_all(lower(anchor), '[\p{L}\p{N}_]{2,}') AS ws FROM tp1),
grams AS (SELECT ord, unnest(ws) AS term FROM ws UNION ALL
  SELECT ord, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM ws),
tf AS (SELECT ord, term, count(*) AS tf FROM grams GROUP BY 1, 2),
voc AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 20000),
wt AS (SELECT ord, term, tf * (ln((1.0 + (SELECT count(*) FROM tp1)) / (1.0 + df)) + 1) AS w FROM tf JOIN voc USING (term))"""


@query(f"WITH {_QA}, {_TERMS} SELECT ord, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY ord)), 6) AS w FROM wt")
def tfidf_weights(spark, sf_dir):
    rows = _numbered(spark, sf_dir).select("ord", F.col("anchor").alias("text"))
    return textvec.tfidf(rows).select("ord", "term", F.round("w", 6).alias("w"))


_SIDES = rf"""tp2 AS (SELECT row_number() OVER (ORDER BY conv_id, turn_idx) - 1 AS ord, conv_id AS conv, anchor, target FROM tp WHERE target IS NOT NULL),
tok AS (SELECT 'a' AS side, ord, unnest(regexp_extract_all(lower(anchor), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t FROM tp2 UNION ALL
  SELECT 't', ord, unnest(regexp_extract_all(lower(target), '[\p{{L}}\p{{N}}_]{{2,}}')) FROM tp2),
cnt AS (SELECT side, ord, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {textvec.DIMS} AS b, count(*)::DOUBLE AS c FROM tok GROUP BY 1, 2, 3),
vec AS (SELECT side, ord, b, c / sqrt(sum(c * c) OVER (PARTITION BY side, ord)) AS x FROM cnt),
wn AS (SELECT ord, term, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS x FROM wt),
every AS (SELECT a.ord AS i, b.ord AS j FROM tp2 a JOIN tp2 b ON a.ord <> b.ord),
dc AS (SELECT a.ord AS i, b.ord AS j, sum(a.x * b.x) AS s FROM vec a JOIN vec b ON a.b = b.b AND a.side = 'a' AND b.side = 'a' GROUP BY 1, 2),
fc AS (SELECT a.ord AS i, b.ord AS j, sum(a.x * b.x) AS s FROM wn a JOIN wn b ON a.term = b.term GROUP BY 1, 2),
gc AS (SELECT a.ord AS i, b.ord AS j, sum(a.x * b.x) AS s FROM vec a JOIN vec b ON a.b = b.b AND a.side = 't' AND b.side = 't' GROUP BY 1, 2),
near AS (SELECT 'hashed' AS retriever, i, j, round(coalesce(s, 0), 12) AS cos FROM every LEFT JOIN dc USING (i, j) UNION ALL
  SELECT 'tfidf', i, j, round(coalesce(s, 0), 12) FROM every LEFT JOIN fc USING (i, j)),
raw AS (SELECT retriever, i, j, rank FROM (SELECT *, row_number() OVER (PARTITION BY retriever, i ORDER BY cos DESC, j) AS rank FROM near) WHERE rank <= {BUFFER} UNION ALL
  SELECT 'random', ord, CAST(CAST('0x' || substr(md5('42:' || ord || ':' || r), 1, 12) AS BIGINT) % (SELECT count(*) FROM tp2) AS BIGINT), r FROM tp2, range(1, {BUFFER + 2}) t(r)),
cand AS (SELECT retriever, raw.i, round(coalesce(gc.s, 0), 12) AS cos, row_number() OVER (PARTITION BY retriever, raw.i ORDER BY raw.rank) AS rank
  FROM raw JOIN tp2 a ON a.ord = raw.i JOIN tp2 b ON b.ord = raw.j LEFT JOIN gc ON gc.i = raw.i AND gc.j = raw.j WHERE a.conv <> b.conv AND raw.i <> raw.j),
g AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k), h AS (SELECT unnest([0.7, 0.8, 0.9])::DOUBLE AS t), r AS (SELECT unnest(['hashed', 'tfidf', 'random']) AS retriever),
best AS (SELECT retriever, i, k, max(cos) AS m FROM cand JOIN g ON rank <= k GROUP BY 1, 2, 3)"""


@query(f"""WITH {_QA}, {_TERMS}, {_SIDES} SELECT r.retriever, CAST(g.k AS INTEGER) AS k, h.t, round(count(m) / (SELECT count(*) FROM tp2)::DOUBLE, 9) AS rate
FROM r CROSS JOIN g CROSS JOIN h LEFT JOIN best ON best.retriever = r.retriever AND best.k = g.k AND m >= h.t GROUP BY 1, 2, 3""")
def study_b_hit_tables(spark, sf_dir):
    """Hit rates of turn pairs for the hashed, TF-IDF and random retrievers, 12 rows each."""
    got = studies.retrieval(table(spark, sf_dir, "conversations"), textvec.hashed_vectors, studies.Grids(), 42)
    out = None
    for name, arm in (("hashed", "dense"), ("tfidf", "tfidf"), ("random", "random")):
        hits = got.tables[arm].select(F.lit(name).alias("retriever"), "k", "t", F.round("rate", 9).alias("rate"))
        out = hits if out is None else out.unionByName(hits)
    return out


# -- pair and item samples, density clusters ---------------------------------------------
_DRAW = "CAST(CAST('0x' || substr(md5('42:' || d || ':{0}'), 1, 12) AS BIGINT) % (SELECT count(*) FROM embeddings) AS BIGINT)"


@query(f"""WITH {_EDGES}, near AS (SELECT 'near:' || i || ':' || j AS key, i, j, cos FROM
  (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS rank FROM e) WHERE rank <= 14),
draws AS (SELECT 'draw:' || d AS key, {_DRAW.format('i')} AS i, {_DRAW.format('j')} AS j FROM range(1200) t(d)),
pool AS (SELECT * FROM near UNION ALL SELECT key, draws.i, draws.j, cos FROM draws JOIN e ON e.i = draws.i AND e.j = draws.j),
b AS (SELECT least(9, greatest(0, CAST(trunc(cos * 10) AS INTEGER))) AS bin, * FROM pool)
SELECT bin, i, j, round(cos, 6) AS cos FROM
(SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || key), key) AS n FROM b) WHERE n <= 20""")
def stratified_pair_bins(spark, sf_dir):
    return sampling.stratified_pairs(_vectors(spark, sf_dir), 200).withColumn("cos", F.round("cos", 6))


_BAND = f"CASE {' '.join(f"WHEN cos >= {lo} AND cos < {hi} THEN '{lo:.2f}-{hi:.2f}'" for lo, hi in BANDS)} END"


@query(f"""WITH {_EDGES}, near AS (SELECT *, {_BAND} AS band FROM
  (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS rank FROM e) WHERE rank <= 19),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY i, rank) AS n FROM near WHERE band IS NOT NULL) WHERE n <= 30),
cut AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || i || ':' || j), i, j) AS m FROM pool)
SELECT band, i, j, 'prompt ' || j AS prompt_b, 'reply ' || i AS response_a FROM cut WHERE m <= 10""")
def banded_items(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    records = v.select("ord", F.concat(F.lit("prompt "), "ord").alias("prompt"), F.concat(F.lit("reply "), "ord").alias("response"))
    return sampling.banded_items(v, records, BANDS, 10)


@query(f"""WITH {_PRIOR}, calls AS (SELECT i, {_BAND} AS band FROM pm WHERE j <> -1 AND i % 5 <> 0),
b AS (SELECT *, coalesce(band, 'unknown') AS g FROM calls), p AS (SELECT greatest(1, 40 // count(DISTINCT g)) AS per FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || i), i) AS n FROM b)
SELECT i, band FROM s, p WHERE n <= per ORDER BY md5('42:cut:' || i), i LIMIT 40""")
def audit_sample(spark, sf_dir):
    m = neighbours.prior_matches(_vectors(spark, sf_dir)).where("j <> -1")
    calls = m.select("i", stats.banded(F.col("cos"), BANDS).alias("band"), F.when(F.col("i") % 5 == 0, "control").alias("arm"))
    return sampling.audit_sample(calls, "i", 40).select("i", "band")


@query()
def density_clusters(spark, sf_dir):
    """Clusters of the first ten principal components; tests plant groups and find them again."""
    return density.density_clusters(density.reduce(_vectors(spark, sf_dir), 10), ((20, 5),))


@query()
def cluster_sweep(spark, sf_dir):
    """Coverage and noise of the reference grid's 36 cells."""
    cells = [(m, s) for m in (15, 20, 30, 50) for s in (3, 5, 10)]
    return density.sweep_cells(_vectors(spark, sf_dir), (5, 10, 20), cells)
