"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades 0 to ``GRADES``. The tables label rows toxic or not, so grades are a
choice: 0 for rows labelled not toxic; toxic training rows are ranked by how far toxic
words spread over the text, that is the share of its sentences that hold one, and
cut into equal thirds. The words that count for a row are found in the other half of the
training rows, and the spread is no feature. One weight vector w is shared across
ordered thresholds t1 < t2 < t3: P(grade >= k) = sigmoid(w . x - t_k). ``severity`` is the
expected grade, the sum of these. A text is ``toxic`` where P(grade >= 1) is at least one half.

Features are x_v = 1 + log(1 + 200 * share of words that are v) for those v of the
text that are in a vocabulary, where v is a word or the beginning of words
(``PREFIXES`` bytes), chosen by their log odds among toxic and other training rows
(``MIN_ODDS`` and ``MIN_DF`` rows or more, the ``VOCABULARY`` clearest). Learning uses a bounded
sample of about ``MAX_LABELLED`` labelled rows picked by a hash of doc_id, written aside
once; Spark counts their words, and only the vocabulary and features reach the driver.
Scoring is one pass over every whole text, without a shuffle.

Defined cases: null and empty texts have no features and get the severity of
that; rows with a null doc_id are not learnt from; of rows that repeat an id with other
texts the one with the smallest hash of its text is; without toxic and other rows to
learn from every severity is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, read_table, slices

GRADES = 3
MAX_LABELLED = 12_000
VOCABULARY = 2_000
MIN_DF = 5
#: Least log odds of a feature. What speaks against toxicity is left out: its sum grows with a text's length.
MIN_ODDS = 1.0
#: Log odds, and share of the toxic rows, from which on a word marks the sentences it stands in.
MARK_ODDS, MARK_SHARE = 2.0, 0.02
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)

# Lower case; everything outside letters, digits and bytes from 0x80 parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


_SENTENCE = re.compile(rb"[.!?\n]+")


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def forms(word: bytes) -> list[bytes]:
    """The word and its beginnings, marked by an asterisk, which no token holds: inflected words share them."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def sparse_features(text: str | None, vocabulary: dict[bytes, int]) -> tuple[list[int], list[float]]:
    words = tokens(text)
    count: Counter = Counter()
    for word, n in Counter(words).items():
        for form in forms(word):
            if form in vocabulary:
                count[form] += n
    known = sorted(count)
    return [vocabulary[f] for f in known], [1.0 + float(np.log1p(200 * count[f] / len(words))) for f in known]


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def thresholds(p: np.ndarray, width: int) -> np.ndarray:
    """Rising thresholds of parameters (weights, a first threshold, logs of the gaps)."""
    return np.cumsum(np.concatenate([[p[width]], np.exp(p[width + 1 :])]))


def negative_log_likelihood(p: np.ndarray, rows, cols, vals, grade: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Mean loss of the cumulative-link model, and its gradient."""
    n = len(grade)
    theta = thresholds(p, width)
    s = np.bincount(rows, weights=p[cols] * vals, minlength=n)
    # Category probabilities are differences of neighbouring cumulative links.
    cum = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - theta), np.zeros((n, 1))], axis=1)
    prob = np.maximum(cum[np.arange(n), grade] - cum[np.arange(n), grade + 1], 1e-9)
    slope = cum * (1 - cum)
    hi, lo = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
    ds = -(hi - lo) / prob / n
    d_theta = np.zeros(GRADES)
    np.add.at(d_theta, grade[grade >= 1] - 1, (hi / prob / n)[grade >= 1])
    np.add.at(d_theta, grade[grade < GRADES], -(lo / prob / n)[grade < GRADES])
    grad = np.zeros_like(p)
    grad[:width] = np.bincount(cols, weights=vals * ds[rows], minlength=width)
    grad[width] = d_theta.sum()
    for k in range(1, GRADES):
        grad[width + k] = np.exp(p[width + k]) * d_theta[k:].sum()
    return float(-np.log(prob).mean()), grad


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int,
                steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by full-batch Adam.

    Thresholds are a first one and positive gaps (exponentials), so their order
    holds at every step.
    """
    p = np.zeros(width + GRADES)
    p[width] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, grad = negative_log_likelihood(p, rows, cols, vals, grade, width)
        grad[:width] += decay * p[:width]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[width + 1 :] = np.clip(p[width + 1 :], -5, 3)
    return p[:width], thresholds(p, width)


def _forms_of(batches):
    """(form, half, rows, toxic): in how many rows of the batch, and toxic ones, each form stands."""
    for batch in slices(batches):
        count: Counter = Counter()
        ill: Counter = Counter()
        for half, y, text in zip(*(batch.column(c).to_pylist() for c in ("half", "y", "text"))):
            held = {(f, half) for w in set(tokens(text)) for f in forms(w)}
            count.update(held)
            if y:
                ill.update(held)
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([count[k] for k in keys], pa.int64()), pa.array([ill[k] for k in keys], pa.int64()),
            ],
            names=["form", "half", "n", "n1"],
        )


def _odds(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    return F.log((n1 + 0.5) / (all1 + 1)) - F.log((n0 + 0.5) / (all0 + 1))


def vocabulary_of(rows: DataFrame, sizes: dict) -> list:
    """The clearest forms of training rows (half, y, text), with the halves in which they mark sentences."""
    halves = rows.mapInArrow(_forms_of, "form binary, half int, n long, n1 long").groupBy("form").agg(
        *(F.sum(F.when(F.col("half") == h, F.col(c))).alias(f"{c}_{h}") for h in (0, 1) for c in ("n", "n1"))
    ).na.fill(0)
    n1 = sum(sizes[h, 1] for h in (0, 1))
    n0 = sum(sizes[h, 0] for h in (0, 1))
    df, ill = F.col("n_0") + F.col("n_1"), F.col("n1_0") + F.col("n1_1")
    odds = _odds(ill, df - ill, n1, n0)

    def marks(h: int) -> Column:
        own = _odds(F.col(f"n1_{h}"), F.col(f"n_{h}") - F.col(f"n1_{h}"), sizes[h, 1], sizes[h, 0])
        return (own >= MARK_ODDS) & (F.col(f"n1_{h}") >= MARK_SHARE * sizes[h, 1]) & (F.col(f"n1_{h}") > 0)

    good = halves.withColumn("df", df).withColumn("odds", odds).where((F.col("df") >= min(MIN_DF, max(2, n1 // 2))) & (F.col("odds") >= MIN_ODDS))
    clear = good.withColumn("weight", F.round(F.col("odds") * F.sqrt("df"), 9)).orderBy(F.desc("weight"), "form").limit(VOCABULARY)
    return clear.select("form", marks(0).alias("m0"), marks(1).alias("m1")).collect()  # VOCABULARY rows at most


def spread(text: str | None, marks: set[bytes]) -> float:
    """The share of a text's sentences that hold a marking form."""
    sentences = [t for t in map(bytes.split, _SENTENCE.split((text or "").encode("utf-8", "surrogatepass"))) if t]
    found = sum(any(not marks.isdisjoint(forms(w)) for w in b" ".join(t).translate(_FOLD).split()) for t in sentences)
    return found / max(1, len(sentences))


def grades(toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; 1 to GRADES for toxic ones, by equal parts of rising ``share``."""
    grade = np.zeros(len(toxic), dtype=np.int64)
    ill = np.flatnonzero(toxic)
    if len(ill):
        cuts = np.quantile(share[ill], np.arange(1, GRADES) / GRADES)
        grade[ill] = 1 + np.searchsorted(cuts, share[ill], side="right")
    return grade


def _training_features(vocabulary: dict[bytes, int], marks: list[set[bytes]]):
    def run(batches):
        for batch in slices(batches):
            texts, halves = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            found = [sparse_features(t, vocabulary) for t in texts]
            share = [spread(t, marks[1 - h]) if y else 0.0 for t, h, y in zip(texts, halves, batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("y"), pa.array(share, pa.float64()),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64())),
                ],
                names=["id", "y", "share", "cols", "vals"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    labels = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("_y"))
    labels = labels.where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    share = min(1.0, max_labelled / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(1 << 53)) < int(share * (1 << 53)))
    slim = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    # About max_labelled rows of two integers: bounded by that parameter.
    met = slim.join(F.broadcast(some), F.col("id") == F.col("_id")).groupBy("id").agg(
        F.max("_y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    )
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    rows = materialise(met.select("id", "y", half.alias("half"), "text"), "toxicity-rows")
    sizes = Counter({(r["half"], r["y"]): r["count"] for r in rows.groupBy("half", "y").count().collect()})
    if not all(sizes[0, y] + sizes[1, y] for y in (0, 1)):
        return {}
    words = vocabulary_of(rows, sizes)
    vocabulary = {bytes(r["form"]): i for i, r in enumerate(words)}
    marks = [{bytes(r["form"]) for r in words if r[f"m{h}"]} for h in (0, 1)]
    kinds = "id long, y int, share double, cols array<int>, vals array<double>"
    table = rows.mapInArrow(_training_features(vocabulary, marks), kinds).toArrow().sort_by("id")
    cols, vals = (table.column(c).combine_chunks() for c in ("cols", "vals"))
    each = np.diff(np.asarray(cols.offsets)) if len(table) else np.zeros(0, dtype=np.int64)
    y, rate = table.column("y").to_numpy(), table.column("share").to_numpy()
    w, theta = fit_ordinal(
        np.repeat(np.arange(len(each)), each), np.asarray(cols.flatten(), dtype=np.int64), np.asarray(vals.flatten()),
        grades(y == 1, rate), len(vocabulary),
    )
    return {"vocabulary": vocabulary, "w": w, "theta": theta}


def severities(model: dict, text: str | None) -> np.ndarray:
    """P(grade >= k) for k from 1 to GRADES."""
    if not model:
        return np.zeros(GRADES)
    cols, vals = sparse_features(text, model["vocabulary"])
    return _sigmoid(float(np.dot(model["w"][cols], vals)) - model["theta"])


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, severity, toxic and the cumulative probabilities of each document."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            p = np.array([severities(model, t) for t in batch.column("text").to_pylist()]).reshape(-1, GRADES)
            columns = [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0] >= 0.5)]
            columns += [pa.array(np.ascontiguousarray(p[:, k])) for k in range(GRADES)]
            names = ["doc_id", "severity", "toxic", *(f"p_grade_{k}" for k in range(1, GRADES + 1))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = ", ".join(f"p_grade_{k} double" for k in range(1, GRADES + 1))
    return slim.mapInArrow(run, f"doc_id long, severity double, toxic boolean, {parts}")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
