"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are rows labelled 1; unlabelled text is a sample of all documents,
whatever their label, and rows labelled 0 are never looked at. A linear model g over
dense text statistics minimises

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss (Kiryo et al. 2017); where the second term turns negative,
its gradient step is reversed. ``score`` is sigmoid(g).

The class prior comes from positives and unlabelled text alone, by the best bin
(Garg et al. 2021): a classifier of positives against unlabelled text, fitted to one
half of the positives, ranks the other half and **all** documents; of all thresholds c, the
one with the least upper bound of share(documents >= c) / share(positives >= c) gives it.

One pass turns whole texts into ``N_FEATURES`` numbers each, written once (a tenth of the
texts' size); means, deviations, the ranking of all documents and the scores read those.
The weights alone are fitted to bounded samples: about ``MAX_POSITIVE`` positives
and ``MAX_UNLABELLED`` ids, picked by a hash of doc_id (and one row of each id). What
reaches the driver are their features. Labels are read only of rows whose
crc32(doc_id as text) mod 5 is not 0.

Defined cases: null and empty texts get the score of a text without words; rows
with a null doc_id are not held out, not learnt from, but counted and scored; repeated rows
repeat; without labelled positives or unlabelled text every score is 0.5; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, read_table, slices

FOLDS = 5
THRESHOLD = 0.3
MAX_POSITIVE = 12_000
MAX_UNLABELLED = 12_000
#: Thresholds that the prior is sought at, and the risk that its bound is off.
THRESHOLDS = 400
DELTA = 0.1

_KINDS = np.zeros(256, dtype=np.int64)
for _c in range(256):
    _ch = chr(_c)
    _KINDS[_c] = (
        0 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit()
        else 4 if _ch in " \t\n\x0b\f\r" else 5 if _ch in ".,;:'\"?!-()" else 6
    )
N_KINDS = 7
#: ASCII marks that get a feature of their own.
_MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"]
N_FEATURES = N_KINDS + len(_MARKS) + 12


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text; linear in its length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = max(1, len(data))
    kinds = np.bincount(_KINDS, weights=count, minlength=N_KINDS) / size
    marks = count[_MARKS] / size
    words = data.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1, dtype=np.int64)
    m = max(1, n)
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    gap = sum(map(bytes.__eq__, words, words[2:])) / m
    distinct = len(set(words))
    lines = data.split(b"\n")
    rest = np.array([
        np.log1p(n) / 10, lengths.mean() / 10, min(lengths.std() / 10, 5.0), min(lengths.max() / 100, 5.0),
        again, gap, distinct / m, np.log1p(distinct) / np.log1p(m) if n else 0.0,
        (lengths == 1).sum() / m, (lengths <= 3).sum() / m, len(lines) / m, len(set(lines)) / len(lines),
    ])
    return np.concatenate([np.sqrt(kinds), np.sqrt(marks), rest])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sampled(doc_id, share: float, salt: str):
    """True for about ``share`` of the ids, the same ones in every run."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 53)) < int(min(1.0, share) * (1 << 53))


def _array(x: np.ndarray) -> pa.ListArray:
    places = pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32())
    return pa.ListArray.from_arrays(places, pa.array(x.reshape(-1), pa.float32()))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, N_FEATURES)


def featured(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float32).reshape(-1, N_FEATURES)


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every document, written once."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            x = _array(featured(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])

    return materialise(slim.mapInArrow(run, "doc_id long, x array<float>"), "quality-features")


def _picked(rows: DataFrame) -> np.ndarray:
    """Features of one row of each id, in order of ids."""
    table = rows.groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    return _matrix(table.column("x"))


def training_rows(rows: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int):
    """Features of sampled positives and of sampled unlabelled text."""
    labels = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("_q"))
    good = labels.where("_q = 1 and _id is not null").where(~held_out(F.col("_id"))).select("_id").distinct()
    # Ids of about max_positive rows: bounded by that parameter.
    some = good.where(_sampled(F.col("_id"), max_positive / max(1, good.count()), "positive"))
    positive = _picked(rows.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left_semi"))
    share = max_unlabelled / max(1, rows.count())
    return positive, _picked(rows.where(F.col("doc_id").isNotNull() & _sampled(F.col("doc_id"), share, "unlabelled")))


def _sums(batches):
    for batch in batches:
        x = _matrix(batch.column("x"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(N_FEATURES), pa.int32()), pa.array(np.full(N_FEATURES, len(x)), pa.int64()),
                pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0)),
            ],
            names=["i", "n", "s", "q"],
        )


def scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows; rounded, so that the order of additions does not show."""
    sums = rows.select("x").mapInArrow(_sums, "i int, n long, s double, q double")
    got = sums.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).orderBy("i").collect()  # one row a feature
    mean = np.array([r["s"] / r["n"] for r in got])
    std = np.sqrt(np.maximum(np.array([r["q"] / r["n"] for r in got]) - mean * mean, 0.0))
    mean, std = np.round(mean, 6), np.round(std, 6)
    return mean, np.where(std < 1e-4, 1.0, std)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6, np.ones((len(z), 1))], axis=1)


def risk_gradient(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the PU risk; reversed for its second term alone where that is negative."""
    gp, gu = positive @ w, unlabelled @ w
    d_pos = -(_sigmoid(-gp)) @ positive / len(positive)  # of E_p[l(g)]
    d_pos_neg = _sigmoid(gp) @ positive / len(positive)  # of E_p[l(-g)]
    d_unl = _sigmoid(gu) @ unlabelled / len(unlabelled)  # of E_u[l(-g)]
    if np.logaddexp(0, gu).mean() >= prior * np.logaddexp(0, gp).mean():
        return prior * d_pos + d_unl - prior * d_pos_neg
    return prior * d_pos_neg - d_unl


def _descend(gradient, width: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Full-batch Adam from zero."""
    w = np.zeros(width)
    m, v = w.copy(), w.copy()
    for t in range(1, steps + 1):
        grad = gradient(w) + decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05,
             decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative PU risk."""
    return _descend(lambda w: risk_gradient(positive, unlabelled, w, prior), positive.shape[1], steps, rate, decay)


def fit_ranking(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier of positives against unlabelled text, both of equal weight."""

    def gradient(w):
        return _sigmoid(unlabelled @ w) @ unlabelled / len(unlabelled) - _sigmoid(-(positive @ w)) @ positive / len(positive)

    return _descend(gradient, positive.shape[1], steps, rate, decay)


def best_bin(above_u: np.ndarray, n_u: int, above_p: np.ndarray, n_p: int, delta: float = DELTA) -> float:
    """The class prior, from the numbers of unlabelled and of positive rows at or above each threshold."""
    share_u, share_p = above_u / n_u, above_p / n_p
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    bound = (share_u + slack) / np.maximum(share_p, 1e-12)
    return float(min(1.0, share_u[np.argmin(bound)] / max(share_p[np.argmin(bound)], 1e-12)))


def ranked_above(rows: DataFrame, model: dict, w: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of all rows score at or above each of the rising ``edges``."""

    def run(batches):
        for batch in batches:
            g = expand((_matrix(batch.column("x")) - model["mean"]) / model["std"]) @ w
            n = np.bincount(np.searchsorted(edges, g, side="right"), minlength=len(edges) + 1)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], names=["bin", "n"])

    counts = rows.select("x").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(edges) + 1, dtype=np.int64)
    for r in counts:  # one row a threshold
        n[r["bin"]] = r["n"]
    return np.cumsum(n[::-1])[::-1][1:]


def estimate_prior(rows: DataFrame, model: dict, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among all rows; ``positive`` and ``unlabelled`` are expanded."""
    w = fit_ranking(positive[::2], unlabelled)
    g = np.sort(positive[1::2] @ w)
    edges = np.unique(g[np.linspace(0, len(g) - 1, min(THRESHOLDS, len(g))).astype(int)])
    above_p = len(g) - np.searchsorted(g, edges, side="left")
    return best_bin(ranked_above(rows, model, w, edges), max(1, rows.count()), above_p, len(g))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    rows = feature_rows(docs)
    model = train_features(rows, labels, max_positive, max_unlabelled)
    discard(rows)
    return model


def train_features(rows: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    positive, unlabelled = training_rows(rows, labels, max_positive, max_unlabelled)
    if len(positive) < 2 or not len(unlabelled):
        return {}
    mean, std = scale(rows)
    model = {"mean": mean, "std": std}
    positive, unlabelled = (expand((x - mean) / std) for x in (positive, unlabelled))
    prior = min(max(estimate_prior(rows, model, positive, unlabelled), 0.01), 0.99)
    return model | {"prior": prior, "w": fit_nnpu(positive, unlabelled, prior)}


def score_features(model: dict, x: np.ndarray) -> np.ndarray:
    if not model:
        return np.full(len(x), 0.5)
    return _sigmoid(expand((x.astype(np.float64) - model["mean"]) / model["std"]) @ model["w"])


def _judged(got: DataFrame) -> DataFrame:
    return got.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def score_rows(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of features."""

    def run(batches):
        for batch in batches:
            s = score_features(model, _matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return _judged(rows.mapInArrow(run, "doc_id long, score double"))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            s = score_features(model, featured(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return _judged(slim.mapInArrow(run, "doc_id long, score double"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(read_table(spark, sf_dir, "documents"))
    return score_rows(rows, train_features(rows, read_table(spark, sf_dir, "labels")))


def keep_predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted 1, with their own columns, in one pass without a join."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            text = batch.column(names.index("text"))
            good = pa.array(score_features(model, featured(text.to_pylist())) >= THRESHOLD)
            yield batch.filter(good)

    return docs.mapInArrow(run, docs.schema)
