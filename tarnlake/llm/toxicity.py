"""Toxicity as an ordinal severity, by cumulative-link regression.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all ordered
thresholds.  x holds which words and word beginnings a text has.  The labels
say only toxic or not, so toxic training texts are graded by how many features
typical of toxic ones they have: up to the median 1, above it 2.

Features are chosen by a likelihood ratio, which holds for rare ones and few
labels too, and the fit is regularised.  Training texts that are near copies of
one another count once.

Bounds (parameters): the model is fitted on at most LABELLED labelled documents,
the first by a hash of the id, in one task, with at most FEATURES features.
Every document is scored over its whole text.

Defined cases: a null or empty text has no features.  Without labels of both
kinds nothing is toxic.  Null labels and labels of unknown documents are left
out; of several labels of one document the worst counts.  Rows with a null id
and rows that repeat are scored like others.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, release, releasing, small_batches, text_or_empty

LABELLED = 8000
FEATURES = 1024
LEAST_DOCS = 2  # toxic training documents that a feature must be in
LEAST_G = 10.0  # likelihood ratio (G squared) by which a feature must tell toxic texts from others
DECAY = 3e-5  # of the weights, in the fit
NEAR, HASHES, BAND = 0.8, 32, 4  # near copies among the training texts: Jaccard similarity of features, by MinHash bands
CUT = 0.5  # toxic from this probability of a grade above 0
BEGINNINGS = (4, 5)

#: ASCII letters in lower case, other ASCII as spaces, other bytes as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str) -> set[bytes]:
    """Words, and the beginnings of longer words marked by a star."""
    words = set(text.encode("utf-8", "replace").translate(_TABLE).split())
    out = set(words)
    for n in BEGINNINGS:
        out.update({w[:n] + b"*" for w in words if len(w) > n})
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, rounds: int = 1500, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean cumulative-link loss.
    rows: indices of the features that each document has."""
    k = int(grades.max()) if len(grades) else 0
    w, theta0, gaps = np.zeros(n_features), 1.0, np.zeros(max(0, k - 1))
    flat = np.concatenate([*rows, np.zeros(0, int)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p = np.concatenate([w, [theta0], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = max(1, len(rows))
    for step in range(1, rounds + 1):
        w, theta = p[:n_features], np.cumsum(np.concatenate([[p[n_features]], np.exp(np.clip(p[n_features + 1 :], -10, 10))]))
        eta = np.bincount(owner, w[flat], minlength=len(rows))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = _sigmoid(edge[grades + 1] - eta), _sigmoid(edge[grades] - eta)
        mass = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / mass, low * (1 - low) / mass
        d_eta = (dh - dl) / n
        g_theta = np.zeros(k)
        np.add.at(g_theta, grades[grades < k], -dh[grades < k] / n)
        np.add.at(g_theta, grades[grades > 0] - 1, dl[grades > 0] / n)
        g = np.concatenate([np.bincount(flat, d_eta[owner], minlength=n_features) + decay * w, [g_theta.sum()], [g_theta[j:].sum() * (theta[j] - theta[j - 1]) for j in range(1, k)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], np.cumsum(np.concatenate([[p[n_features]], np.exp(np.clip(p[n_features + 1 :], -10, 10))]))


def first_of_near(feats: list[set[bytes]], toxic: list[int]) -> list[int]:
    """Places of the texts that are no near copy (NEAR) of an earlier one with the
    same label.  MinHash bands propose, the features themselves decide."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(1, 1 << 62, HASHES).astype(np.uint64) | np.uint64(1) for _ in range(2))
    seen: dict[tuple, list[int]] = {}
    keep = []
    for j, f in enumerate(feats):
        h = np.fromiter(map(zlib.crc32, f), np.uint64, len(f)) if f else np.zeros(1, np.uint64)
        low = ((h[:, None] * a + b) >> np.uint64(32)).min(0)
        keys = [(toxic[j], k, low[k : k + BAND].tobytes()) for k in range(0, HASHES, BAND)]
        near = {i for key in keys for i in seen.get(key, ())}
        if any(len(f & feats[i]) >= NEAR * len(f | feats[i]) for i in near):
            continue
        keep.append(j)
        for key in keys:
            seen.setdefault(key, []).append(j)
    return keep


def likelihood_ratio(a: int, n1: int, b: int, n0: int) -> float:
    """G squared of a feature that a of n1 toxic and b of n0 other texts have."""
    n, have = n1 + n0, a + b
    cells = ((a, have * n1), (b, have * n0), (n1 - a, (n - have) * n1), (n0 - b, (n - have) * n0))
    return 2 * sum(o * float(np.log(o * n / e)) for o, e in cells if o)


def train(texts: list[str], toxic: list[int]) -> dict:
    """A model: weights by feature, and thresholds; without both classes, none."""
    feats = [features(t) for t in texts]
    keep = first_of_near(feats, toxic)
    feats, y = [feats[j] for j in keep], np.array([toxic[j] for j in keep], int)
    if not len(y) or y.min() == y.max():
        return {"weights": {}, "theta": []}
    # Only features of toxic texts are of use; those of the others are many.
    counts = (Counter(), Counter())
    for f, label in zip(feats, y):
        if label:
            counts[1].update(f)
    usual = {f for f, n in counts[1].items() if n >= LEAST_DOCS}
    for f, label in zip(feats, y):
        if not label:
            counts[0].update(f & usual)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    g = {f: likelihood_ratio(counts[1][f], n1, counts[0][f], n0) for f in usual if counts[1][f] * n0 > counts[0][f] * n1}
    chosen = sorted((f for f in g if g[f] >= LEAST_G), key=lambda f: (-g[f], f))[:FEATURES]
    index = {f: j for j, f in enumerate(chosen)}
    rows = [np.array(sorted(index[f] for f in have if f in index), np.int64) for have in feats]
    n_typical = np.array([len(r) for r in rows])
    grades = y * (1 + (n_typical > np.median(n_typical[y == 1])))
    if grades.max() == 2 and (grades == 1).sum() == 0:
        grades = y
    w, theta = fit_ordinal(rows, grades, len(chosen))
    return {"weights": {f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-4}, "theta": theta.tolist()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fits on a bounded sample, in one task; the driver gets FEATURES rows at most."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # LABELLED rows of two numbers: a bounded broadcast.  A repeated id counts once.
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        model = train(pdf["text"].tolist(), (pdf["toxic"] > 0).astype(int).tolist())
        release()
        rows = [(f, x) for f, x in model["weights"].items()] + [(b"", x) for x in model["theta"]]
        return pd.DataFrame(rows, columns=["feature", "value"]).astype({"feature": object, "value": float})

    rows = chosen.groupBy(F.lit("all").alias("fit")).applyInPandas(task, "feature binary, value double").collect()
    return {"weights": {bytes(r[0]): r[1] for r in rows if r[0]}, "theta": sorted(r[1] for r in rows if not r[0])}


def grade_probabilities(eta: float, theta: list[float]) -> list[float]:
    below = [float(_sigmoid(np.array(t - eta))) for t in theta]
    return [b - a for a, b in zip([0.0, *below], [*below, 1.0])]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_severity, severity, p_toxic, toxic."""
    weights, theta = model["weights"], model["theta"]
    known = frozenset(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([grade_probabilities(sum(weights[f] for f in sorted(features(t) & known)), theta) for t in batch.column(1).to_pylist()])
            p = p.reshape(batch.num_rows, len(theta) + 1)
            expected, toxic = p @ np.arange(len(theta) + 1.0), 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected), pa.array(p.argmax(1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= CUT)],
                names=["doc_id", "expected_severity", "severity", "p_toxic", "toxic"],
            )

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, expected_severity double, severity int, p_toxic double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are toxic go, row by row.  Null and empty texts
    stay; ids, repeats and other columns play no part.  An empty table stays empty."""
    weights = fit(small_batches(docs), read_table(spark, sf_dir, "labels"))
    known, theta = frozenset(weights["weights"]), weights["theta"]

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        p = [1 - grade_probabilities(sum(weights["weights"][f] for f in sorted(features(t) & known)), theta)[0] for t in texts]
        return pd.Series([x >= CUT for x in p], dtype=bool)

    return docs.where(~toxic(text_or_empty()))
