"""Quality classifier (operator 2): Bradley-Terry ranking of documents by learned scores.

Every document has a vector of text statistics. From labelled documents that may be learnt
from, pairs of a better and a worse document are drawn; the weights maximise the likelihood
that the better one wins, a logistic loss on the differences of the vectors. The cutoff is the
quantile of the training scores at the share of label 0; a document's score is the logistic of
its distance from the cutoff, so that 0.5 stands for the cutoff.

Edge cases: a null or empty text has a vector of zeros and gets a score; a null doc_id is not
held out; null labels are not used, and of several labels of a document the lowest counts;
without both labels every score is 0.5; an empty table gives an empty result; labels, lang,
source and doc_id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import SPACES, held_out, over_batches, table

#: At most so many labelled rows are learnt from (those with the least hashes of their ids).
MAX_LABELLED = 30_000
#: Worse documents that each better one is compared with, and the reverse.
PAIRS_EACH = 24


def vector(text: str | None) -> list[float]:
    """Statistics of a whole text that tell prose from junk in any language."""
    if not text:
        return [0.0] * 14
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * 13 + [1.0]
    n, h = len(words), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    size = max(1, len(text) - int(h[[32, 9, 10, 11, 12, 13]].sum()))
    upper, digits = int(h[65:91].sum()), int(h[48:58].sum())
    symbols = sum(int(h[ord(c)]) for c in "#*$%&<>^~\\@=_{}[]/+")
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    distinct = len(set(words))
    return [
        float(np.log1p(n)), size / n, upper / size, digits / size, symbols / size, int(h[ord("!")]) / n, int(h[ord("|")]) / n, int(h[46]) / n, int(h[44]) / n,
        same / n, distinct / n, float(np.log(distinct)) / max(1.0, float(np.log(n + 1))), (len(lines) - len(set(lines))) / len(lines), 0.0,
    ]


class BradleyTerry:
    """Weights over standardised vectors with square-root companions for rates near zero."""

    def __init__(self):
        self.weights = None

    def _x(self, v: np.ndarray) -> np.ndarray:
        x = np.hstack([v, np.sqrt(np.abs(v))])
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def fit(self, v: np.ndarray, y: np.ndarray, seed: int = 1, l2: float = 1e-3, steps: int = 60) -> "BradleyTerry":
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self
        raw = np.hstack([v, np.sqrt(np.abs(v))])
        self.mean, self.scale = raw.mean(0), np.maximum(raw.std(0), 1e-6)
        x, r = self._x(v), np.random.default_rng(seed)
        n = PAIRS_EACH * max(len(good), len(bad))
        win, lose = r.choice(good, n), r.choice(bad, n)
        d, w = x[win] - x[lose], np.zeros(x.shape[1])
        for _ in range(steps):  # Newton's method on the logistic loss of differences
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g = d.T @ (p - 1) / n + l2 * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(len(w))
            move = np.linalg.solve(hess, g)
            w -= move
            if np.abs(move).max() < 1e-6:
                break
        s = x @ w
        self.cut = float(np.quantile(s, len(bad) / len(y)))
        self.spread = float(max(1e-6, np.std(s)) / 4)
        self.weights = w
        return self

    def score(self, v: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(v), 0.5)
        return 1 / (1 + np.exp(-np.clip((self._x(v) @ self.weights - self.cut) / self.spread, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> BradleyTerry:
    """Fit on a bounded sample of the labelled rows that are not held out; only ids are broadcast."""
    ids = labels.select(F.col("doc_id").alias("label_id"), "quality").dropna().groupBy("label_id").agg(F.min("quality").alias("label_quality"))
    ids = ids.where(~held_out(F.col("label_id"))).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    chosen = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).join(F.broadcast(ids), F.col("id") == F.col("label_id")).select("id", F.col("label_quality").cast("int").alias("y"), "body")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vector(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["id", "y", "v"])

    rows = sorted((r["id"], r["y"], r["v"]) for r in over_batches(chosen, batch, "id long, y int, v array<double>").collect())
    return BradleyTerry().fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows])) if rows else BradleyTerry()


def quality_scores(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, in one pass without a shuffle."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([vector(t) for t in b.column(2).to_pylist()]).reshape(b.num_rows, -1))
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return over_batches(docs.select("doc_id", held_out(F.col("doc_id")), "text"), batch, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
