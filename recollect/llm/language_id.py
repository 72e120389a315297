"""Language identification (operator 6): multinomial naive Bayes over hashed character n-grams.

Runs of one to three characters of the lower-cased text are hashed into a fixed number of
buckets. Counts per language and bucket, from a bounded sample of each language's documents that
may be learnt from, give a matrix of log probabilities, which is broadcast (its size is fixed:
buckets times languages). Texts are scored in batches: the rows of the n-grams of many texts are
gathered at once and added up text by text. Priors follow the sample.

Edge cases: a null text, or one without a letter, is `und` with score 0; without anything to
learn from, every text is `und`; a null doc_id is not held out; rows with a null lang are not
learnt from; an empty table gives an empty result; lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import held_out, over_batches, table

BUCKETS = 1 << 16
#: At most so many documents of each language are learnt from (chosen by hashes of their ids).
MAX_LEARNT = 4_000
#: The matrix takes 256 kB a language; more languages than this are an error, none is left out.
MAX_LANGS = 2_048
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 16


def gram_buckets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of one, two and three characters by where they start."""
    one = (x * np.uint32(0x9E3779B1)) >> np.uint32(16)
    two = (x[:-1] * np.uint32(0x85EBCA6B)) ^ (x[1:] * np.uint32(0xC2B2AE35))
    three = ((two[:-1] * np.uint32(0x165667B1)) ^ (x[2:] * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA77)
    return one, (two * np.uint32(0x27D4EB2F)) >> np.uint32(16), three >> np.uint32(16)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all runs of one to three characters of a text, a bounded piece at a time."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for i in range(0, len(c), _PIECE):
        for g in gram_buckets(c[i : i + _PIECE + 2]):
            yield g[:_PIECE]


class NaiveBayes:
    """Log probabilities by bucket (a row of zeros after the last) and language, and log priors."""

    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.prior = langs, prior
        self.logs = np.vstack([logs, np.zeros((1, len(langs)), np.float32)])

    def sums(self, texts: list[str]) -> np.ndarray:
        """Log scores of non-empty texts. The n-grams of many texts are gathered at once and added up text by text."""
        out = np.tile(self.prior, (len(texts), 1))
        waiting: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > _PIECE:  # alone, a bounded piece at a time
                for g in grams(text):
                    out[i] += self.logs[g].sum(0, dtype=np.float64)
                continue
            if size + len(text) > _PIECE:
                self._add([texts[k] for k in waiting], waiting, out)
                waiting, size = [], 0
            waiting.append(i)
            size += len(text)
        if waiting:
            self._add([texts[k] for k in waiting], waiting, out)
        return out

    def _add(self, texts: list[str], rows: list[int], out: np.ndarray) -> None:
        lower = [t.lower() for t in texts]
        n = np.array([len(t) for t in lower])
        starts = np.cumsum(n) - n
        left = np.repeat(starts + n, n) - np.arange(n.sum())  # characters from here to the text's end
        one, two, three = gram_buckets(np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32))
        two, three = (np.where(left >= k, np.append(g, np.zeros(k - 1, g.dtype))[: len(one)], BUCKETS) for k, g in ((2, two), (3, three)))
        out[rows] += np.add.reduceat(self.logs[one] + self.logs[two] + self.logs[three], starts, axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [("und", 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if self.langs and t is not None and _LETTER.search(t)]
        s = self.sums([texts[i] for i in at])
        best = s.argmax(1) if at else []
        for i, row, k in zip(at, s, best, strict=True):
            found[i] = self.langs[k], float(1 / np.exp(row - row[k]).sum())
        return found


def learn(docs: DataFrame, most: int = MAX_LEARNT) -> NaiveBayes:
    """Counts over the sample, added up by Spark; the driver gets at most buckets times languages."""
    ok = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    ids = ok.select(F.col("doc_id").alias("learn_id"), F.col("lang").alias("learn_lang")).dropna().withColumn("h", F.xxhash64("learn_id"))
    # rows whose hash lies below twice the share that is wanted: so few of a frequent language that one task can rank them
    sizes = ids.groupBy("learn_lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages can not be told apart")
    sizes = docs.sparkSession.createDataFrame([tuple(r) for r in sizes], "learn_lang string, n long")
    ids = ids.join(F.broadcast(sizes), "learn_lang").where(F.pmod("h", F.lit(1 << 40)).cast("double") * F.col("n") <= float(2 * most * (1 << 40)))
    rank = F.row_number().over(Window.partitionBy("learn_lang").orderBy("h", "learn_id"))
    ids = ids.withColumn("r", rank).where(F.col("r") <= most).select("learn_id", "learn_lang").distinct()
    chosen = ok.join(F.broadcast(ids), (F.col("doc_id") == F.col("learn_id")) & (F.col("lang") == F.col("learn_lang"))).select("lang", "text")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if text is None or not _LETTER.search(text):
                continue
            a = by.setdefault(lang, np.zeros(BUCKETS, np.int64))
            docs_of[lang] = docs_of.get(lang, 0) + 1
            for g in grams(text):
                a += np.bincount(g, minlength=BUCKETS)
        langs, at, n = [], [], []
        for lang, a in by.items():
            full = np.flatnonzero(a)
            langs += [lang] * (len(full) + 1)
            at += [-1, *full.tolist()]
            n += [docs_of[lang], *a[full].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    rows = over_batches(chosen, batch, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return NaiveBayes([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    sizes = rows[rows.bucket < 0]
    langs = sorted(sizes.lang)
    number = {x: i for i, x in enumerate(langs)}
    n = np.full((BUCKETS, len(langs)), 0.5)
    body = rows[rows.bucket >= 0]
    n[body.bucket.to_numpy(), body.lang.map(number).to_numpy()] += body.n.to_numpy()
    prior = sizes.set_index("lang").n.reindex(langs).to_numpy(dtype=float)
    return NaiveBayes(langs, np.log(n / n.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def languages(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(b.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return over_batches(docs.select("doc_id", held_out(F.col("doc_id")), "text"), batch, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, learn(docs))
