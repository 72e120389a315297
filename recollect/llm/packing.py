"""Best-fit packing (operator 10): documents into token sequences by vector best-fit.

Only a document longer than a sequence is cut; its pieces are full but for the last. A piece
has a vector of demands: tokens, one document, and the attention cost of its length squared. A
bin has capacities of each. Pieces are placed from the longest to the shortest: of the bins
where a piece fits under every constraint, the one with the least norm of weighted residuals
after placing wins (or the largest weighted dot product of demand and residual).

All three demands follow from the length, so pieces of one length are alike. The plan is made
on the driver from the histogram of lengths (at most `tokens` rows at any input size): bins
in the same state form a class, and pieces of one length fill whole classes at a time. Its rows
say which ranks of a length go to which run of bins at which offset; their number depends on
the number of lengths, not of documents. Ranks within a length are dealt out by adding up
counts per length and slice of documents, so a length that a third of all documents have is
ranked in many tasks. The plan is then looked up piece by piece.

Edge cases: a null text counts as empty and is one piece, the end id alone; a null doc_id stays
null; repeated rows are packed each; ties are broken by slice, doc_id, piece and digest; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm.common import WordBytes, over_batches, stored, table, worker_state

END = 1


@dataclass(frozen=True)
class Capacity:
    """Of a sequence: tokens, documents, attention cost (None: as the tokens allow), weights of the three, and the rule."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2


class WordTokenizer:
    """Ids of a text as little-endian 32-bit bytes, by the tokenizer file, each distinct word encoded once.

    The tokenizer's pre-tokens never span white space and its normalizer (NFC, lower case) acts
    on each word alone, so the ids of white-space-separated words follow one another. Texts for
    which that is not certain (special strings, combining marks, control characters that only
    Python takes for spaces, letters whose lower case depends on context or on the version of
    Unicode) are encoded whole.
    """

    _WHOLE = re.compile("<\\||[\x1c-\x1f\u0300-\u036f\u03a3\u200b-\u200f\u2060\ufeff\ua7c0-\ua7ff\ud800-\udfff\U00010d40-\U00010dff]")
    _SIMPLE = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.cache = WordBytes(self._word, 250_000)
        self.parts = WordBytes(self._letters, 120_000)
        self.signs = WordBytes(self._encode, 20_000)
        # byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """A lower-case word of letters is one pre-token: the model alone does."""
        mapped = word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if m := self._SIMPLE.fullmatch(word):
            letters, signs = m.groups()
            return self.parts[letters] + self.signs[signs] if signs else self.parts[letters]
        return self._encode(word)

    def ids(self, text: str) -> bytes:
        if self._WHOLE.search(text):
            return self._encode(text)
        return b"".join(map(self.cache.__getitem__, text.lower().split()))


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that its words serve all its tasks."""
    return worker_state("tokenizer " + path, lambda: WordTokenizer(path))


def pieces(docs: DataFrame, tokens: int, path: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; one pass over the texts."""
    end = np.array([END], "<u4").tobytes()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = word_tokenizer(path)
        at, cols = [], [[], [], [], []]
        for row, text in enumerate(b.column(1).to_pylist()):
            ids = tokenizer.ids(text or "") + end
            for k, i in enumerate(range(0, len(ids), 4 * tokens)):
                part = ids[i : i + 4 * tokens]
                at.append(row)
                for c, v in zip(cols, (k, i // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    c.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return over_batches(docs.select("doc_id", "text"), batch, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, one past the last, first bin, pieces a bin, offset) of a vector best-fit.

    Rank r of the length lies in bin first + (r - first rank) // a bin, at offset + length * ((r - first rank) % a bin).
    """
    limits = np.array(cap.limits(), float)
    weight = np.array(cap.weights)
    # open classes by state: (tokens, documents, attention left) -> runs [first bin, one past) in that state
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    rows, bins = [], 0
    full = cap.limits()
    for size in sorted(histogram, reverse=True):
        need, rank, left = (size, 1, size * size), 0, histogram[size]
        if any(n > f for n, f in zip(need, full, strict=True)):
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        fits = [s for s in states if all(n <= r for n, r in zip(need, s, strict=True))]
        if fits:
            r = np.array(fits, float) / limits
            d = np.array(need) / limits
            cost = ((weight * (r - d)) ** 2).sum(1) if cap.rule == "norm" else -(weight * r * d).sum(1)
            fits = [fits[i] for i in np.lexsort((np.arange(len(fits)), cost))]
        for state in [*fits, None]:
            runs = states.pop(state) if state is not None else None
            room = state or full
            each = min(r // n for r, n in zip(room, need, strict=True))
            while left and (runs is None or runs):
                if runs is None:
                    first, have = bins, -(-left // each)
                    bins += have
                else:
                    first, have = runs[-1][0], runs[-1][1] - runs[-1][0]
                use = min(have, -(-left // each))
                put = min(left, use * each)
                rows.append((size, rank, rank + put, first, each, full[0] - room[0]))
                whole, rest = divmod(put, each)
                for at, count, n in ((first, whole, each), (first + whole, 1, rest)):
                    if count and n:
                        after = tuple(r - n * x for r, x in zip(room, need, strict=True))
                        if after[0] and after[1] and after[2]:
                            states.setdefault(after, []).append([at, at + count])
                rank, left = rank + put, left - put
                if runs is None:
                    break
                runs[-1][0] = first + use
                if runs[-1][0] == runs[-1][1]:
                    runs.pop()
            if runs:
                states.setdefault(state, []).extend(runs)
            if not left:
                break
    return rows


def pack(docs: DataFrame, cap: Capacity = Capacity(), path: str | None = None) -> DataFrame:
    """One row for each piece with its place: sequence_id and offset."""
    spark = docs.sparkSession
    parts = stored(pieces(docs, cap.tokens, path or public_tokenizers.path("word_bpe_49k.json")), "pieces")
    slices = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    counts = stored(dealt.groupBy("length", "slice").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most cap.tokens rows
    rows = np.array(plan(histogram, cap), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast(rows)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "slice", "before")
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = dealt.withColumn("rank", within.cast("long")).join(before, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value
        length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
        # rows are sorted by length and first rank: find the last row at or before (length, rank)
        starts = np.searchsorted(p[:, 0], length, "left")
        ends = np.searchsorted(p[:, 0], length, "right")
        low, high = starts.copy(), ends.copy()
        while (open_ := high - low > 1).any():
            mid = (low + high) // 2
            go = open_ & (p[np.minimum(mid, len(p) - 1), 1] <= rank)
            low, high = np.where(go, mid, low), np.where(open_ & ~go, mid, high)
        at = p[low]
        k = rank - at[:, 1]
        return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[:, 3] + k // at[:, 4]), pa.array(at[:, 5] + length * (k % at[:, 4]))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return over_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), batch, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
