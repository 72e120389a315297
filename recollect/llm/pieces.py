"""SentencePiece encoding and decoding (operator 7) by a relational lattice.

A word is a run of spaces with the characters up to the next space or line end. The frequent
words of the whole corpus (a bounded number) become a table; their substrings of at most a
piece's length are exploded and equi-joined to the piece table, and the edges of each word are
grouped and folded with Spark's higher-order aggregate. The words' ids are broadcast; words
outside that table get theirs from the same lattice and fold in the worker, so results do not
depend on the bound.

The fold: the model file holds byte-pair scores, which rank merges. The best path by the sum of
scores (Viterbi) is not what such a model encodes, so the fold picks, step by step, the best
edge that joins two neighbouring segments, leftmost first; for a unigram model it would be the
best path. Characters without a piece fall back to their bytes.

Edge cases: a null or empty text has no ids and decodes to the empty text; a null doc_id stays
null; repeated rows each give their row; an empty table gives an empty result; other columns
are not read; U+2581 in a text is the same as a space, as in the model, so only there does the
round trip differ (`round_trip` compares with that replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import WordBytes, over_batches, stored, table, worker_state

SPACE = "▁"
#: Bounds of the broadcast table: its words, and the characters of each.
MAX_WORDS, MAX_CHARS = 1 << 18, 48
_WORD = re.compile("▁*[^▁\n]+|▁+|\n")


class PieceTable:
    """The model's ordinary pieces with scores and ids; bytes have ids from `byte0`. The size is that of the file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte0 = sp.piece_to_id("<0x00>")
        self.pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.scores = {p: s for p, (s, _) in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        self.raw = [bytes([i - self.byte0]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]

    def ids(self, word: str) -> bytes:
        """The same fold as the relational one, for one word: the scores of neighbouring pairs stand in a list."""
        if len(word) > 64:
            return self._long(word)
        get, none = self.scores.get, -math.inf
        parts = list(word)
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair and (best := max(pair)) > none:
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
        out: list[int] = []
        for x in parts:
            if p := self.pieces.get(x):
                out.append(p[1])
            else:
                out += [self.byte0 + b for b in x.encode("utf-8", "surrogatepass")]
        return struct.pack(f"<{len(out)}I", *out)

    def _long(self, word: str) -> bytes:
        """The same with a queue of joins, for words of any length."""
        get, n = self.pieces.get, len(word)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # segments by their starts
        queue: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := end[i]) < n and end[j] - i <= self.longest and (p := get(word[i : end[j]])):
                heapq.heappush(queue, (-p[0], i, end[j]))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while queue:
            _, i, e = heapq.heappop(queue)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j], end[i] = False, e
            if e < n:
                left[e] = i
            offer(i)
            offer(left[i])
        out, i = [], 0
        while i < n:
            p = get(word[i : end[i]])
            out += [p[1]] if p else [self.byte0 + b for b in word[i : end[i]].encode("utf-8", "surrogatepass")]
            i = end[i]
        return np.array(out, "<u4").tobytes()

    def caches(self, shared) -> tuple[WordBytes, WordBytes]:
        """Ids of words after a space, and of words at the start of a line.

        From the broadcast table, else by the fold; kept for the tasks that share the broadcast.
        """
        if getattr(self, "_of", None) is not shared:
            first = shared.value
            self._caches = WordBytes(lambda w: first.get(SPACE + w) or self.ids(SPACE + w), 250_000), WordBytes(lambda w: first.get(w) or self.ids(w), 50_000)
            self._of = shared
        return self._caches

    def encode(self, text: str, caches: tuple[WordBytes, WordBytes]) -> bytes:
        """Ids of a text, line by line; lines with repeated spaces are cut by the pattern."""
        if not text:
            return b""
        spaced, bare = caches
        out = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words or SPACE in line:
                out.append(b"".join(self.ids(w) for w in _WORD.findall((SPACE if k == 0 else "") + line.replace(" ", SPACE))))
            elif k:
                out.append(bare[words[0]] + b"".join(map(spaced.__getitem__, words[1:])))
            else:
                out.append(b"".join(map(spaced.__getitem__, words)))
        return struct.pack("<I", self.byte0 + 10).join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; the space that encoding puts first is taken off."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


def piece_table(path: str) -> PieceTable:
    """One for each worker process."""
    return worker_state("pieces " + path, lambda: PieceTable(path))


def marked(text: str) -> str:
    """The text as the model sees it: spaces as U+2581, one put first."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def frequent_words(docs: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """word: all words at least as frequent as a count, chosen so that there are at most `most`.

    Which words are in the table decides about speed only.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter[str] = Counter()
        first: Counter[str] = Counter()
        for t in b.column(0).to_pylist():
            for k, line in enumerate((t or "").split("\n")):
                words = line.split(" ")
                if k:
                    first[words[0]] += 1
                    del words[0]
                n.update(words)
        words = {SPACE + w: c for w, c in n.items() if w and len(w) < MAX_CHARS and SPACE not in w} | {w: c for w, c in first.items() if w and len(w) <= MAX_CHARS and SPACE not in w}
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    counted = stored(over_batches(docs.select("text"), batch, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    steps = counted.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("k")).collect()  # a few hundred rows at most
    total, cut = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["k"]
        if total > most:
            break
        cut = r["step"]
    return counted.where(F.lit(False) if cut is None else F.floor(F.log2("n") * 16) >= cut).select("word")


def lattice(words: DataFrame, pieces: PieceTable) -> DataFrame:
    """word, n (its length) and edges: start, end, score and id of every piece that is a substring."""
    spark = words.sparkSession
    rows = spark.createDataFrame(pd.DataFrame([(p, s, i) for p, (s, i) in pieces.pieces.items()], columns=["piece", "score", "id"]).astype({"id": "int32"}))
    at = words.withColumn("n", F.length("word")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spans = at.withColumn("e", F.explode(F.expr(f"sequence(s + 1, least(n, s + {pieces.longest}))")))
    cut = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
    edges = cut.join(F.broadcast(rows), "piece").groupBy("word").agg(F.collect_list(F.struct("s", "e", "score", "id")).alias("edges"))
    return words.join(edges, "word", "left").select("word", F.length("word").alias("n"), F.coalesce("edges", F.expr("cast(array() as array<struct<s:int,e:int,score:double,id:int>>)")).alias("edges"))


#: Boundaries of the segments of `word`, folded over n steps: each takes out the boundary inside the best edge that joins two neighbours.
_FOLD = """
aggregate(sequence(1, n), sequence(0, n), (b, i) -> transform(
  array(array_max(transform(
    filter(edges, x -> x.e - x.s > 1 and array_contains(b, x.s) and array_contains(b, x.e) and size(filter(b, y -> y > x.s and y < x.e)) = 1),
    x -> struct(x.score as score, -x.s as s, x.e as e)))),
  m -> if(m is null, b, filter(b, y -> y <= -m.s or y >= m.e)))[0])
"""
_HEX = "hex(encode(substring(word, s + 1, 1), 'UTF-8'))"
#: Ids of the segments: of the edge between two boundaries, else of the bytes of the character.
_IDS = f"""
flatten(transform(slice(bounds, 1, size(bounds) - 1), (s, i) -> if(
  exists(edges, x -> x.s = s and x.e = bounds[i + 1]),
  transform(filter(edges, x -> x.s = s and x.e = bounds[i + 1]), x -> x.id),
  transform(sequence(0, length({_HEX}) div 2 - 1), j -> byte0 + cast(conv(substring({_HEX}, 2 * j + 1, 2), 16, 10) as int)))))
"""


def word_ids(words: DataFrame, pieces: PieceTable) -> DataFrame:
    """word and ids of every word of the table, by the lattice."""
    folded = lattice(words, pieces).withColumn("bounds", F.expr(_FOLD)).withColumn("byte0", F.lit(pieces.byte0))
    return folded.select("word", F.expr(_IDS).alias("ids"))


def encode(docs: DataFrame, path: str | None = None, most: int = MAX_WORDS, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_sha256 of the decoded text, round_trip; ids on request."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    words = word_ids(frequent_words(docs, most), PieceTable(path))
    known = {r.word: np.asarray(r.ids, "<u4").tobytes() for r in words.toPandas().itertuples()}  # at most `most` words of MAX_CHARS characters
    shared = spark.sparkContext.broadcast(known)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces = piece_table(path)
        caches = pieces.caches(shared)
        out: list[list] = [[] for _ in range(5)]
        for t in b.column(1).to_pylist():
            ids = pieces.encode(t or "", caches)
            text = pieces.decode(ids)
            for c, v in zip(out, (len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text).hexdigest(), text == (t or "").replace(SPACE, " ").encode("utf-8", "surrogatepass"), np.frombuffer(ids, "<u4").astype(np.int32) if keep_ids else None), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
        names = ["doc_id", "n_pieces", "ids_crc32", "text_sha256", "round_trip", "ids"]
        n = 6 if keep_ids else 5
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))][:n], names[:n])

    schema = "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return over_batches(docs.select("doc_id", "text"), batch, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids (a null or empty list gives the empty text; broken UTF-8 is replaced)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        state = piece_table(path)
        texts = [state.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return over_batches(encoded.select("doc_id", "ids"), batch, "doc_id long, text string")


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
