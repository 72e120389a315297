"""Target-distribution importance resampling (operator 11) by hashed runs of words.

A scan of a text keeps a ring of zlib states, one for each of the last n word starts. Each new
word extends every state by a space and the word and opens a state of its own, so the states of
the ring are the crc32 values of all runs that end here, and no run is ever built. Texts go
through in blocks of bounded size; the ring lives on from block to block. The buckets of a
document are stored sparsely, so that the one scan serves both the corpus counts and the scores.

Bucket counts are summed per task and then by bucket; the driver gets one row a bucket. Scores
are integers: gains of the features, plus Gumbel noise drawn from a hash of the id, so the
highest scores are a draw without replacement in proportion to the weights. Ranks come from one
range partitioning of thin rows and the sizes of its partitions.

Edge cases: a null or empty text has no words, weight 0 and is never drawn; a null id hashes as
an empty one and comes after all others in a tie; rows that share an id are rows of their own and
get the same noise, full ties are ranked by features and then as the table gives them; an empty
table or an empty benchmark has no features of its own, so its counts are 0; a text of any length
is read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import over_batches, release, stored, table
from recollect.workers import ship

#: A-Z become a-z; all other ASCII bytes but digits and a-z separate words; bytes from 0x80 are parts of words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text whose words are in memory at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Draw:
    """Words of the longest run, buckets, seed of the noise, least words of a drawn document, percent to draw."""

    n: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least: int = 20
    percent: int = 10


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that cover some BLOCK bytes each (a longer word is not cut)."""
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_FOLD).split()
        at = end


class CrcRing:
    """States of the last n starts of runs, oldest first."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def feed(self, words: list[bytes]) -> list[int]:
        """The values of all runs that end in these words."""
        crc = zlib.crc32
        if self.n == 1:  # nothing is ever extended
            return list(map(crc, words))
        out, states, older = [], self.states, self.n - 1
        for w in words:
            spaced = b" " + w
            states = [crc(spaced, s) for s in states[-older:]]
            states.append(crc(w))
            out += states
        self.states = states
        return out


def histogram(text: bytes | None, d: Draw) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words, the buckets met and how often."""
    n_words, ids, counts, ring = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), CrcRing(d.n)
    for words in blocks(text or b""):
        n_words += len(words)
        new, times = np.unique(np.array(ring.feed(words), np.int64) % d.buckets, return_counts=True)
        if len(ids):  # an earlier block's
            new, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
            times = np.bincount(at, np.concatenate([counts, times])).astype(np.int64)
        ids, counts = new, times
    return n_words, ids, counts


_SPARSE = "doc_id long, n_words long, buckets array<int>, counts array<long>"


def bucketed(docs: DataFrame, d: Draw = Draw()) -> DataFrame:
    """doc_id, n_words and the sparse histogram of each text's features: one scan, no shuffle."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [histogram(t, d) for t in b.column(1).to_pylist()]
        ends = np.cumsum([0, *(len(ids) for _, ids, _ in found)]).astype(np.int32)
        flat = [np.concatenate([x[k] for x in found]) for k in (1, 2)]
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(kind))) for x, kind in zip(flat, (np.int32, np.int64), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in found], pa.int64()), *lists], ["doc_id", "n_words", "buckets", "counts"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), batch, _SPARSE)


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def totals(sparse: DataFrame, d: Draw = Draw()) -> np.ndarray:
    """Features in each bucket over all rows. A task sends one row a bucket at most, the driver gets as many."""
    ship(sparse)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d.buckets, np.int64)
        for b in batches:
            np.add.at(total, _flat(b, "buckets"), _flat(b, "counts"))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    rows = sparse.select("buckets", "counts").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(d.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat, rounded down."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(sparse: DataFrame, gain: np.ndarray, d: Draw = Draw()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = _flat(b, "buckets"), _flat(b, "counts")
        ends = np.concatenate([[0], np.cumsum(np.diff(b.column(2).offsets.to_numpy()))])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counts, gain[ids] * counts)]
        n_features, weight = (x[ends[1:]] - x[ends[:-1]] for x in sums)
        extra = np.array([noise(i, d.seed) for i in b.column(0).to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_features), pa.array(weight), pa.array(weight + extra)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return over_batches(sparse, batch, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, d: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of rows with a score; the rank is null for rows not drawn.

    Rows are dealt by ranges of their order. A row's number within its partition and the sizes of
    the partitions before it give its rank, so no window holds them all. The driver gets a count
    for each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    thin = rows.withColumn("able", F.col("n_words") >= d.least).withColumn("row", F.monotonically_increasing_id())
    dealt = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id that Spark gives is the partition's number, then the row's number in it
    placed = stored(dealt.select("doc_id", "able", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at")), "ranges")
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect()
    most = d.percent * sum(r["able"] for r in sizes) // 100
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
    small = rows.sparkSession.createDataFrame(starts, "start_part long, before long")
    number = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    both = placed.withColumn("part", part).join(F.broadcast(small), F.col("part") == F.col("start_part"))
    return both.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (number <= most), number).alias("rank"))


def resample(docs: DataFrame, benchmark: DataFrame, d: Draw = Draw()) -> DataFrame:
    """Draw documents whose features are spread as in `benchmark` (column text)."""
    sparse = stored(bucketed(docs, d), "buckets")
    target = bucketed(benchmark.select(F.lit(None).cast("long").alias("doc_id"), "text"), d)
    rows = stored(scored(sparse, gains(totals(sparse, d), totals(target, d)), d), "scores")
    release(sparse)
    out = ranked(rows, d)
    release(rows)
    return out


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 by its definition: the reflected polynomial 0xEDB88320, a byte at a time, over the distinct words.
ORACLE_SQL = r"""
with recursive crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select range::bigint as i from range(256))
    )
), words as (
    select 'd' as kind, doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    union all
    select 'b', null, null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), found as (
    select kind, row, word, count(*) as n from (select kind, row, unnest(w) as word from words) group by all
), bytes as (
    select word, list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || substr(hex(encode(word)), i::int, 2))::bigint) as b from (select distinct word from found)
), hashed as (
    select word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from bytes, crc_table
), counted as (
    select bucket, coalesce(sum(n) filter (kind = 'd'), 0)::bigint as s, coalesce(sum(n) filter (kind = 'b'), 0)::bigint as t from found join hashed using (word) group by bucket
), sums as (
    select sum(s)::bigint as all_s, sum(t)::bigint as all_t from counted
), gain as (
    select bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::double / ((s + 1) * (all_t + 10000))::double))::bigint as g from counted, sums
), weights as (
    select row, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from found join hashed using (word) join gain using (bucket) where kind = 'd' group by row
), scores as (
    select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from words left join weights using (row) where kind = 'd'
), able as (
    select count(*) filter (n_words >= 20) * 10 // 100 as most from scores
), numbered as (
    select *, row_number() over (order by n_words >= 20 desc, score desc, doc_id nulls last, n_features) as number from scores
)
select doc_id, n_features, weight, score, case when n_words >= 20 and number <= most then number end as rank from numbered, able
"""
