"""A postings index for BM25 that a change extends by a small segment and a query reads in parts.

A segment holds, for the chunks that one call added, the postings of each term in order of their
ids, cut into blocks of some hundred; with each block its range of ids, its highest term count and
its least length, which bound what a posting in it can score. Chunks that a call removes are
listed by its segment, with their counts taken off the statistics, so nothing older is touched.
Every FAN segments of a level are merged into one of the next. The list of segments is a version of
a store: readers see all of a change or nothing, and writers that collide start anew.

A query takes its terms from the rarest on. Once the terms not yet read could not, even with their
best blocks together, lift a chunk to the k-th score found so far, chunks without a term
already read are out; of the remaining terms only blocks whose range holds a candidate are read.
Within the terms read, blocks whose bound is too low are passed by. Scores are those of a full scan.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.schemas import BM25_B, BM25_K1
from recollect.sources.store import FAN, Store
from recollect.workers import ship, slices

#: Postings of a block; candidates that are looked up by block, beyond which a term is read whole.
BLOCK, LOOKED_UP = 128, 20_000
_BLOCKS = "term string, lo string, hi string, n int, top_tf int, least_dl int, ids array<string>, tfs array<int>, dls array<int>, block long"
_STATS = "term string, df long, n long, total long"


class Postings:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Store(spark, root)
        #: Blocks of the last query's terms, and how many of them were read.
        self.blocks = self.read = 0

    # writing

    def update(self, old: DataFrame | None, new: DataFrame | None, text: str = "content") -> int:
        """One segment in which the chunks `old` (id and text as they were) are gone and `new` are there. Returns the version."""
        segment = self._write(self._counted(new, text), lambda made: self._stats(old, new, made, text), old.select("id") if old is not None else None, 0, repeats=True)
        n = self.log.change(lambda base: {"segments": [*base["tables"].get("segments", []), segment]})
        if max(Counter(s["level"] for s in self._segments()).values()) >= FAN:
            self.log.change(self._merged)
        return n

    def _counted(self, chunks: DataFrame, text: str) -> DataFrame:
        """Postings (term, id, tf, dl), counted row by row, so that nothing is shuffled; rows of one id give postings each."""
        ship(self.spark)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in slices(batch)):
                words = b.column(1)
                coded = pc.list_flatten(words).dictionary_encode()
                n = max(1, len(coded.dictionary))
                keys, tfs = np.unique(pc.list_parent_indices(words).to_numpy().astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
                row = pa.array(keys // n)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keys % n)), b.column(0).take(row), pa.array(tfs.astype(np.int32)), pc.list_value_length(words).take(row)], ["term", "id", "tf", "dl"])

        toks = chunks.select(F.col("id").cast("string").alias("id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
        return toks.mapInArrow(count, "term string, id string, tf int, dl int")

    def _stats(self, old: DataFrame | None, new: DataFrame, made: DataFrame, text: str) -> DataFrame:
        """Changes of document frequencies by term, and of the number and total length of chunks (a null term).

        Those of the chunks that are there now come from their blocks.
        """
        none, zero = F.lit(None).cast("string").alias("term"), lambda name: F.lit(0).cast("long").alias(name)
        length = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
        parts = [
            made.select("term", F.col("n").cast("long").alias("df"), zero("n"), zero("total")),
            made.agg(F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total")).select(none, zero("df"), zero("n"), "total"),
            new.agg(F.count("*").alias("n")).select(none, zero("df"), "n", zero("total")),
        ]
        if old is not None:
            gone = self._counted(old, text)
            parts += [
                gone.select("term", "id", "dl").distinct().select("term", F.lit(-1).cast("long").alias("df"), zero("n"), zero("total")),
                gone.agg((-F.coalesce(F.sum("tf"), F.lit(0))).cast("long").alias("total")).select(none, zero("df"), zero("n"), "total"),
                old.agg((-F.count("*")).alias("n")).select(none, zero("df"), "n", zero("total")),
            ]
        return _summed(reduce(DataFrame.union, parts))

    def _write(self, posts: DataFrame, stats: Callable[[DataFrame], DataFrame], gone: DataFrame | None, level: int, repeats: bool = False) -> dict:
        """With `repeats`, postings of one term, id and length are added up."""
        ship(self.spark)
        at = uuid.uuid4().hex

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            out: list[tuple] = []

            def close() -> None:
                ids, tfs, dls = (list(x) for x in zip(*(h[1:] for h in held), strict=True))
                out.append((held[0][0], ids[0], ids[-1], len(ids), max(tfs), min(dls), ids, tfs, dls))
                held.clear()

            def batch() -> pa.RecordBatch:
                kinds = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays(arrays, ["term", "lo", "hi", "n", "top_tf", "least_dl", "ids", "tfs", "dls"])

            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if repeats and held and (row[0], row[1], row[3]) == (held[-1][0], held[-1][1], held[-1][3]):
                        held[-1] = (*row[:2], held[-1][2] + row[2], row[3])
                        continue
                    if held and (row[0] != held[0][0] or len(held) == BLOCK):
                        close()
                        if len(out) >= 2000:
                            yield batch()
                    held.append(row)
            if held:
                close()
            if out:
                yield batch()

        # by ranges of term and id, so that a frequent term spreads over many tasks
        ordered = posts.select("term", "id", "tf", "dl").repartitionByRange("term", "id").sortWithinPartitions("term", "id", "dl")
        blocks = ordered.mapInArrow(pack, _BLOCKS.rsplit(", ", 1)[0]).withColumn("block", F.monotonically_increasing_id())
        blocks.write.option("compression", "zstd").parquet(f"{self.root}/blocks/{at}")
        stats(self.spark.read.schema(_BLOCKS).parquet(f"{self.root}/blocks/{at}")).write.parquet(f"{self.root}/stats/{at}")
        (gone if gone is not None else self.spark.createDataFrame([], "id string")).select(F.col("id").cast("string")).write.parquet(f"{self.root}/gone/{at}")
        return {"at": at, "level": level}

    def _segments(self) -> list[dict]:
        return self.log.current()["tables"].get("segments", [])

    def _merged(self, base: dict) -> dict[str, list[dict]]:
        """The segments after the FAN or more of the lowest full level have become one; segments of a level stand side by side."""
        segments = base["tables"].get("segments", [])
        for level in sorted({s["level"] for s in segments}):
            own = [s for s in segments if s["level"] == level]
            if len(own) >= FAN:
                rows = self._live(own).select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"), "seg").select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), "seg")
                new = self._write(self._without_gone(rows, own), lambda _: _summed(self._all("stats", own, _STATS)), self._all("gone", own, "id string").select("id").distinct(), level + 1)
                first = segments.index(own[0])
                return {"segments": [*segments[:first], new, *segments[first + len(own) :]]}
        return {}

    # reading

    def _all(self, kind: str, segments: list[dict], schema: str) -> DataFrame:
        """Rows of all segments with seg, the segment's place."""
        out = self.spark.createDataFrame([], schema).withColumn("seg", F.lit(0))
        for i, s in enumerate(segments):
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{s['at']}").withColumn("seg", F.lit(i)))
        return out

    def _live(self, segments: list[dict]) -> DataFrame:
        return self._all("blocks", segments, _BLOCKS)

    def _without_gone(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows (id, seg) that no later segment has removed."""
        gone = self._all("gone", segments, "id string").groupBy(F.col("id").alias("g_id")).agg(F.max("seg").alias("g_seg"))
        return rows.join(gone, (F.col("id") == F.col("g_id")) & (F.col("seg") < F.col("g_seg")), "left_anti")

    def search(self, terms: list[str], k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
        """id and raw_score of the k best chunks for distinct terms, ties to the lesser id."""
        segments, terms = self._segments(), sorted(set(terms))
        self.blocks = self.read = 0
        stats = {r["term"]: r for r in _summed(self._all("stats", segments, _STATS).where(F.col("term").isNull() | F.col("term").isin(terms))).collect()}
        none = self.spark.createDataFrame([], "id string, raw_score double")
        terms = [t for t in terms if t in stats and stats[t]["df"] > 0]
        if not terms or stats[None]["n"] <= 0:
            return none
        n, mean = stats[None]["n"], stats[None]["total"] / stats[None]["n"]
        idf = {t: math.log((n - stats[t]["df"] + 0.5) / (stats[t]["df"] + 0.5) + 1) for t in terms}
        weight = F.element_at(F.create_map(*(F.lit(x) for t in terms for x in (t, idf[t]))), F.col("term"))
        score = lambda tf, dl: weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))
        blocks = self._live(segments).where(F.col("term").isin(terms)).withColumn("bound", score(F.col("top_tf"), F.col("least_dl")))
        meta = blocks.select("term", "seg", "block", "lo", "hi", "bound")
        tops = {r["term"]: (r["top"], r["n"]) for r in meta.groupBy("term").agg(F.max("bound").alias("top"), F.count("*").alias("n")).collect()}
        terms = sorted((t for t in terms if t in tops), key=lambda t: (-tops[t][0], t))
        self.blocks = sum(tops[t][1] for t in terms)

        def postings(some: DataFrame) -> DataFrame:
            flat = some.select("term", "seg", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("term", "seg", F.col("p.ids").alias("id"), score(F.col("p.tfs"), F.col("p.dls")).alias("part"))
            return self._without_gone(flat, segments)

        def chosen(t: str) -> DataFrame:
            rest = sum(tops[u][0] for u in terms if u != t)
            return blocks.where((F.col("term") == t) & (F.col("bound") + rest >= kth - 1e-9))

        kept: list[DataFrame] = []
        kth, taken, parts, counted = 0.0, [], none.select(F.lit("").alias("term"), F.lit(0).alias("seg"), "id", F.col("raw_score").alias("part")), 0
        for i, t in enumerate(terms):
            if kth > 0 and sum(tops[u][0] for u in terms[i:]) < kth - 1e-9:
                break
            counted += chosen(t).select("block").count()
            kept.append(postings(chosen(t)).persist())  # read once for this and all later steps
            parts = parts.union(kept[-1])
            taken.append(t)
            best = [r["s"] for r in parts.groupBy("id").agg(F.sum("part").alias("s")).orderBy(F.desc("s")).limit(k).select("s").collect()]
            kth = max(kth, best[-1]) if len(best) == k else kth
        rest = terms[len(taken) :]
        if rest:
            spare = sum(tops[u][0] for u in rest)
            candidates = parts.groupBy("id").agg(F.sum("part").alias("s")).where(F.col("s") + spare >= kth - 1e-9).select("id")
            few = [r["id"] for r in candidates.limit(LOOKED_UP + 1).collect()]
            some = blocks.where(F.col("term").isin(rest))
            if len(few) <= LOOKED_UP:
                known = sorted(few)

                @F.pandas_udf("boolean")
                def holds(lo: pd.Series, hi: pd.Series) -> pd.Series:
                    return pd.Series([(i := bisect_left(known, x)) < len(known) and known[i] <= y for x, y in zip(lo, hi, strict=True)])

                wanted = meta.where(F.col("term").isin(rest)).where(holds("lo", "hi")).select(F.col("seg").alias("w_seg"), F.col("block").alias("w_block"))
                some = some.join(wanted, (F.col("seg") == F.col("w_seg")) & (F.col("block") == F.col("w_block")), "left_semi")
            counted += some.count()
            parts = parts.union(postings(some).join(candidates.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left_semi"))
        self.read = counted
        # added up in the order of terms, so that equal postings give equal sums
        each = F.array_sort(F.collect_list(F.struct("term", "part")))
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x["part"])
        best = parts.groupBy("id").agg(total.alias("raw_score")).orderBy(F.desc("raw_score"), "id").limit(k)
        out = self.spark.createDataFrame(best.collect(), "id string, raw_score double")  # k rows
        for done in kept:
            done.unpersist()
        return out


def _summed(stats: DataFrame) -> DataFrame:
    return stats.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "n", "total")))
