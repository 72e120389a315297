"""Approximate nearest neighbours (operator 3): a navigable small-world hierarchy per shard.

Equal vectors are one node, so copies neither crowd the graph nor hide other neighbours; each
node keeps the least `k` + 1 ids of its vector, which is all that a query's `k` nearest can use.
Nodes are dealt to shards by a hash. A shard's graph is built in one task of bounded size, as
flat arrays of neighbour numbers, level by level: nodes are numbered from the highest level
down, so that the nodes of a level are a prefix. Insertion and search treat many nodes at once
in numpy. Graphs are written to the shared folder. Queries are searched in blocks, each block
in every shard; hits are rescored in double precision on the original vectors and merged.

Edge cases: null or zero vectors, or ones with null or non-finite components, neither ask nor
answer; vectors of another length than the most frequent one take no part; null ids take no
part; rows of the same id and the same vector are one row, rows of one id with other vectors are
candidates each, but none for its own id; fewer than k candidates give all of them; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import stored, table
from recollect.workers import ship


#: Bound of the error of a cosine of single precision unit vectors.
ROUNDING = 2e-6


@dataclass(frozen=True)
class Graph:
    """Neighbours of a node, candidates kept in building and searching, nodes inserted at once, vectors of a shard, queries of a block."""

    links: int = 16
    build: int = 80
    search: int = 128
    batch: int = 512
    shard: int = 12_000
    block: int = 4096


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (sorted, -1: none) at most `most`: those nearer to the node than to any chosen before, then the nearest rest."""
    n, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, c), bool)
    nearest = np.full((n, c), -np.inf, np.float32)  # to any chosen one
    for j in range(c):
        ok = (ids[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (chosen.sum(1) < most)
        chosen[:, j] = ok
        np.maximum(nearest, np.where(ok[:, None], between[:, :, j], -np.inf), out=nearest)
    rank = np.where(ids < 0, 2 * c + np.arange(c), np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(ids, order, 1)


class SmallWorld:
    """The hierarchy over unit vectors x (float32), numbered from the highest level down."""

    def __init__(self, x: np.ndarray, counts: list[int], neighbours: list[np.ndarray]):
        self.x, self.counts, self.neighbours = x, counts, neighbours

    @staticmethod
    def order(n: int, links: int, seed: int = 7) -> tuple[np.ndarray, list[int]]:
        """An order of the nodes from the highest level down, and how many nodes each level has."""
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(links)).astype(int)
        perm = np.argsort(-level, kind="stable")
        top = int(level.max()) if n else 0
        return perm, [int((level >= k).sum()) for k in range(top + 1)]

    @classmethod
    def built(cls, x: np.ndarray, counts: list[int], g: Graph) -> "SmallWorld":
        self = cls(x, counts, [])
        self.neighbours = [np.full((n, g.links * (2 if k == 0 else 1)), -1, np.int32) for k, n in enumerate(counts)]
        for k in range(len(counts) - 1, -1, -1):
            done, n = 0, counts[k]
            while done < n:
                size = min(n - done, max(1, min(g.batch, done // 2)) if done >= 64 else 64)
                self._insert(k, done, done + size, g)
                done += size
        return self

    def _insert(self, k: int, low: int, high: int, g: Graph) -> None:
        x, links = self.x, self.neighbours[k]
        q, most = x[low:high], links.shape[1]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        near = _top(own, min(g.links, len(q)))
        sims, ids = np.take_along_axis(own, near, 1), near + low
        if low:
            found, s = self.search(q, g.build, k, low)
            ids, sims = np.hstack([found, ids]), np.hstack([s, sims])
        sims = np.where(np.isfinite(sims), sims, -np.inf)
        ids = np.where(np.isfinite(sims), ids, -1)
        o = _top(sims, min(g.build, sims.shape[1]))
        chosen = _diverse(x, np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1), g.links)
        links[low:high, : chosen.shape[1]] = chosen
        # links back: every node that gained some chooses anew among its old and new neighbours
        a = np.repeat(np.arange(low, high), chosen.shape[1])
        b = chosen.ravel()
        ok = b >= 0
        a, b = a[ok], b[ok]
        near = np.einsum("ij,ij->i", x[a], x[b])
        o = np.lexsort((-near, b))
        a, b = a[o], b[o]
        first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        keep = place < most
        nodes = b[start]
        new = np.full((len(nodes), most), -1, np.int32)
        new[(np.cumsum(first) - 1)[keep], place[keep]] = a[keep]
        for i in range(0, len(nodes), 1024):
            at = nodes[i : i + 1024]
            both = np.sort(np.hstack([links[at], new[i : i + 1024]]), axis=1)[:, ::-1]
            both = np.where(np.concatenate([np.zeros((len(at), 1), bool), both[:, 1:] == both[:, :-1]], axis=1), -1, both)
            sims = np.where(both >= 0, np.einsum("ijk,ik->ij", x[np.maximum(both, 0)], x[at]), -np.inf)
            o = _top(sims, sims.shape[1])
            links[at] = _diverse(x, np.take_along_axis(both, o, 1), np.take_along_axis(sims, o, 1), most)

    def search(self, q: np.ndarray, keep: int, level: int = 0, seen: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nodes found nearest to each query and their similarities: down to `level`, among its first `seen` nodes."""
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.counts) - 1, level, -1):
            if self.counts[k]:
                entry = self._walk(q, entry, k, 8, self.counts[k])[0][:, :4]
                entry = np.where(entry < 0, 0, entry)
        return self._walk(q, entry, level, keep, self.counts[level] if seen is None else seen)

    def _walk(self, q: np.ndarray, entry: np.ndarray, level: int, keep: int, seen: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for all queries at once, opening `step` nodes of each in a round."""
        x, links, n = self.x, self.neighbours[level], len(q)
        met = np.zeros((n, seen), bool)
        entry = np.minimum(entry, seen - 1)
        entry = np.sort(entry, axis=1)
        entry = np.where(np.concatenate([np.zeros((n, 1), bool), entry[:, 1:] == entry[:, :-1]], axis=1), -1, entry)
        ids = np.full((n, keep), -1, np.int64)
        sims = np.full((n, keep), -np.inf, np.float32)
        w = min(entry.shape[1], keep)
        ids[:, :w] = entry[:, :w]
        sims[:, :w] = np.where(entry[:, :w] >= 0, np.einsum("ijk,ik->ij", x[np.maximum(entry[:, :w], 0)], q), -np.inf)
        rows, cols = np.nonzero(entry >= 0)
        met[rows, entry[rows, cols]] = True
        opened = np.zeros((n, keep), bool)
        live = np.arange(n)
        while len(live):
            open_ = (ids[live] >= 0) & ~opened[live]
            some = open_.any(1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :step]  # candidates are sorted, nearest first
            real = np.take_along_axis(open_, pick, 1)
            r = np.repeat(np.arange(len(live)), pick.shape[1]).reshape(pick.shape)
            opened[live[r][real], pick[real]] = True
            got = np.where(real[:, :, None], links[np.maximum(np.take_along_axis(ids[live], pick, 1), 0)], -1).reshape(len(live), -1).astype(np.int64)
            got = np.where(got < seen, got, -1)
            got = np.sort(got, axis=1)
            got = np.where(np.concatenate([np.zeros((len(live), 1), bool), got[:, 1:] == got[:, :-1]], axis=1), -1, got)
            got = np.where((got >= 0) & ~met[live[:, None], np.maximum(got, 0)], got, -1)
            rows, cols = np.nonzero(got >= 0)
            met[live[rows], got[rows, cols]] = True
            s = np.full(got.shape, -np.inf, np.float32)
            s[rows, cols] = np.einsum("ij,ij->i", x[got[rows, cols]], q[live[rows]])
            all_ids, all_sims = np.hstack([ids[live], got]), np.hstack([sims[live], s])
            all_open = np.hstack([opened[live], np.zeros(got.shape, bool)])
            o = _top(all_sims, keep)
            ids[live], sims[live], opened[live] = (np.take_along_axis(a, o, 1) for a in (all_ids, all_sims, all_open))
        return ids, sims


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def found_by(world: SmallWorld, q: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and the nodes found for them. Where what is found ends in a tie, within rounding, the shard's other nodes of that tie are added."""
    found, sims = world.search(q, keep)
    n = len(world.x)
    last = np.where(found >= 0, sims, np.inf).min(1)
    tied = np.flatnonzero((last >= sims[:, min(k, sims.shape[1] - 1)] - ROUNDING) & ((found >= 0).sum(1) < n))
    rows, cols = np.nonzero(found >= 0)
    nodes = found[rows, cols]
    kept = ~np.isin(rows, tied)
    rows, nodes = [rows[kept]], [nodes[kept]]
    for at in (tied[i : i + 256] for i in range(0, len(tied), 256)):
        all_ = q[at] @ world.x.T
        least = np.partition(all_, max(0, n - k - 1), axis=1)[:, max(0, n - k - 1)]
        r, c = np.nonzero(all_ >= least[:, None] - ROUNDING)
        rows.append(at[r])
        nodes.append(c)
    return np.concatenate(rows), np.concatenate(nodes)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, g: Graph = Graph()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose vec_id `every` divides."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, rows = sizes[0]["d"], sizes[0]["n"]
    fine = fine.where(F.size("v") == dim)
    # the least k + 1 ids of each vector; the limit acts before the shuffle too
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = stored(fine.distinct().withColumn("place", place).where(F.col("place") <= k + 1), "vectors")
    shards = max(1, -(-rows // g.shard))
    nodes = few.where("place = 1").select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        perm, counts = SmallWorld.order(len(raw), g.links)
        raw, ids = raw[perm], pdf["vec_id"].to_numpy()[perm]
        world = SmallWorld.built(_unit(raw), counts, g)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "counts": [counts], "ids": [ids.astype("<i8").tobytes()], "vectors": [raw.astype("<f8").tobytes()], "links": [[a.astype("<i4").tobytes() for a in world.neighbours]]})

    graphs = stored(nodes.groupBy("shard").applyInPandas(build, "shard int, counts array<int>, ids binary, vectors binary, links array<binary>"), "graphs")
    asked = fine.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    n = asked.count()
    blocks = max(1, -(-n // g.block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "node": [], "score": []}
        if len(index) and len(queries):
            row = index.iloc[0]
            raw, ids = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim), np.frombuffer(row["ids"], "<i8")
            counts = list(row["counts"])
            world = SmallWorld(_unit(raw), counts, [np.frombuffer(b, "<i4").reshape(c, -1) for b, c in zip(row["links"], counts, strict=True)])
            for i in range(0, len(queries), g.batch):
                part = queries.iloc[i : i + g.batch]
                q = np.stack(part["v"].to_numpy()).astype(np.float64)
                r, at = found_by(world, _unit(q), k, g.search)
                score = cosine(q[r], raw[at])
                order = np.lexsort((ids[at], -score, r))
                r, at, score = r[order], at[order], score[order]
                start = np.searchsorted(r, r)  # of the query's own
                kept = np.arange(len(r)) - start <= k
                out["query_id"].append(part["vec_id"].to_numpy()[r[kept]])
                out["node"].append(ids[at[kept]])
                out["score"].append(score[kept])
        return pd.DataFrame({n: np.concatenate(a) if a else np.zeros(0) for n, a in out.items()})

    hits = stored(dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(look, "query_id long, node long, score double"), "hits")
    # from nodes to the ids of their vector, then the k nearest of each query
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    best = hits.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("query_id", "node", "score")
    ids = few.withColumn("h", F.xxhash64("v"))
    named = ids.join(ids.where("place = 1").select(F.col("v").alias("v1"), F.col("h").alias("h1"), F.col("vec_id").alias("node")), (F.col("h") == F.col("h1")) & (F.col("v") == F.col("v1"))).select("node", "vec_id")
    pairs = best.join(named, "node").where("query_id <> vec_id").select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
