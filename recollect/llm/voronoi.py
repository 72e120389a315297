"""Exact top-k search by inner product (operator 12): a Voronoi join of queries and data.

Vectors become whole numbers, floor(64 * x). Equal vectors are one class with the least k + 1
ids, all that a query and its ties can use. Pivots are some of the classes; each class belongs
to the cell of its nearest pivot, at distance r. Cells are cut by range into rings of bounded
size, of which the summary is the largest r. For a query q, a pivot p and a class x of its
cell, q.x <= q.p + |q| r. The pivots are data themselves, so a query's (k + 1)th best among
them is a lower bound of its (k + 1)th best. A ring goes to a block of queries only if its bound
reaches that for some query of the block. Blocks and rings are packed as bytes and meet in
tasks of bounded size; a task visits its rings in falling order of their bounds, and passes by
those that the best found so far rule out. Partial results are merged by query.

Sums are exact: in doubles while they stay below 2^53, in whole numbers of any size beyond.
Scores beyond +-(2^63 - 1) are cut to these ends.

Edge cases: vectors that are null or empty, or have components that are null or not finite after
the product by 64, neither ask nor answer; a query's candidates are the vectors of its length;
null ids take no part; rows of the same id and the same vector are one row, and no row is a
candidate for its own id; fewer than k candidates give all of them; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.llm.common import release, stored, table
from recollect.workers import ship

#: Parts into which the copies of a vector are split before their least ids meet.
SALTS = 64
_LEAST, _MOST = -(2**63 - 1), 2**63 - 1  # of scores; both can be negated


@dataclass(frozen=True)
class Cells:
    """Classes wanted in a cell, most cells, pivots that bound the k-th score, classes of a ring, queries of a block, rings of a task."""

    wanted: int = 2000
    most: int = 1024
    pivots: int = 512
    ring: int = 2048
    block: int = 512
    rings: int = 64


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all rows of x (whole numbers as doubles) as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62 and max(np.abs(q).max(), np.abs(x).max()) < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [[[int(c) for c in row] for row in a.tolist()] for a in (q, x)]
    return np.array([[max(_LEAST, min(_MOST, sum(a * b for a, b in zip(u, v, strict=True)))) for v in whole[1]] for u in whole[0]], np.int64).reshape(len(q), len(x))


def _packed(x: np.ndarray) -> bytes:
    """A type letter, then the components in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "b" if most < 128 else "h" if most < 2**15 else "i" if most < 2**31 else "d"
    return kind.encode() + x.astype(f"<{dict(b='i1', h='i2', i='i4', d='f8')[kind]}").tobytes()


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    kind = dict(b="<i1", h="<i2", i="<i4", d="<f8")[chr(data[0])]
    return np.frombuffer(data, kind, offset=1).reshape(-1, dim).astype(np.float64)


def _norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=1.0)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


class Pivots:
    """The pivots by length of vector; the first `cells` of them, as far as they have that length, own cells."""

    def __init__(self, rows: list[list[float]], cells: int):
        by: dict[int, list[list[float]]] = {}
        own: dict[int, int] = {}
        for i, v in enumerate(rows):
            by.setdefault(len(v), []).append(v)
            own[len(v)] = own.get(len(v), 0) + (i < cells)
        self.all = {d: np.array(x, np.float64) for d, x in by.items()}
        self.own = {d: x[: own[d]] for d, x in self.all.items()}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance from the cell's pivot; a length without cells has one, -1, around the origin."""
        p = self.own.get(x.shape[1])
        if p is None or not len(p):
            return np.full(len(x), -1), _norms(x)
        cell = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
        return cell, _norms(x - p[cell])


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """h, v, ids: each distinct vector of whole numbers with its least k + 1 ids."""
    place = F.row_number().over(Window.partitionBy("h", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id"))
    few = vectors.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("h").agg(F.first("v").alias("v"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles without a fraction) and h, a 256-bit hash of v, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c * 64).alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # adding zero makes -0.0 zero; decimals have no exponent, and beyond 2^62 a double has no fraction
    floor = F.transform("v", lambda c: F.when(F.abs(c) < 2.0**62, F.floor(c).cast("double")).otherwise(c) + F.lit(0.0))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine).select("vec_id", floor.alias("v")).withColumn("h", F.unhex(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))


def _celled(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """Adds dim, cell and r."""
    at = rows.columns.index("v")
    schema = StructType([*rows.schema.fields]).add("dim", "integer").add("cell", "integer").add("r", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = b.column(at).flatten().to_numpy(zero_copy_only=False), b.column(at).offsets.to_numpy()
            sizes, cell, r = np.diff(ends), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            starts = ends[:-1] - ends[0]
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                cell[own], r[own] = pivots.nearest(values[starts[own][:, None] + np.arange(dim)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(r)], [*b.schema.names, "dim", "cell", "r"])

    return rows.mapInArrow(run, schema)


def _rings(rows: DataFrame, count: int, size: int, by_cell: bool) -> DataFrame:
    """Packs rows, ordered by dim, cell and r, into runs of at most `size` rows of one length (and cell, if by_cell).

    Ranges are dealt by the same order, so a cell of any size is split. For each run: part, dim,
    cell, n, r (the largest), hs, ids and data.
    """
    order = ["dim", "cell", "r", "h"]
    dealt = rows.repartitionByRange(max(1, -(-count // (4 * size))), *order).sortWithinPartitions(*order).select("dim", "cell", "r", "h", "v", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []
        key = None

        def out() -> pd.DataFrame:
            v = np.array([x[2] for x in kept], np.float64)
            return pd.DataFrame({"dim": [key[0]], "cell": [kept[0][4]], "n": [len(kept)], "r": [max(x[0] for x in kept)], "hs": [[x[1] for x in kept]], "ids": [[list(x[3]) for x in kept]], "data": [_packed(v)]})

        for pdf in batches:
            for dim, cell, r, h, v, ids in pdf.itertuples(index=False):
                now = (dim, cell if by_cell else None)
                if kept and (now != key or len(kept) == size):
                    yield out()
                    kept = []
                key = now
                kept.append((r, h, v, ids, cell))
        if kept:
            yield out()

    packs = dealt.mapInPandas(run, "dim int, cell int, n int, r double, hs array<binary>, ids array<array<long>>, data binary")
    return packs.withColumn("part", F.monotonically_increasing_id())


def _best(scores: np.ndarray, first: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, by falling score and rising first id, of those that reach the row's floor; more only in a tie."""
    if scores.shape[1] > k:
        floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    rows, cols = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((first[cols], -scores[rows, cols], rows))
    return rows[order], cols[order]


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the (sorted) rows' entries are among their row's first k."""
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    return np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows)))) < k


def bounds(q: np.ndarray, pivots: Pivots, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query a lower bound of its k-th best score among classes, and the least r that reaches it in each cell."""
    p = pivots.all.get(q.shape[1], np.zeros((0, q.shape[1])))
    known = (q @ p.T)
    low = -np.partition(-known, k - 1, axis=1)[:, k - 1] if len(p) >= k else np.full(len(q), -np.inf)
    own = known[:, : len(pivots.own.get(q.shape[1], ()))]
    size = _norms(q)[:, None]
    slack = 1e-9 * (np.abs(own) + size * _norms(p)[None, : own.shape[1]] + 1)
    with np.errstate(all="ignore"):
        need = (low[:, None] - slack - own) / size
    return low, np.where(np.isnan(need) | (size == 0), -np.inf, need)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, c: Cells = Cells()) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest for each row whose vec_id `every` divides."""
    spark = vectors.sparkSession
    ship(spark)
    rows, most = whole(vectors), k + 1
    data = stored(classes(rows, k), "classes")
    count = data.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count:
        release(data)
        return spark.createDataFrame([], schema)
    cells = max(1, min(c.most, count // c.wanted))
    pivots = Pivots([r["v"] for r in data.select("v").orderBy(F.xxhash64("h"), "h").limit(max(cells, c.pivots)).collect()], cells)
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = stored(asked.groupBy("h").agg(F.first("v").alias("v")).withColumn("ids", F.expr("array(0L)")), "queries")
    n = queries.count()
    rings = stored(_rings(_celled(data, pivots), count, c.ring, True), "rings")
    blocks = stored(_rings(_celled(queries, pivots), n, c.block, False), "blocks")
    release(data)
    release(queries)

    def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, dim, packed in zip(pdf["part"], pdf["dim"], pdf["data"], strict=True):
                _, need = bounds(_unpacked(packed, dim), pivots, most)
                least = need.min(0) if need.shape[1] else np.array([-np.inf])
                yield pd.DataFrame({"block": block, "need_dim": dim, "need_cell": np.arange(len(least)) if need.shape[1] else [-1], "least": least})

    wanted = blocks.select("part", "dim", "data").mapInPandas(needs, "block long, need_dim int, need_cell int, least double")
    # which rings each block needs, by their summaries alone; then the rings' bytes by their number
    pairs = rings.select("part", "dim", "cell", "r").join(wanted, (F.col("dim") == F.col("need_dim")) & (F.col("cell") == F.col("need_cell")) & (F.col("r") >= F.col("least"))).select(F.col("part").alias("ring"), "block")
    tasks = max(1, -(-(-(-count // c.ring) + cells) // c.rings))
    dealt = rings.join(pairs, F.col("part") == F.col("ring")).withColumn("bundle", F.pmod(F.xxhash64("part"), F.lit(tasks)).cast("int")).select("block", "bundle", "dim", "cell", "r", "ids", "data")
    every_bundle = blocks.select(F.col("part").alias("block"), "dim", "hs", "data").withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def solve(found: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if len(found) and len(block):
            row = block.iloc[0]
            dim = int(row["dim"])
            q = _unpacked(row["data"], dim)
            low, need = bounds(q, pivots, most)
            floor = np.full(len(q), _LEAST, np.int64)
            # rings that exceed what is needed by most come first
            slack = np.array([np.max(r - need[:, cell]) if cell >= 0 else np.inf for r, cell in zip(found["r"], found["cell"], strict=True)])
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            ids: list[np.ndarray] = []
            met, size = 0, _norms(q)
            for at in np.argsort(-slack, kind="stable"):
                ring = found.iloc[at]
                x = _unpacked(ring["data"], dim)
                cell = int(ring["cell"])
                if cell >= 0:
                    p = pivots.own[dim][cell]
                    most_score = q @ p + size * ring["r"]
                    live = ~(most_score + 1e-9 * (np.abs(q @ p) + size * (ring["r"] + _norms(p[None])[0]) + 1) < floor)
                else:
                    live = np.ones(len(q), bool)
                live = np.flatnonzero(live)
                if not len(live):
                    continue
                own = list(ring["ids"])
                first = np.array([i[0] for i in own], np.int64)
                scores = exact_products(q[live], x)
                r, col = _best(scores, first, most, floor[live])
                ids += own
                both = (np.concatenate([best[0], live[r]]), np.concatenate([best[1], scores[r, col]]), np.concatenate([best[2], met + col]))
                met += len(own)
                least = np.array([i[0] for i in ids], np.int64) if met == len(own) else np.concatenate([least, first])
                order = np.lexsort((least[both[2]], -both[1], both[0]))
                order = order[_first(both[0][order], most)]
                best = tuple(a[order] for a in both)
                full, times = np.unique(best[0], return_counts=True)
                last = np.cumsum(times) - 1
                done = times == most
                floor[full[done]] = best[1][last[done]]
            hs = list(row["hs"])
            return pd.DataFrame({"h": [hs[i] for i in best[0]], "ids": [ids[i] for i in best[2]], "score": best[1]}, dtype=object)
        return pd.DataFrame({"h": [], "ids": [], "score": []}, dtype=object)

    hits = dealt.groupBy("block", "bundle").cogroup(every_bundle.groupBy("block", "bundle")).applyInPandas(solve, "h binary, ids array<long>, score long")
    place = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("score"), F.col("ids")[0]))
    top = hits.withColumn("place", place).where(F.col("place") <= most).select(F.col("h").alias("top_h"), F.explode("ids").alias("vec_id"), "score")
    # the best k + 1 ids, of which a query leaves out its own; a query has one row, its results are in an array
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("minus"), "vec_id", "score"))), 1, most)
    lists = stored(top.groupBy("top_h").agg(nearest.alias("nearest")), "nearest")
    release(rings)
    release(blocks)
    both = asked.select("vec_id", "h").distinct().withColumnRenamed("vec_id", "query_id").join(lists, F.col("h") == F.col("top_h"))
    others = both.select("query_id", F.expr(f"slice(filter(nearest, x -> x.vec_id <> query_id), 1, {k})").alias("others"))
    return others.select("query_id", F.posexplode("others").alias("at", "other")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("other.vec_id").alias("vec_id"), F.col("other.score").alias("score"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with fine as (
    select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(64 * x::double))) = 0
), scores as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from fine q join fine c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scores
)
select * from ranked where rank <= 20
"""
