"""Vectors in a table partitioned by cell, searched by probing cells and rescoring what can still matter.

A vector belongs to the cell of the centroid nearest to its direction. What is left of the
direction is coded in one byte for every few components (product quantization), and the length of
what the code misses is stored with it. So a code gives not only an estimate of a similarity
but a range that holds it: within the cells probed nothing is lost, since every row whose range
reaches the k-th lower end is scored again on its own vector. With all cells probed a search is exact.

Points come in segments, as in the postings index: an upsert writes one, which also lists
the ids that it takes the place of; every FAN segments of a level become one of the next.
Centroids and codes are fitted on a bounded sample (SAMPLE rows, the least hashes of ids); all rows
are indexed. They stay as the first points gave them until rebuild().

Null vectors, zero ones, ones of another length than the index's and ones that hold null or
non-finite components are no hits and are not stored. Points without an id are left out; of several of one id
in an upsert one stays, that of the greatest vector, compared component by component.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators import retrieval
from recollect.sources.store import FAN, Store
from recollect.workers import ship

#: Rows that centroids and codes are fitted on; cells at most; components that share a code byte.
SAMPLE, CELLS, WIDTH = 65_536, 4_096, 4
#: Candidates whose ids are broadcast for the last scores; more are joined by a shuffle.
LOOKED_UP = 20_000
_POINTS = "id string, vector array<double>, payload string, code binary, norm double, miss double, cell int"
_MODEL = "part int, k int, vector array<double>"


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of the rows by Lloyd's rounds, from evenly spaced distinct rows on."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centers = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centers))
        centers[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, rows: int = 2_048) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + rows] @ centers.T - half, axis=1) for i in range(0, len(x), rows)] or [np.zeros(0, int)])


class Model:
    """Centroids of cells, and for each part of the components the vectors that its codes stand for."""

    def __init__(self, centers: np.ndarray, books: list[np.ndarray]):
        self.centers, self.books = centers, books
        self.parts = np.array_split(np.arange(centers.shape[1]), len(books))

    def coded(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes (one column a part) and how far each direction lies from what its code stands for."""
        cells = _nearest(units, self.centers)
        rest = units - self.centers[cells]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            rest[:, p] -= b[codes[:, j]]
        return cells, codes, np.sqrt((rest**2).sum(1)) + 1e-9

    def probed(self, query: np.ndarray, probe: int | None) -> list[int]:
        order = np.argsort(-(self.centers @ query), kind="stable")
        return [int(c) for c in order[:probe]]


class VectorIndex:
    """Points (id string, vector array<double>, payload string) below a root; a vector store with cells."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int):
        self.spark, self.root, self.dimensions, self.log = spark, root.rstrip("/"), dimensions, Store(spark, root)
        self._models: dict[str, Model] = {}

    # writing

    def upsert(self, points: DataFrame) -> None:
        """Points take the place of those of the same ids, even where the new vector is no hit."""
        payload = F.col("payload").cast("string") if "payload" in points.columns else F.lit(None).cast("string")
        rows = points.where("id is not null").select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"), payload.alias("payload"))
        # one of several rows of an id, the same in every run
        rows = rows.groupBy("id").agg(F.max(F.struct("vector", "payload")).alias("p")).select("id", "p.vector", "p.payload")
        self._append(rows, rows.select("id"))

    def delete(self, ids: list[str]) -> None:
        self.remove(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def remove(self, ids: DataFrame) -> None:
        self._append(None, ids.select("id"))

    def stored(self) -> DataFrame:
        """id and payload of all points."""
        return self._live(self._segments()).select("id", "payload")

    def rebuild(self) -> None:
        """Fit cells and codes anew on all points and write these as one segment."""

        def made(base: dict) -> dict[str, list[dict]]:
            live = self._live(base["tables"].get("segments", []))
            model = self._fitted(live)
            return {"model": [model], "segments": [self._write(live, None, model, 1)]} if model else {}

        self.log.change(made)

    def count(self) -> int:
        return self._live(self._segments()).count()

    def _append(self, rows: DataFrame | None, gone: DataFrame) -> None:
        written: dict[str, dict] = {}

        def made(base: dict) -> dict[str, list[dict]]:
            models = base["tables"].get("model", [])
            fitted = models or ([m] if rows is not None and (m := self._fitted(rows)) else [])
            # another writer's model may have come in between: then points are coded anew by that
            at = fitted[0]["at"] if fitted else ""
            if at not in written:
                written[at] = self._write(rows if fitted else None, gone, fitted[0] if fitted else None, 0)
            return {"segments": [*base["tables"].get("segments", []), written[at]]} | ({"model": fitted} if fitted and not models else {})

        self.log.change(made)
        if max(Counter(s["level"] for s in self._segments()).values()) >= FAN:
            self.log.change(self._merged)

    def _valid(self, rows: DataFrame) -> DataFrame:
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0)
        return rows.where(F.col("vector").isNotNull() & (F.size("vector") == self.dimensions)).where(fine)

    def _fitted(self, rows: DataFrame) -> dict | None:
        """Fit a model on a sample: about as many cells as the root of the number of rows. None without a usable vector."""
        ship(self.spark)
        valid = self._valid(rows)
        n = valid.count()
        if n == 0:
            return None
        cells = max(1, min(CELLS, round(math.sqrt(n))))
        sample = valid.select(V.l2_normalized("vector").alias("vector"), F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE)
        parts = max(1, math.ceil(self.dimensions / WIDTH))
        at, spread = uuid.uuid4().hex, np.array_split(np.arange(self.dimensions), parts)

        def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
            c = kmeans(np.stack(pdf.sort_values(["h", "id"]).vector.to_numpy()).astype(float), cells)
            return pd.DataFrame({"part": -1, "k": range(len(c)), "vector": list(c)})

        # one task each over the bounded sample
        self._put(sample.withColumn("part", F.lit(-1)).groupBy("part").applyInPandas(centroids, _MODEL), f"model/{at}/cells")
        centers = self._vectors(f"model/{at}/cells")[-1]

        def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in filter(len, batches):
                x = np.stack(b.vector.to_numpy()).astype(float)
                x = x - centers[_nearest(x, centers)]
                yield pd.concat([pd.DataFrame({"part": j, "vector": list(x[:, p]), "id": b.id}) for j, p in enumerate(spread)])

        def book(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            c = kmeans(np.stack(pdf.sort_values("id").vector.to_numpy()).astype(float), 256)
            return pd.DataFrame({"part": key[0], "k": range(len(c)), "vector": list(c)})

        by_part = sample.select("id", "vector").mapInPandas(rests, "part int, vector array<double>, id string")
        self._put(by_part.groupBy("part").applyInPandas(book, _MODEL), f"model/{at}/codes")
        return {"at": at, "level": 0}

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.root}/{name}")

    def _vectors(self, name: str) -> dict[int, np.ndarray]:
        """Vectors of a model's parts; at most CELLS centroids, or 256 for each part."""
        rows = self.spark.read.schema(_MODEL).parquet(f"{self.root}/{name}").orderBy("part", "k").collect()
        return {p: np.array([r["vector"] for r in rows if r["part"] == p], dtype=float) for p in sorted({r["part"] for r in rows})}

    def _model(self, entry: dict) -> Model:
        at = entry["at"]
        if at not in self._models:
            books = self._vectors(f"model/{at}/codes")
            self._models[at] = Model(self._vectors(f"model/{at}/cells")[-1], [books[p] for p in sorted(books)])
        return self._models[at]

    def _write(self, rows: DataFrame | None, gone: DataFrame | None, entry: dict | None, level: int) -> dict:
        at = uuid.uuid4().hex
        if rows is not None:
            ship(self.spark)
            model = self._model(entry)

            def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in filter(len, batches):
                    x = np.stack(b.vector.to_numpy()).astype(float)
                    # scaled first, so that the squares of great or tiny components stay finite
                    top = np.abs(x).max(1)
                    norm = top * np.sqrt(((x / top[:, None]) ** 2).sum(1))
                    cells, codes, miss = model.coded(x / top[:, None] / (norm / top)[:, None])
                    yield b.assign(code=[c.tobytes() for c in codes], norm=norm, miss=miss, cell=cells.astype(np.int32))

            points = self._valid(rows).select("id", "vector", "payload").mapInPandas(coded, _POINTS)
            # by ranges of cell and id: few files a cell, and a cell of many points spreads over tasks
            points.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(f"{self.root}/points/{at}")
        ids = gone if gone is not None else self.spark.createDataFrame([], "id string")
        ids.select("id").write.parquet(f"{self.root}/gone/{at}")
        return {"at": at, "level": level, "points": rows is not None}

    def _merged(self, base: dict) -> dict[str, list[dict]]:
        """The segments after those of the lowest full level have become one."""
        segments = base["tables"].get("segments", [])
        for level in sorted({s["level"] for s in segments}):
            own = [s for s in segments if s["level"] == level]
            if len(own) >= FAN:
                model = base["tables"].get("model", [])
                rows = self._live(own) if model else None
                new = self._write(rows, self._gone(own).select("id").distinct(), model[0] if model else None, level + 1)
                first = segments.index(own[0])
                return {"segments": [*segments[:first], new, *segments[first + len(own) :]]}
        return {}

    # reading

    def _segments(self) -> list[dict]:
        return self.log.current()["tables"].get("segments", [])

    def _gone(self, segments: list[dict]) -> DataFrame:
        out = self.spark.createDataFrame([], "id string, seg int")
        for i, s in enumerate(segments):
            out = out.union(self.spark.read.schema("id string").parquet(f"{self.root}/gone/{s['at']}").withColumn("seg", F.lit(i)))
        return out

    def _live(self, segments: list[dict], cells: list[int] | None = None) -> DataFrame:
        """Points that no later segment has removed; only the folders of `cells` are read."""
        out = self.spark.createDataFrame([], _POINTS).withColumn("seg", F.lit(0))
        for i, s in enumerate(segments):
            if s["points"]:
                rows = self.spark.read.schema(_POINTS).parquet(f"{self.root}/points/{s['at']}").withColumn("seg", F.lit(i))
                out = out.union(rows if cells is None else rows.where(F.col("cell").isin(cells)))
        if len(segments) < 2:
            return out
        gone = self._gone(segments).groupBy(F.col("id").alias("g_id")).agg(F.max("seg").alias("g_seg"))
        return out.join(gone, (F.col("id") == F.col("g_id")) & (F.col("seg") < F.col("g_seg")), "left_anti")

    def ranges(self, query: list[float], probe: int | None = None, cosine: bool = False) -> DataFrame:
        """id, seg and payload of the points in the `probe` best cells (all, if None), with lo and hi, between which the similarity lies."""
        return self._ranges(self.log.current()["tables"], query, probe, cosine)

    def _ranges(self, tables: dict, query: list[float], probe: int | None, cosine: bool) -> DataFrame:
        q = np.array(query, dtype=float)
        size = float(np.sqrt((q**2).sum()))
        if not tables.get("model") or len(q) != self.dimensions or not math.isfinite(size) or size == 0:
            return self.spark.createDataFrame([], "id string, seg int, payload string, lo double, hi double")
        model = self._model(tables["model"][0])
        cells = None if probe is None else model.probed(q, probe)
        at = model.centers @ q
        table = np.zeros((len(model.books), 256))
        for j, (p, b) in enumerate(zip(model.parts, model.books, strict=True)):
            table[j, : len(b)] = b @ q[p]
        parts = np.arange(len(model.books))

        @F.pandas_udf("lo double, hi double")
        def range_of(cell: pd.Series, code: pd.Series, norm: pd.Series, miss: pd.Series) -> pd.DataFrame:
            if len(cell) == 0:
                return pd.DataFrame({"lo": [], "hi": []}, dtype=float)
            codes = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(code), -1)
            middle = at[cell.to_numpy()] + table[parts, codes].sum(1)
            off, scale = size * miss.to_numpy() + 1e-12 * size, norm.to_numpy()
            scale = np.full(len(scale), 1 / size) if cosine else scale
            return pd.DataFrame({"lo": (middle - off) * scale, "hi": (middle + off) * scale})

        rows = self._live(tables.get("segments", []), cells).select("id", "seg", "payload", "cell", "code", "norm", "miss")
        return rows.select("id", "seg", "payload", range_of("cell", "code", "norm", "miss").alias("r")).select("id", "seg", "payload", "r.lo", "r.hi")

    def nearest(self, query: list[float], top_k: int, probe: int | None = None, cosine: bool = False, gate: Callable[[DataFrame], DataFrame] | None = None, slack: float = 1e-4) -> DataFrame:
        """id, payload and sim of every point, let through by the gate, that can be among the best `top_k` above 0, or within `slack` below.

        More rows than `top_k` are left where similarities lie close, so that a caller can
        round them and settle ties by its own key. The gate gets id, seg, payload, lo and hi and may drop rows and add columns.
        """
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        tables = self.log.current()["tables"]
        near = self._ranges(tables, query, probe, cosine).where("hi > 0")
        rows = (gate(near) if gate else near).select("id", "seg", "lo", "hi")
        last = rows.orderBy(F.desc("lo")).limit(top_k).agg(F.when(F.count("*") == top_k, F.min("lo")).alias("last"))
        # one row of statistics
        wanted = rows.join(F.broadcast(last)).where(F.col("last").isNull() | (F.col("hi") >= F.col("last") - slack)).select("id", "seg").distinct()
        few = wanted.limit(LOOKED_UP + 1).collect()
        small = len(few) <= LOOKED_UP
        chosen = self.spark.createDataFrame([(r["id"], r["seg"]) for r in few], "c_id string, c_seg int") if small else wanted.toDF("c_id", "c_seg")
        cells = self._model(tables["model"][0]).probed(np.array(query, dtype=float), probe) if tables.get("model") and probe and len(query) == self.dimensions else None
        points = self.spark.createDataFrame([], "id string, vector array<double>, payload string, seg int")
        for i, s in enumerate(tables.get("segments", [])):
            if s["points"]:
                own = self.spark.read.schema(_POINTS).parquet(f"{self.root}/points/{s['at']}")
                points = points.union((own if cells is None else own.where(F.col("cell").isin(cells))).select("id", "vector", "payload", F.lit(i).alias("seg")))
        hits = points.join(F.broadcast(chosen) if small else chosen, (F.col("id") == F.col("c_id")) & (F.col("seg") == F.col("c_seg")))
        q = F.array(*(F.lit(float(x)) for x in query))
        sim = V.cosine("vector", q) if cosine else V.dot("vector", q)
        return hits.select("id", "payload", sim.alias("sim")).where("sim > 0")

    def search(self, query: list[float], top_k: int = 5, probe: int | None = None) -> DataFrame:
        """id, score and payload of the best by cosine, rounded to six digits, ties to the smaller id."""
        hits = self.nearest(query, top_k, probe, cosine=True)
        return hits.select("id", F.round("sim", 6).alias("score"), "payload").where("score > 0").orderBy(F.desc("score"), "id").limit(top_k)


def sync(index: VectorIndex, chunks: DataFrame) -> tuple[int, int]:
    """Bring an index up to the chunks: those that are new or were changed go in, those no longer there go out. How many of each.

    A point's payload is the time of its chunk's last change, so ids and times are all that is
    compared. A chunk whose vector can be no hit is looked at again each time.
    """
    have = index.stored().toDF("h_id", "h_stamp")
    stamped = chunks.where("embedding is not null").select("id", F.col("embedding").alias("vector"), F.col("updated_at").cast("string").alias("payload"))
    new = stamped.join(have, (F.col("id") == F.col("h_id")) & F.col("payload").eqNullSafe(F.col("h_stamp")), "left_anti")
    there = chunks.where("embedding is not null").select(F.col("id").alias("t_id"))
    gone = have.join(there, F.col("h_id") == F.col("t_id"), "left_anti").select(F.col("h_id").alias("id"))
    n_gone, n_new = gone.count(), new.count()
    if n_gone:
        index.remove(gone)
    if n_new:
        index.upsert(new)
    return n_new, n_gone


def semantic_hits(index: VectorIndex, chunks: DataFrame, documents: DataFrame, ledger: DataFrame | None, vector: list[float], top_k: int, probe: int | None = None, stamped: bool = False) -> DataFrame:
    """As retrieval.semantic_hits(), with vectors from an index of the chunks' ids instead of a scan of all chunks.

    stamped: only points whose payload is the time of their chunk's last change, as sync() leaves it, are hits.
    """
    about = chunks.select("id", "document_id", "heading_path", "source_type", *([F.col("updated_at").cast("string").alias("stamp")] if stamped else []))

    def gate(near: DataFrame) -> DataFrame:
        rows = near.join(about, "id")
        return retrieval.gated_chunks(rows.where(F.col("stamp").eqNullSafe(F.col("payload"))) if stamped else rows, documents, ledger)

    hits = index.nearest(vector, top_k, probe, gate=gate).select("id", "sim")
    rows = retrieval.gated_chunks(about.join(hits, "id"), documents, ledger)
    best = rows.withColumn("score", F.round("sim", 4)).orderBy(F.desc("score"), "id").limit(top_k)
    return retrieval.contents(best, chunks)
