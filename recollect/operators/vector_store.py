"""Pluggable embedders and vector stores."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators import embedding
from recollect.schemas import EMBEDDING_DIMENSIONS
from recollect.workers import ship


class Embedder(Protocol):
    """Texts to vectors of one length; it is pickled and runs on Arrow batches in workers."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """The built-in embedder."""

    name, dimensions = "hashing", EMBEDDING_DIMENSIONS

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [embedding.embed_text(t) if t.strip() else [0.0] * self.dimensions for t in texts]


def register(spark: SparkSession, embedder: Embedder, name: str = "embed"):
    """Register an embedder as a SQL function string -> array<double>; a null text counts as empty. Returns the function."""
    ship(spark)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(["" if t is None else t for t in texts]), dtype=object)

    spark.udf.register(name, embed)
    return embed


def register_checked(spark: SparkSession, embedder: Embedder):
    """The same, with errors as values: a text gives a struct of vector and error, one of them null.

    A batch that fails is tried again text by text, so that one text's failure is its own.
    """
    ship(spark)

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return embedder.embed([text])[0], None
        except Exception as e:
            return None, str(e)[:200] or type(e).__name__

    @F.pandas_udf("vector array<double>, error string")
    def embed(texts: pd.Series) -> pd.DataFrame:
        own = ["" if t is None else t for t in texts]
        try:
            rows = [(v, None) for v in embedder.embed(own)]
        except Exception:
            rows = [one(t) for t in own]
        return pd.DataFrame({"vector": pd.Series([v for v, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

    return embed


class VectorStore(Protocol):
    def upsert(self, points: DataFrame) -> None: ...

    def search(self, query: list[float], top_k: int = 5) -> DataFrame: ...

    def delete(self, ids: list[str]) -> None: ...

    def count(self) -> int: ...


class FrameVectorStore:
    """Points (id string, vector array<double>, payload string) as a DataFrame.

    Null or zero vectors, and ones of another length than the query, are no hits. With `rounded`,
    scores are rounded to six digits before those of 0 or less go; else all scores stay. Of
    several points of one id in an upsert, the one of the greatest payload counts. Ties go to the
    smaller id.
    """

    SCHEMA = "id string, vector array<double>, payload string"

    def __init__(self, spark: SparkSession, rounded: bool = True):
        self.points, self.rounded = spark.createDataFrame([], self.SCHEMA), rounded

    def upsert(self, points: DataFrame) -> None:
        new = points.where("id is not null").select("id", "vector", "payload").groupBy("id").agg(F.max_by("vector", F.coalesce("payload", F.lit(""))).alias("vector"), F.max("payload").alias("payload"))
        old = self.points.join(new.select(F.col("id").alias("n_id")), F.col("id") == F.col("n_id"), "left_anti")
        self.points = old.unionByName(new)

    def search(self, query: list[float], top_k: int = 5) -> DataFrame:
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        fine = self.points.where(F.col("vector").isNotNull() & (F.size("vector") == len(query)) & F.exists("vector", lambda x: x != 0))
        q = F.array(*(F.lit(float(x)) for x in query))
        scored = fine.withColumn("score", V.cosine("vector", q))
        if self.rounded:
            scored = scored.withColumn("score", F.round("score", 6)).where("score > 0")
        return scored.select("id", "score", "payload").orderBy(F.desc("score"), "id").limit(top_k)

    def delete(self, ids: list[str]) -> None:
        self.points = self.points.where(~F.col("id").isin(ids))

    def count(self) -> int:
        return self.points.count()
