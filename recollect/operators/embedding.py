"""Hashing embedder as a plan of narrow steps: a text's vector follows from its own row, so nothing is shuffled."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from recollect.functions.text import TOKEN
from recollect.schemas import EMBEDDING_DIMENSIONS
from recollect.workers import ship, slices

#: Tokens whose components a worker holds.
PLACES = 200_000


def bucket_of(token: str, dimensions: int = EMBEDDING_DIMENSIONS) -> tuple[int, float]:
    """A token's component and sign, from its 16-byte BLAKE2b digest."""
    d = hashlib.blake2b(token.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big") % dimensions, 1.0 if d[8] % 2 == 0 else -1.0


def bucket_of_sha2(token: str, dimensions: int = EMBEDDING_DIMENSIONS) -> tuple[int, float]:
    """The same from a SHA-256 digest: its first seven hex digits give the component, the eighth the sign."""
    d = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big")
    return (d >> 4) % dimensions, 1.0 if d % 2 == 0 else -1.0


def embed_text(text: str, dimensions: int = EMBEDDING_DIMENSIONS) -> list[float]:
    """The vector of one query text, on the driver."""
    if not text.strip():
        raise ValueError("text cannot be empty")
    v = [0.0] * dimensions
    for t in re.findall(r"\w+", text):
        i, sign = bucket_of(t.lower(), dimensions)
        v[i] += sign
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def _tokens(docs: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """key and the tokens of each text, cut out before they are lower-cased; a null text has none."""
    words = F.transform(F.regexp_extract_all(F.concat(F.lit(prefix), F.col(text)), F.lit(TOKEN), F.lit(0)), F.lower)
    return docs.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("tokens"))


class _Places(dict):
    """Tokens' components, twice, plus one where the sign is negative; forgotten once they are many."""

    def __init__(self, dimensions: int, bucket: Callable[[str, int], tuple[int, float]]):
        super().__init__()
        self.dimensions, self.bucket = dimensions, bucket

    def __missing__(self, token: str) -> int:
        cell, sign = self.bucket(token, self.dimensions)
        self[token] = at = 2 * cell + (sign < 0)
        return at

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > PLACES:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return at >> 1, 1.0 - 2.0 * (at & 1)


def _embedded(docs: DataFrame, key: str, text: str, prefix: str, dimensions: int, bucket: Callable[[str, int], tuple[int, float]]) -> DataFrame:
    """Nothing is shuffled: a slice's vectors are summed at once, its distinct tokens hashed unless they are known from those before."""
    ship(docs)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dimensions, bucket)
        for b in (part for batch in batches for part in slices(batch)):
            n, words = b.num_rows, b.column(1)
            coded = pc.list_flatten(words).dictionary_encode()
            cell, sign = places.of(coded.dictionary.to_pylist())
            code, row = coded.indices.to_numpy(), pc.list_parent_indices(words).to_numpy()
            v = np.bincount(row * dimensions + cell[code], sign[code], n * dimensions).reshape(n, dimensions)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v = v / np.where(norm > 0, norm, 1.0)
            ends = pa.array(np.arange(0, v.size + 1, dimensions, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=[key, "embedding"])

    words = _tokens(docs, key, text, prefix)
    return words.mapInArrow(vectors, StructType([words.schema[0], StructField("embedding", ArrayType(DoubleType()))]))


def embed(docs: DataFrame, key: str = "id", text: str = "content", prefix: str = "", dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """key and embedding of each row; `prefix` is put before each text ("query: ", "passage: ").

    A null text, or one without tokens, gives zeros.
    """
    return _embedded(docs, key, text, prefix, dimensions, bucket_of)


def embed_sha2(docs: DataFrame, key: str = "id", text: str = "content", prefix: str = "", dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """The same with SHA-256 digests."""
    return _embedded(docs, key, text, prefix, dimensions, bucket_of_sha2)
