"""Identity: hashes and ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import _c, normalized_path


def content_hash(x: Column | str) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def document_id(path: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(content_hash(path), 1, 24))


def chunk_id(document: Column | str, index: Column | str) -> Column:
    return F.concat(_c(document), F.lit("_chunk_"), _c(index).cast("string"))


def vector_point_id(chunk: Column | str) -> Column:
    """A UUID from the first half of the chunk id's hash."""
    return F.regexp_replace(F.substring(content_hash(chunk), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def source_id(source_type: Column | str, path: Column | str) -> Column:
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    return F.concat(kind, F.lit(":"), F.substring(content_hash(normalized_path(path)), 1, 32))


def exchange_path(path: Column | str, exchange: Column | str) -> Column:
    """The path, with the exchange number where there is one."""
    return F.when(_c(exchange).isNotNull(), F.concat(_c(path), F.lit("::exchange_"), _c(exchange).cast("string"))).otherwise(_c(path))
