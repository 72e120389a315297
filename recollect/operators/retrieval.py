"""Ranked retrieval: BM25, token overlap, cosine, the freshness gate, project and global search.

Every ranking has a total order. Texts and vectors are not shuffled: terms are counted and
similarities worked out within the row, before the gate's joins; corpus statistics come from one
aggregate over the counts, and contents are joined back for the best rows only.
"""

from __future__ import annotations

from collections.abc import Iterable

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.schemas import ACTIVE_STATUSES, BM25_B, BM25_K1, DEFAULT_BOOST, HIDDEN_LEDGER_STATUSES, SOURCE_BOOST

MAX_TOP_K = 50


def query_terms(query: str) -> list[str]:
    """Distinct lower-case tokens of a query, sorted so that plans and sums are stable."""
    return sorted(set(re.findall(r"\w+", query.lower())))


def check_top_k(top_k: int) -> None:
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be from 1 to {MAX_TOP_K}")


def _terms(terms: Iterable[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms)) if terms else F.expr("cast(array() as array<string>)")


def source_boost(source_type: Column | str) -> Column:
    c = F.col(source_type) if isinstance(source_type, str) else source_type
    out = F.lit(DEFAULT_BOOST)
    for k, v in SOURCE_BOOST.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def active(memory: DataFrame, include_inactive: bool = False) -> DataFrame:
    return memory if include_inactive else memory.where(F.col("status").isin(*ACTIVE_STATUSES))


def gated_chunks(chunks: DataFrame, documents: DataFrame, ledger: DataFrame | None, semi: bool = False) -> DataFrame:
    """Chunks with path and filename whose source is not hidden.

    The ledger is joined by path, which is no key: several visible rows of a path repeat its
    chunks. With `semi` each chunk comes once.
    """
    d = documents.select(F.col("id").alias("d_id"), "path", "filename")
    joined = chunks.join(d, F.col("document_id") == F.col("d_id")).drop("d_id")
    if ledger is None:
        return joined
    seen = ledger.select(F.col("source_path_or_alias").alias("l_path"), F.col("status").alias("ledger_status"))
    visible = F.col("ledger_status").isNull() | ~F.col("ledger_status").isin(*HIDDEN_LEDGER_STATUSES)
    if semi:
        state = seen.groupBy("l_path").agg(F.max(visible).alias("visible"))
        return joined.join(state, F.col("path") == F.col("l_path"), "left").where(F.coalesce("visible", F.lit(True))).drop("l_path", "visible")
    return joined.join(seen, F.col("path") == F.col("l_path"), "left").where(F.col("l_path").isNull() | visible).drop("l_path", "ledger_status")


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == F.lit(term)))


def term_counts(corpus: DataFrame, terms: list[str], text: Column | str = "content") -> DataFrame:
    """`corpus` with `_dl`, the number of tokens, and `_tf`, how often each term occurs; worked out within the row."""
    q = _terms(terms)
    own = corpus.withColumn("_toks", T.tokens(text)).withColumn("_dl", F.size("_toks")).withColumn("_hits", F.filter("_toks", lambda t: F.array_contains(q, t))).drop("_toks")
    # one reference for each term: a single one inside a lambda would be inlined and tokenize anew for each term
    return own.withColumn("_tf", F.array(*(_occurrences("_hits", t) for t in terms))).drop("_hits")


def bm25_scores(own: DataFrame, terms: list[str], k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Rows of term_counts() that hold a term, with `raw_score` (Okapi, distinct query terms).

    The number of rows, their average length and document frequencies cover all rows and come
    back as a single broadcast row; the rows themselves do not move.
    """
    stats = own.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), F.array(*(F.sum((F.col("_tf")[i] > 0).cast("long")) for i in range(len(terms)))).alias("_df"))
    # one row of statistics for any corpus: a join on true with a broadcast side of one row
    both = own.join(F.broadcast(stats))
    parts = F.zip_with("_tf", "_df", lambda f, df: F.when(f > 0, F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl")))).otherwise(F.lit(0.0)))
    score = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("raw_score", score).where("raw_score > 0").drop("_dl", "_tf", "_n", "_avgdl", "_df")


def bm25(corpus: DataFrame, terms: list[str], text: Column | str = "content", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    return bm25_scores(term_counts(corpus, terms, text), terms, k1, b)


def overlap(rows: DataFrame, terms: list[str], text: Column, scale: float = 1.0) -> DataFrame:
    """Rows sharing a token with the query, with `score`: the share of the query's tokens, times `scale`."""
    share = F.size(F.array_intersect(_terms(terms), T.tokens(text))) / F.lit(len(terms)) * F.lit(scale)
    return rows.withColumn("score", F.round(share, 4)).where("score > 0")


def _text(*columns: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))


def search_memories(memory: DataFrame, query: str, include_inactive: bool = False) -> DataFrame:
    """Token overlap on title and content."""
    return overlap(active(memory, include_inactive), query_terms(query), _text("title", "content"))


def search_chunks(chunks: DataFrame, documents: DataFrame, ledger: DataFrame | None, query: str, stripped: bool = False, semi: bool = False) -> DataFrame:
    """id, document_id, heading_path, source_type, path, filename and score of visible chunks, by BM25, boosted by source.

    `stripped` leaves out metadata blocks. Terms are counted before the gate, so no text is shuffled;
    contents() gives those of the best.
    """
    terms, text = query_terms(query), F.coalesce("content", F.lit(""))
    thin = term_counts(chunks.select("id", "document_id", "heading_path", "source_type", (T.strip_preamble_search(text) if stripped else text).alias("body")), terms, "body").drop("body")
    rows = bm25_scores(gated_chunks(thin, documents, ledger, semi), terms)
    return rows.withColumn("score", F.round(F.col("raw_score") * source_boost("source_type"), 6)).drop("raw_score")


def contents(best: DataFrame, chunks: DataFrame, stripped: bool = False) -> DataFrame:
    """The hits `best` (a bounded number, as by limit()) with the content of their chunks: one scan, no shuffle."""
    text = F.coalesce("content", F.lit("")) if stripped else F.col("content")
    texts = chunks.select(F.col("id").alias("x_id"), (T.strip_preamble_search(text) if stripped else text).alias("content"))
    return texts.join(F.broadcast(best), F.col("x_id") == F.col("id")).drop("x_id")


def chunk_title(with_filename: bool = True) -> Column:
    name = F.when(F.col("filename") != "", F.col("filename")) if with_filename else F.lit(None).cast("string")
    return F.coalesce(F.when(F.col("heading_path") != "", F.col("heading_path")), name, T.basename("path"))


PAYLOAD = ("title", "content", "source_path", "heading_path", "memory_type", "status", "score")


def semantic_hits(chunks: DataFrame, documents: DataFrame, ledger: DataFrame | None, vector: list[float], top_k: int, true_cosine: bool = False) -> DataFrame:
    """Persisted vectors by similarity above 0: the best chunks by id, path and similarity first, then their contents.

    Missing or undecodable vectors take no part. Rounding comes after the test for 0.
    """
    q = F.array(*(F.lit(float(x)) for x in vector))
    sim = V.cosine("embedding", q) if true_cosine else V.dot("embedding", q)
    thin = chunks.where("embedding is not null").select("id", "document_id", "heading_path", "source_type", sim.alias("sim")).where("sim > 0")
    rows = gated_chunks(thin, documents, ledger)
    best = rows.withColumn("score", F.round("sim", 4)).orderBy(F.desc("score"), "id").limit(top_k)
    return contents(best, chunks)


def project_search(chunks: DataFrame, documents: DataFrame, ledger: DataFrame | None, memory: DataFrame, query: str, top_k: int = 5, vector: list[float] | None = None) -> DataFrame:
    """Semantic hits alone if there are any, else token overlap on memory and BM25 on chunks.

    One plan: the lexical branch is joined to a flag row that says whether semantic hits exist.
    """
    check_top_k(top_k)
    terms = query_terms(query)
    mem = search_memories(memory, query).select("id", F.lit(0).alias("kind_rank"), "title", "content", "source_path", F.lit(None).cast("string").alias("heading_path"), F.col("type").alias("memory_type"), "status", "score")

    def shaped(hits: DataFrame) -> DataFrame:
        return hits.select("id", F.lit(1).alias("kind_rank"), chunk_title(False).alias("title"), "content", F.col("path").alias("source_path"), "heading_path", F.lit("document_chunk").alias("memory_type"), F.lit("active").alias("status"), "score")

    if not terms:
        return mem.where(F.lit(False))
    order = (F.desc("score"), "kind_rank", "id")
    found = search_chunks(chunks, documents, ledger, query).orderBy(F.desc("score"), "id").limit(top_k)
    lexical = mem.unionByName(shaped(contents(found, chunks)))
    if vector is None:
        return lexical.orderBy(*order).limit(top_k)
    semantic = shaped(semantic_hits(chunks, documents, ledger, vector, top_k))
    flag = semantic.agg((F.count("*") == 0).alias("no_semantic"))
    lexical = lexical.join(F.broadcast(flag)).where("no_semantic").drop("no_semantic")
    return semantic.unionByName(lexical).orderBy(*order).limit(top_k)


def global_search(chunks: DataFrame, documents: DataFrame, ledger: DataFrame | None, memory: DataFrame, query: str, top_k: int = 10, kind: str = "all", excerpt_chars: int = 240, include_inactive: bool = False) -> DataFrame:
    """Memory nodes (overlap times ten, source path included) and chunks (BM25 on stripped text) in one ranking."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if excerpt_chars < 80:
        raise ValueError("excerpt_chars must be at least 80")
    if kind not in ("all", "memory", "chunks"):
        raise ValueError("kind must be all, memory or chunks")
    terms = query_terms(query)
    mem = overlap(active(memory, include_inactive), terms, _text("title", "content", "source_path"), 10.0) if terms else memory.withColumn("score", F.lit(0.0)).where(F.lit(False))
    mem = mem.select("id", F.lit("memory_node").alias("kind"), F.lit(0).alias("kind_rank"), F.coalesce("title", F.lit("")).alias("title"), "content", "source_path", F.lit(None).cast("string").alias("heading_path"), F.col("type").alias("memory_type"), "status", "score", "source_kind", "source_document_id", "source_chunk_id", "confidence")
    hits = search_chunks(chunks, documents, ledger, query, stripped=True).withColumn("title", chunk_title())
    hits = contents(hits.orderBy(F.desc("score"), "title", "id").limit(top_k), chunks, stripped=True)
    hits = hits.select("id", F.lit("document_chunk").alias("kind"), F.lit(1).alias("kind_rank"), "title", "content", F.col("path").alias("source_path"), "heading_path", F.lit("document_chunk").alias("memory_type"), F.lit("active").alias("status"), "score")
    rows = mem if kind == "memory" else hits if kind == "chunks" else mem.unionByName(hits, allowMissingColumns=True)
    if not terms:
        rows = rows.where(F.lit(False))
    best = rows.orderBy(F.desc("score"), "kind_rank", "title", "id").limit(top_k)
    return best.withColumn("content_excerpt", T.excerpt("content", excerpt_chars))


def substring_search(memories: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Rows whose text holds every white-space-separated part of the query, first ids first."""
    out = memories
    for part in query.lower().split():
        out = out.where(F.instr(F.lower("text"), part) > 0)
    return out.orderBy("id").limit(limit) if query.split() else out.where(F.lit(False))


def vector_search(points: DataFrame, vector: list[float], top_k: int, rounded: bool = True, positive: bool = True, key: str = "point_id") -> DataFrame:
    """An in-memory store's search: the two variants differ in rounding before the test for 0."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    sim = V.cosine("vector", q)
    rows = points.withColumn("score", F.round(sim, 4) if rounded else sim)
    return (rows.where("score > 0") if positive else rows).orderBy(F.desc("score"), key).limit(top_k)
