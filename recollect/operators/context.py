"""Project context: resolve a project in the catalog, then what belongs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import names

PHASES = ("exact_name", "path_alias", "basename", "substring")


def resolve(roots: DataFrame, query: str) -> DataFrame:
    """Roots tagged with the first phase in which any matches, and whether the match is unique.

    roots: confirmed project roots with id, project_name, path_or_alias. An empty result means
    no match; `ambiguous` is true where that phase matches several.
    """
    q = query.strip().lower()
    name = F.lower(T.strip(F.coalesce("project_name", F.lit(""))))
    path = F.lower(T.strip(F.coalesce("path_or_alias", F.lit(""))))
    phase = (
        F.when((name != "") & (name == q), 1)
        .when((T.normalized_path("path_or_alias") != "") & (T.normalized_path("path_or_alias") == T.normalized_path(F.lit(query))), 2)
        .when((F.lower(T.basename("path_or_alias")) != "") & (F.lower(T.basename("path_or_alias")) == q), 3)
        .when((F.instr(name, q) > 0) | (F.instr(path, q) > 0), 4)
    )
    tagged = roots.withColumn("phase", phase).where("phase is not null")
    best = tagged.agg(F.min("phase").alias("best"), F.min_by(F.lit(1), "phase").alias("_"))
    rows = tagged.join(F.broadcast(best.select("best")), F.col("phase") == F.col("best")).drop("best")
    n = rows.agg((F.count("*") > 1).alias("ambiguous"))
    return rows.join(F.broadcast(n)).withColumn("method", F.element_at(F.array(*(F.lit(p) for p in PHASES)), F.col("phase"))).drop("phase")


def ancestors(path: Column | str) -> Column:
    """A path and every directory above it, normalized: containment becomes an equi-join."""
    parts = F.split(T.normalized_path(path), "/")
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p != ""))


def inside_any(rows: DataFrame, path: str, key: str, roots: DataFrame) -> DataFrame:
    """key of each row whose path equals or lies below a root's path; an equi-join on ancestors, not a nested loop."""
    up = rows.select(key, F.explode(ancestors(path)).alias("_up"))
    tops = roots.select(T.normalized_path("path_or_alias").alias("_top")).where("_top <> ''").distinct()
    return up.join(tops, F.col("_up") == F.col("_top"), "left_semi").select(key).distinct()


def ledger_rows(ledger: DataFrame, roots: DataFrame) -> DataFrame:
    """Ledger rows that belong to the roots by id, by project name, or by path; each once."""
    by_id = ledger.join(roots.select(F.col("id").alias("r_id")), F.col("source_id") == F.col("r_id"), "left_semi").select("source_id")
    names = roots.select(F.lower(T.strip("project_name")).alias("r_name")).where("r_name <> ''")
    by_name = ledger.join(names, F.lower(T.strip("project_name")) == F.col("r_name"), "left_semi").select("source_id")
    by_path = inside_any(ledger, "source_path_or_alias", "source_id", roots)
    hit = by_id.union(by_name).union(by_path).distinct().withColumnRenamed("source_id", "h_id")
    return ledger.join(hit, F.col("source_id") == F.col("h_id"), "left_semi")


def documents_of(documents: DataFrame, ledger: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents of the roots' projects, inside their paths, or of their ledger rows; each once.

    `origin` is 0 for a direct match and 1 for one through the ledger only.
    """
    by_project = documents.join(roots.select(F.col("project_name").alias("r_name")), F.col("project_id") == F.col("r_name"), "left_semi").select("id")
    by_path = inside_any(documents, "path", "id", roots)
    direct = by_project.union(by_path).select("id", F.lit(0).alias("origin"))
    owned = ledger_rows(ledger, roots).select(F.col("source_path_or_alias").alias("o_path"))
    by_ledger = documents.join(owned, F.col("path") == F.col("o_path"), "left_semi").select("id", F.lit(1).alias("origin"))
    hit = direct.union(by_ledger).groupBy(F.col("id").alias("h_id")).agg(F.min("origin").alias("origin"))
    return documents.join(hit, F.col("id") == F.col("h_id")).drop("h_id")


def excerpts(chunks: DataFrame, documents: DataFrame, limit: int = 20, chars: int = 400) -> DataFrame:
    """The first chunks of the documents without metadata, cut to an excerpt."""
    d = documents.select(F.col("id").alias("d_id"), "path", "origin")
    rows = chunks.join(d, F.col("document_id") == F.col("d_id"))
    first = rows.orderBy("origin", "path", "chunk_index", "id").limit(limit)
    body = T.strip_preamble_context("content")
    return first.select("id", "path", "heading_path", "chunk_index", T.head(body, chars).alias("excerpt"), (F.length(body) > chars).alias("truncated"))


def memories(memory: DataFrame, project_ids: list[str], limit: int = 20, min_confidence: float = 0.5) -> DataFrame:
    """Active memories first, the surest and newest first; unknown confidence is let through and comes last."""
    rows = memory.where(F.col("project_id").isin(project_ids) & F.col("status").isin("active", "unverified") & (F.col("confidence").isNull() | (F.col("confidence") >= min_confidence)))
    return rows.orderBy(F.when(F.col("status") == "active", 0).otherwise(1), F.desc_nulls_last("confidence"), F.desc("created_at"), "id").limit(limit)


def related_documents(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """Document entries inside a root, or discovered from it."""
    docs = catalog.where("source_type = 'document'")
    by_path = inside_any(docs, "path_or_alias", "id", roots)
    origins = docs.select("id", F.explode("discovered_from").alias("_from"))
    by_origin = origins.join(roots.select(F.col("id").alias("r_id")), T.strip("_from") == F.col("r_id"), "left_semi").select("id")
    hit = by_path.union(by_origin).distinct().withColumnRenamed("id", "h_id")
    return docs.join(hit, F.col("id") == F.col("h_id"), "left_semi")


def related_servers(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """Server entries whose provenance names a root's project or path; any number of either, see names.pairs()."""
    servers = catalog.where("source_type = 'server_alias'").withColumn("_from", F.lower(F.array_join("discovered_from", " ")))
    sought = F.array(F.lower(T.strip(F.coalesce("project_name", F.lit("")))), F.lower(F.coalesce("path_or_alias", F.lit(""))))
    return names.holding(servers, "_from", roots.select(F.explode(sought).alias("name"))).drop("_from")
