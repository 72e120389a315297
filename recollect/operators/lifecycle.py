"""Life cycles of memories and of ledger rows, as rewrites of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import ids
from recollect.functions import text as T
from recollect.schemas import CURATED_TYPES, MEMORY_STATUSES

TOMBSTONE = "[pruned auto memory tombstone]"
PRUNE_LIMIT = 100
#: Allowed next statuses of a ledger row (fixed values); None: no row yet.
TRANSITIONS: dict[str | None, tuple[str, ...]] = {
    None: ("active", "skipped", "missing", "error"),
    "active": ("active", "skipped", "missing", "error"),
    "skipped": ("skipped", "active", "missing", "error"),
    "missing": ("missing", "active"),
    "error": ("error", "active", "missing"),
    "pending": ("active", "skipped", "missing", "error"),
}


def generated() -> Column:
    return (F.col("source_kind") == "auto") & (F.col("created_by") == "auto")


def reviewable() -> Column:
    return F.coalesce((F.col("status") == "unverified") & generated(), F.lit(False))


def transition(memory: DataFrame, which: Column, target: str, now: Column) -> DataFrame:
    """The snapshot after approving ("active") or rejecting ("obsolete"): only generated unverified rows change."""
    if target not in ("active", "obsolete"):
        raise ValueError("target must be active or obsolete")
    go = which & reviewable()
    return memory.withColumn("updated_at", F.when(go, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(go, F.lit(target)).otherwise(F.col("status")))


def approve(memory: DataFrame, which: Column, now: Column) -> DataFrame:
    return transition(memory, which, "active", now)


def reject(memory: DataFrame, which: Column, now: Column) -> DataFrame:
    return transition(memory, which, "obsolete", now)


def set_status(memory: DataFrame, memory_id: str, status: str, now: Column) -> DataFrame:
    if status not in MEMORY_STATUSES:
        raise ValueError(f"status must be one of {', '.join(MEMORY_STATUSES)}")
    hit = F.col("id") == memory_id
    return memory.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def promote(memory: DataFrame, memory_id: str, title: str, content: str, now: Column, memory_type: str = "note") -> DataFrame:
    """One new snapshot with an active curated copy and the original made obsolete, or the old one unchanged.

    Unchanged if the row is not a generated unverified one, or if an active memory has the content already.
    """
    title, content = " ".join(title.split()), content.strip()
    if not title or not content:
        raise ValueError("title and content cannot be empty")
    if memory_type not in CURATED_TYPES:
        raise ValueError(f"type must be one of {', '.join(CURATED_TYPES)}")
    digest = ids.content_hash(F.lit(content))
    there = memory.where((F.col("content_hash") == digest) & (F.col("status") == "active")).agg((F.count("*") == 0).alias("free"))
    source = memory.where((F.col("id") == memory_id) & reviewable()).join(F.broadcast(there)).where("free").drop("free")
    copy = source.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat(F.lit(memory_id), digest).cast("binary"), 256), 1, 32)).alias("id"), "project_id", F.lit(memory_type).alias("type"), F.lit(title).alias("title"), F.lit(content).alias("content"), F.lit("active").alias("status"), F.lit("curated_auto").alias("source_kind"),
        "source_document_id", "source_chunk_id", "source_path", digest.alias("content_hash"), F.lit("curated_auto").alias("created_by"), "model_name", "confidence", now.alias("created_at"), now.alias("updated_at"),
    )
    done = copy.agg((F.count("*") > 0).alias("done"))
    hit = F.col("done") & (F.col("id") == memory_id) & reviewable()
    rest = memory.join(F.broadcast(done)).withColumn("_hit", hit)
    rest = rest.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).withColumn("status", F.when(F.col("_hit"), F.lit("obsolete")).otherwise(F.col("status"))).drop("done", "_hit")
    return rest.unionByName(copy.select(*rest.columns))


def prunable(memory: DataFrame, source_filter: str | None = None, limit: int = PRUNE_LIMIT) -> DataFrame:
    """Rejected generated memories that still have their content, least recently changed first."""
    if limit < 1:
        raise ValueError("limit must be greater than zero")
    rows = memory.where((F.col("project_id") == "default") & (F.col("status") == "obsolete") & generated() & F.col("content_hash").isNotNull() & (F.col("content") != TOMBSTONE))
    if source_filter:
        rows = rows.where(T.contains_literal("source_path", source_filter))
    return rows.orderBy("updated_at", "created_at", "id").limit(limit)


def prune(memory: DataFrame, now: Column, source_filter: str | None = None, limit: int = PRUNE_LIMIT) -> DataFrame:
    """The snapshot with the prunable rows' contents replaced by a marker; hashes stay, so they keep blocking."""
    chosen = prunable(memory, source_filter, limit).select(F.col("id").alias("p_id"), F.lit(True).alias("pruned"))
    rows = memory.join(F.broadcast(chosen), F.col("id") == F.col("p_id"), "left").drop("p_id")
    hit = F.coalesce("pruned", F.lit(False))
    return rows.withColumn("content", F.when(hit, F.lit(TOMBSTONE)).otherwise(F.col("content"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("pruned")


def review(memory: DataFrame, source_filter: str | None = None) -> DataFrame:
    rows = memory.where(reviewable())
    return rows.where(T.contains_literal("source_path", source_filter)) if source_filter else rows


def review_by_source(memory: DataFrame, source_filter: str | None = None) -> DataFrame:
    return review(memory, source_filter).groupBy("source_path").agg(F.count("*").alias("n"))


def review_list(memory: DataFrame, limit: int = 20, excerpt_chars: int = 160, source_filter: str | None = None) -> DataFrame:
    rows = review(memory, source_filter).orderBy(F.asc_nulls_first("source_path"), "title", "created_at", "id").limit(limit)
    return rows.withColumn("content_excerpt", T.excerpt("content", excerpt_chars))


def transition_allowed(previous: Column, following: Column) -> Column:
    """Whether a ledger row may go from one status to the next; false for unknown ones."""
    out = F.when(previous.isNull(), following.isin(*TRANSITIONS[None]))
    for k, v in TRANSITIONS.items():
        if k is not None:
            out = out.when(previous == k, following.isin(*v))
    return F.coalesce(out, F.lit(False))
