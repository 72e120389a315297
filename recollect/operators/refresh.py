"""Incremental refresh: a listing is compared with the ledger, and one classification drives everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.schemas import STABILITY_SECONDS

UNSTABLE = "JSONL modified recently, not yet stable"
GONE = "previously indexed source file no longer exists"


def stable(modified: Column, now: Column, seconds: int = STABILITY_SECONDS) -> Column:
    """Whether a session log has been quiet long enough; 0 or less turns the gate off, an unknown time passes."""
    if seconds <= 0:
        return F.lit(True)
    return F.coalesce(F.unix_micros(now) - F.unix_micros(modified) >= seconds * 1_000_000, F.lit(True))


def needs_hash(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose ledger rows do not all say active, hashed, and of the same time: only these are read.

    listing: path, modified. A file may have many rows (one for each exchange).
    """
    rows = ledger.select(T.physical_path("source_path_or_alias").alias("l_path"), "status", "content_hash", "last_modified_at")
    same = F.coalesce((F.col("status") == "active") & (F.coalesce("content_hash", F.lit("")) != "") & (F.col("last_modified_at") == F.col("modified")), F.lit(False))
    joined = listing.join(rows, F.col("path") == F.col("l_path"), "left")
    return joined.groupBy("path", "modified").agg(F.min(same).alias("fresh")).where(~F.col("fresh")).select("path", "modified")


def classify(listing: DataFrame, ledger: DataFrame, now: Column, seconds: int = STABILITY_SECONDS) -> DataFrame:
    """One action for each source: skipped, new, unchanged, modified or missing.

    listing: source_id, source_path, source_type, content_hash, modified. A row that was never
    active counts as new when it can be indexed; only active rows go missing.
    """
    now_rows = listing.select(F.col("source_id").alias("n_id"), F.col("source_path").alias("n_path"), F.col("source_type").alias("n_type"), F.col("content_hash").alias("n_hash"), F.col("modified").alias("n_time"))
    old = ledger.select(F.col("source_id").alias("o_id"), F.col("source_path_or_alias").alias("o_path"), F.col("source_type").alias("o_type"), F.col("content_hash").alias("o_hash"), F.col("status").alias("o_status"))
    both = now_rows.join(old, F.col("n_id") == F.col("o_id"), "full_outer")
    unstable = (F.col("n_type") == "agent_session") & (T.suffix(T.physical_path("n_path")) == ".jsonl") & ~stable(F.col("n_time"), now, seconds)
    action = (
        F.when(F.col("n_id").isNull(), F.when(F.col("o_status") == "active", "missing"))
        .when(unstable, "skipped")
        .when(F.col("o_id").isNull(), "new")
        .when((F.col("o_status") == "active") & F.col("o_hash").eqNullSafe(F.col("n_hash")), "unchanged")
        .when(F.col("o_status") == "active", "modified")
        .otherwise("new")
    )
    reason = F.when(F.col("action") == "skipped", F.lit(UNSTABLE)).when(F.col("action") == "missing", F.lit(GONE))
    rows = both.withColumn("action", action).where("action is not null")
    return rows.select(
        F.coalesce("n_id", "o_id").alias("source_id"), F.coalesce("n_path", "o_path").alias("source_path"), F.coalesce("n_type", "o_type").alias("source_type"), "action", reason.alias("reason"),
        F.col("o_status").alias("previous_status"), F.when(F.col("action") == "modified", F.col("o_hash")).alias("previous_hash"), F.col("n_hash").alias("new_hash"), F.col("n_time").alias("modified"),
    )


def missing_sources(ledger: DataFrame, seen: DataFrame, physical: DataFrame, root: str) -> DataFrame:
    """Active ledger rows under a root that were not seen, where the file itself is gone too."""
    under = ledger.where((F.col("status") == "active") & T.path_inside(T.physical_path("source_path_or_alias"), F.lit(root)))
    unseen = under.join(seen.select(F.col("source_id").alias("s_id")), F.col("source_id") == F.col("s_id"), "left_anti")
    return unseen.join(physical.select(F.col("path").alias("p_path")), T.physical_path(unseen["source_path_or_alias"]) == F.col("p_path"), "left_anti")


def as_unchanged(ledger: DataFrame, time: str) -> DataFrame:
    """Rows of a classified listing for ledger rows whose files were not opened; time: the column with the files' times."""
    none = F.lit(None)
    return ledger.select(
        "source_id", F.col("source_path_or_alias").alias("source_path"), "source_type", F.lit("unchanged").alias("action"), none.cast("string").alias("reason"), F.col("status").alias("previous_status"),
        none.cast("string").alias("previous_hash"), F.col("content_hash").alias("new_hash"), F.col(time).alias("modified"),
    )


def upsert(table: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """New rows replace old ones of their key, except for the columns to keep.

    Of several new ones the last by updated_at counts, then the one of the greatest hash, so that every run picks the same.
    """
    last = Window.partitionBy(key).orderBy(*([F.desc("updated_at")] if "updated_at" in new.columns else []), F.desc(F.xxhash64(*new.columns)))
    new = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    o, n = table.alias("o"), new.select(*table.columns).withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    hit = F.coalesce(F.col("n._new"), F.lit(False))
    cols = []
    for c in table.columns:
        old, fresh = F.col(f"o.{c}"), F.col(f"n.{c}")
        cols.append((F.coalesce(old, fresh) if c in keep else F.when(hit, fresh).otherwise(old)).alias(c))
    return both.select(*cols)


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after indexing: all old ones of the new chunks' documents are gone."""
    return chunks.join(new.select(F.col("document_id").alias("n_doc")).distinct(), F.col("document_id") == F.col("n_doc"), "left_anti").unionByName(new)


def ledger_after(classified: DataFrame, ledger: DataFrame, now: Column, errors: DataFrame | None = None, chunk_counts: DataFrame | None = None) -> DataFrame:
    """The ledger after a run.

    A skipped source that is active stays as it was. A source that failed to index keeps its
    hash, times and chunks if it was active, with status error and the message; otherwise it
    becomes an error row.
    """
    rows = classified.where("action in ('new', 'modified', 'missing') or (action = 'skipped' and coalesce(previous_status, '') <> 'active')")
    if errors is not None:
        rows = rows.join(errors.select(F.col("source_id").alias("e_id"), F.col("error_message").alias("e_text")), F.col("source_id") == F.col("e_id"), "left").drop("e_id")
    else:
        rows = rows.withColumn("e_text", F.lit(None).cast("string"))
    if chunk_counts is not None:
        rows = rows.join(chunk_counts.select(F.col("source_id").alias("c_id"), F.col("chunk_count").alias("c_n")), F.col("source_id") == F.col("c_id"), "left").drop("c_id")
    else:
        rows = rows.withColumn("c_n", F.lit(0))
    failed = F.col("e_text").isNotNull()
    status = F.when(failed, "error").when(F.col("action").isin("new", "modified"), "active").when(F.col("action") == "missing", "missing").otherwise("skipped")
    kept = F.coalesce(failed & (F.col("previous_status") == "active"), F.lit(False)) | (F.col("action") == "missing")
    new = rows.select(F.col("source_id").alias("r_id"), F.col("source_path").alias("r_path"), F.col("source_type").alias("r_type"), "new_hash", "modified", status.alias("r_status"), F.coalesce("e_text", "reason").alias("r_error"), F.coalesce("c_n", F.lit(0)).cast("int").alias("r_chunks"), kept.alias("r_kept"))
    both = ledger.join(new, F.col("source_id") == F.col("r_id"), "full_outer")
    hit, keep = F.col("r_id").isNotNull(), F.coalesce("r_kept", F.lit(False))
    pick = lambda c, v: F.when(hit & ~(keep & F.col("source_id").isNotNull()), v).otherwise(F.col(c))
    always = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    return both.select(
        F.coalesce("source_id", "r_id").alias("source_id"), F.coalesce("source_path_or_alias", "r_path").alias("source_path_or_alias"), "project_name", F.coalesce("source_type", "r_type").alias("source_type"), F.coalesce("parser_version", F.lit("1")).alias("parser_version"),
        pick("content_hash", F.col("new_hash")).alias("content_hash"), pick("last_modified_at", F.col("modified")).alias("last_modified_at"), F.when(hit & (F.col("r_status") == "active"), now).otherwise(F.col("last_indexed_at")).alias("last_indexed_at"),
        always("status", F.col("r_status")).alias("status"), always("error_message", F.col("r_error")).alias("error_message"), pick("chunk_count", F.col("r_chunks")).alias("chunk_count"), F.coalesce("created_at", now).alias("created_at"), always("updated_at", now).alias("updated_at"),
    )


def touched(classified: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger with the file times of unchanged sources, so that the next run need not read them again."""
    times = classified.where("action = 'unchanged'").select(F.col("source_id").alias("u_id"), F.col("modified").alias("u_time"))
    rows = ledger.join(times, F.col("source_id") == F.col("u_id"), "left")
    return rows.select(*(F.coalesce("u_time", c).alias(c) if c == "last_modified_at" else F.col(c) for c in ledger.columns))


def counters(classified: DataFrame) -> DataFrame:
    """One row: how many sources each action has."""
    n = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, 1).otherwise(0)), F.lit(0)).cast("long")
    return classified.agg(F.count("*").alias("total"), *(n(a).alias(f"n_{a}") for a in ("new", "modified", "unchanged", "missing", "skipped")))


def detail_summary(classified: DataFrame) -> DataFrame:
    """Counts by action, by source type and by reason (the ten most frequent), in one pass of grouping sets."""
    rows = classified.select("action", "source_type", F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.lit("")).alias("reason"))
    sets = rows.groupingSets([["action"], ["source_type"], ["reason"]], "action", "source_type", "reason").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    named = sets.select(F.when(F.col("g") == 3, "action").when(F.col("g") == 5, "source_type").otherwise("reason").alias("facet"), F.coalesce("action", "source_type", "reason").alias("value"), "n").where("not (facet = 'reason' and value = '')")
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return named.withColumn("r", rank).where("facet <> 'reason' or r <= 10").select("facet", "value", "n")
