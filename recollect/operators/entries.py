"""Catalog entries in a refresh: what becomes of each, and what the ledger and the report say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import context

#: Catalog types that are read, and the source type of their records.
PARSED_AS = {"project_root": "project_docs", "document": "project_docs", "agent_root": "agent_session"}
# Fixed values
NOT_INDEXABLE, NO_PARSER, ELSEWHERE, NOT_FOUND = "server_alias not indexable", "no parser registered for catalog source type", "non-local absolute path not indexable on this platform", "source path not found"
LEDGER_TEXTS = {NOT_INDEXABLE: "server_alias: no network/SSH indexing", ELSEWHERE: "non-local path: no local filesystem indexing"}


def foreign(path: Column | str) -> Column:
    """Whether a path is absolute on another platform: a drive letter or a network share."""
    return T._c(path).rlike(r"^([A-Za-z]:[\\/]|\\\\)")


def dispatch(entries: DataFrame, present: DataFrame) -> DataFrame:
    """id, path_or_alias, source_type, action (skipped, missing or walk) and reason of each confirmed entry.

    present: column path, the entries' paths that are there. Null types have no parser; a null
    path is not found; an empty catalog gives an empty result.
    """
    there = present.select(F.col("path").alias("there")).distinct()
    rows = entries.where("confirmation_status = 'confirmed'").join(there, F.col("path_or_alias") == F.col("there"), "left")
    reason = (
        F.when(F.col("source_type") == "server_alias", NOT_INDEXABLE)
        .when(~F.coalesce(F.col("source_type").isin(*PARSED_AS), F.lit(False)), NO_PARSER)
        .when(F.col("there").isNull() & F.coalesce(foreign("path_or_alias"), F.lit(False)), ELSEWHERE)
        .when(F.col("there").isNull(), NOT_FOUND)
    )
    rows = rows.withColumn("reason", reason)
    action = F.when(F.col("reason").isNull(), "walk").when(F.col("reason") == NOT_FOUND, "missing").otherwise("skipped")
    return rows.select("id", "path_or_alias", "source_type", action.alias("action"), "reason")


def as_actions(dispatched: DataFrame) -> DataFrame:
    """Rows of a classified listing for the entries that are not walked (error rows keep their text as reason)."""
    none = F.lit(None)
    return dispatched.where("action <> 'walk'").select(
        F.col("id").alias("source_id"), F.col("path_or_alias").alias("source_path"), "source_type", "action", "reason", none.cast("string").alias("previous_status"), none.cast("string").alias("previous_hash"),
        none.cast("string").alias("new_hash"), none.cast("timestamp").alias("modified"),
    )


def outside(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """Rows whose path (column plain) lies in none of some directories (column dir): a join on each row's ancestors."""
    inside = context.inside_any(rows, "plain", "source_id", dirs.select(F.col("dir").alias("path_or_alias")))
    return rows.join(inside.select(F.col("source_id").alias("a_id")).distinct(), F.col("source_id") == F.col("a_id"), "left_anti")


def listing_errors(problems: DataFrame, roots: list[tuple[int, str]]) -> DataFrame:
    """Rows of a classified listing for directories below the roots that could not be listed; the roots' own errors are their entries'."""
    none, plain = F.lit(None), F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    rows = problems.where(~plain.isin([p for _, p in roots]))
    return rows.groupBy(F.col("path").alias("source_path")).agg(F.min("problem").alias("reason")).select(
        F.col("source_path").alias("source_id"), "source_path", F.lit("directory").alias("source_type"), F.lit("error").alias("action"), "reason", none.cast("string").alias("previous_status"), none.cast("string").alias("previous_hash"),
        none.cast("string").alias("new_hash"), none.cast("timestamp").alias("modified"),
    )


def ledger_rows(dispatched: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """Ledger rows (without times of creation) for the entries that are not walked."""
    text = F.col("reason")
    for reason, said in LEDGER_TEXTS.items():
        text = F.when(F.col("reason") == reason, said).otherwise(text)
    names = catalog.select(F.col("id").alias("c_id"), "project_name")
    rows = dispatched.where("action <> 'walk'").join(names, F.col("id") == F.col("c_id"))
    none = F.lit(None)
    return rows.select(
        F.col("id").alias("source_id"), F.col("path_or_alias").alias("source_path_or_alias"), "project_name", "source_type", F.lit("1").alias("parser_version"), none.cast("string").alias("content_hash"), none.cast("timestamp").alias("last_modified_at"),
        none.cast("timestamp").alias("last_indexed_at"), F.col("action").alias("status"), text.alias("error_message"), F.lit(0).alias("chunk_count"), now.alias("created_at"), now.alias("updated_at"),
    )


def inside_any(path: Column, roots: list[str]) -> Column:
    """Whether a path lies in one of the catalog's roots (a bounded configuration, not data)."""
    out = F.lit(False)
    for root in roots:
        out = out | T.path_inside(path, F.lit(root))
    return out
