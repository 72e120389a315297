"""The source catalog: filters, limits, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T


def confirmed(catalog: DataFrame) -> DataFrame:
    return catalog.where("confirmation_status = 'confirmed'")


def select_entries(catalog: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), source_type: str | None = None) -> DataFrame:
    """Entries whose fields hold any of the included texts and none of the excluded ones; blanks are ignored."""
    hay = F.lower(F.concat_ws(" ", "id", "source_type", "path_or_alias", F.coalesce("project_name", F.lit("")), F.array_join("discovered_from", " ")))
    yes, no = ([x.strip().lower() for x in xs if x.strip()] for xs in (include, exclude))
    out = catalog
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    if yes:
        hit = F.lit(False)
        for x in yes:
            hit = hit | (F.instr(hay, x) > 0)
        out = out.where(hit)
    for x in no:
        out = out.where(F.instr(hay, x) == 0)
    return out


def section_limits(scored: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows of each section, the surest first."""
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("confidence"), F.lower("path"), "path"))
    return scored.withColumn("position", rank).where(F.col("position") <= limit)


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace those of the same id."""
    return catalog.join(new.select(F.col("id").alias("n_id")), F.col("id") == F.col("n_id"), "left_anti").unionByName(new.select(*catalog.columns))


def confirm(catalog: DataFrame, entry_ids: list[str], status: str = "confirmed") -> DataFrame:
    return catalog.withColumn("confirmation_status", F.when(F.col("id").isin(entry_ids), F.lit(status)).otherwise(F.col("confirmation_status")))


def roots(catalog: DataFrame) -> DataFrame:
    return confirmed(catalog).where("source_type = 'project_root'")


def infer_name(path):
    """A project name from the last segment of a path, or null."""
    name = T.basename(path)
    return F.when(name != "", name)
