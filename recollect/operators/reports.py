"""Status, telemetry and calibration reports: aggregates, most of them in a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.schemas import STABILITY_SECONDS

#: Parts of messages of skips that are expected (fixed values).
EXPECTED_PARTS = ("non-local path", "stale ledger", "removed local source", "disabled catalog source", "no indexable records")
EXPECTED_MARKERS = ("server_alias:", "non-local path:", "stale ledger:", "removed local source:", "disabled catalog source:", "no indexable records")
UNSTABLE_PARTS = ("not yet stable", "unstable")


def table_counts(**tables: DataFrame) -> DataFrame:
    """name and n of each table, each counted from its file footers where Spark can."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """Rows by status and by source type, in one pass of grouping sets."""
    sets = ledger.groupingSets([["status"], ["source_type"]], "status", "source_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 1, "status").otherwise("source_type").alias("facet"), F.when(F.col("g") == 1, F.col("status")).otherwise(F.col("source_type")).alias("value"), "n")


def last_indexed(ledger: DataFrame, documents: DataFrame) -> DataFrame:
    both = ledger.select("last_indexed_at").unionByName(documents.select("last_indexed_at"))
    return both.agg(F.max("last_indexed_at").alias("last_indexed_at"))


def recent_problems(ledger: DataFrame, limit: int = 10) -> DataFrame:
    rows = ledger.where(F.col("status").isin("missing", "error", "skipped"))
    return rows.orderBy(F.desc("updated_at"), "source_id").limit(limit).select("source_id", "source_path_or_alias", "source_type", "status", "error_message", "updated_at")


def expected_skip() -> Column:
    return (F.col("source_type") == "server_alias") | T.contains_any("error_message", EXPECTED_PARTS)


def expected_message(message: Column | str) -> Column:
    """The other classifier, by message alone, with its own list of markers."""
    return T.contains_any(message, EXPECTED_MARKERS)


def skip_split(ledger: DataFrame) -> DataFrame:
    skipped = F.col("status") == "skipped"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return ledger.agg(n(skipped & expected_skip()).alias("expected"), n(skipped & ~expected_skip()).alias("other"), n(skipped & expected_message("error_message")).alias("expected_by_message"))


def skip_reasons(ledger: DataFrame, limit: int = 20) -> DataFrame:
    rows = ledger.where("status = 'skipped'").groupBy("source_type", F.coalesce("error_message", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "source_type", "reason").limit(limit)


def unstable_files(ledger: DataFrame, now: Column | None = None, seconds: int = STABILITY_SECONDS) -> DataFrame:
    """Session files skipped as unstable, with how many rows each has; with `now`, whether they are transient or stale."""
    rows = ledger.where((F.col("status") == "skipped") & (F.col("source_type") == "agent_session") & T.contains_any("error_message", UNSTABLE_PARTS))
    files = rows.groupBy(T.physical_path("source_path_or_alias").alias("path")).agg(F.count("*").alias("n"), F.min("last_modified_at").alias("first_modified"), F.max("last_modified_at").alias("last_modified"), F.max("updated_at").alias("last_updated"))
    if now is None:
        return files
    young = F.coalesce((F.unix_micros(now) - F.unix_micros("last_modified")) < seconds * 1_000_000, F.lit(False)) if seconds > 0 else F.lit(False)
    return files.withColumn("freshness", F.when(young, "transient").otherwise("stale"))


def freshness_split(ledger: DataFrame, now: Column, seconds: int = STABILITY_SECONDS) -> DataFrame:
    files = unstable_files(ledger, now, seconds)
    n = lambda k: F.coalesce(F.sum(F.when(F.col("freshness") == k, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    return files.agg(n("transient").alias("transient"), n("stale").alias("stale"))


def readiness(ledger: DataFrame, catalog: DataFrame, now: Column, seconds: int = STABILITY_SECONDS) -> DataFrame:
    """One row: ready, and the ordered warnings that stand against it."""
    skipped = F.col("status") == "skipped"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    own = ledger.agg(n(F.col("status") == "active").alias("active"), n(F.col("status") == "missing").alias("missing"), n(F.col("status") == "error").alias("error"), n(skipped & ~expected_skip()).alias("other"))
    confirmed = catalog.agg(n(F.col("confirmation_status") == "confirmed").alias("confirmed"))
    row = own.join(F.broadcast(confirmed)).join(F.broadcast(freshness_split(ledger, now, seconds)))
    actionable = F.greatest(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("other") - F.col("transient")) - F.col("stale"))
    say = lambda c, text: F.when(c, text)
    number = lambda c, text: F.concat(c.cast("string"), F.lit(text))
    warnings = F.array(
        say(F.col("confirmed") == 0, F.lit("catalog has no confirmed sources")), say(F.col("active") == 0, F.lit("no active indexed sources found")), say(F.col("missing") > 0, number(F.col("missing"), " source(s) are missing")), say(F.col("error") > 0, number(F.col("error"), " source(s) have indexing errors")),
        say(actionable > 0, number(actionable, " actionable non-expected source(s) are skipped")), say(F.col("stale") > 0, number(F.col("stale"), " agent session source(s) remain unstable after the stability window")),
    )
    return row.select(F.filter(warnings, lambda w: w.isNotNull()).alias("w")).select((F.size("w") == 0).alias("ready"), F.array_join("w", "; ").alias("warnings"))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    sets = catalog.groupingSets([["source_type"], ["confirmation_status"]], "source_type", "confirmation_status").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 1, "source_type").otherwise("confirmation_status").alias("facet"), F.coalesce("source_type", "confirmation_status").alias("value"), "n")


def global_status(ledger: DataFrame, catalog: DataFrame, documents: DataFrame, chunks: DataFrame, memory: DataFrame) -> DataFrame:
    """facet, value, n over the whole store."""
    led = ledger_counts(ledger).withColumn("facet", F.concat(F.lit("ledger_"), "facet"))
    cat = catalog_counts(catalog).withColumn("facet", F.concat(F.lit("catalog_"), "facet"))
    tab = table_counts(documents=documents, chunks=chunks, memory_nodes=memory).select(F.lit("table").alias("facet"), F.col("name").alias("value"), "n")
    return led.unionByName(cat).unionByName(tab)


# Tasks


def list_tasks(tasks: DataFrame, **equal: str | int | None) -> DataFrame:
    """Tasks with the given values; a filter of None is not set. Newest first."""
    for k, v in equal.items():
        if v is not None:
            tasks = tasks.where(F.col(k) == v)
    return tasks.orderBy(F.desc("created_at"), "task_id")


def task_rollup(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """Totals of tokens and seconds for each task; null without steps."""
    sums = steps.groupBy(F.col("task_id").alias("s_id")).agg(F.sum("tokens_used").alias("tokens"), F.sum("duration_s").alias("seconds"), F.count("*").alias("steps"))
    return tasks.join(sums, F.col("task_id") == F.col("s_id"), "left").select("task_id", F.col("tokens").alias("total_tokens"), F.col("seconds").alias("total_duration_s"), F.coalesce("steps", F.lit(0)).cast("long").alias("n_steps"))


def next_step_index(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    top = steps.groupBy(F.col("task_id").alias("s_id")).agg(F.max("step_index").alias("top"))
    return tasks.join(top, F.col("task_id") == F.col("s_id"), "left").select("task_id", (F.coalesce("top", F.lit(-1)) + 1).alias("next_index"))


def verifier_acceptance(rounds: DataFrame, tasks: DataFrame | None = None, project: str | None = None) -> DataFrame:
    if project is not None:
        rounds = rounds.join(tasks.where(F.col("project") == project).select(F.col("task_id").alias("t_id")), F.col("task_id") == F.col("t_id"), "left_semi")
    rows = rounds.groupBy("suggestion_type").agg(F.count("*").alias("total"), F.sum(F.col("brain_accepted").cast("int")).alias("accepted"))
    return rows.withColumn("acceptance_rate", F.round(F.col("accepted") / F.col("total"), 3))


def judgment_outcomes(tasks: DataFrame, steps: DataFrame, project: str | None = None) -> DataFrame:
    t = tasks.where(F.col("human_outcome").isNotNull())
    if project is not None:
        t = t.where(F.col("project") == project)
    s = steps.where(F.col("brain_judgment").isNotNull()).select(F.col("task_id").alias("s_id"), "brain_judgment")
    return s.join(t.select("task_id", "human_outcome"), F.col("s_id") == F.col("task_id")).groupBy("brain_judgment", "human_outcome").agg(F.count("*").alias("n"))


# Source health


def cleanup_actions(ledger: DataFrame, catalog: DataFrame, local_roots: tuple[str, ...] = ("/",)) -> DataFrame:
    """What to do about missing, failed and skipped ledger rows, and why.

    A row's catalog entry is the first by id, or of a fitting type whose path contains it;
    paths that start with none of the local roots cannot be indexed here. The catalog is small
    next to the ledger but unbounded: ids and paths are matched by equality, the path with each
    of its ancestors, so no pair of rows without a match is ever looked at.
    """
    path = T.physical_path("source_path_or_alias")
    rows = ledger.where(F.col("status").isin("missing", "error", "skipped") & ~((F.col("status") == "skipped") & expected_message("error_message"))).withColumn("_norm", T.normalized_path(path))
    entries = catalog.withColumn("_pos", F.monotonically_increasing_id()) if "position" not in catalog.columns else catalog.withColumn("_pos", F.col("position"))
    kind = F.when(F.col("source_type") == "server_alias", "server_alias").when(F.col("source_type") == "agent_root", "agent_session").otherwise("project_docs")
    e = entries.select(F.col("id").alias("e_id"), T.normalized_path("path_or_alias").alias("e_path"), kind.alias("e_kind"), "confirmation_status", "_pos")
    parts = F.split("_norm", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    by_id = rows.select("source_id").join(e, F.col("source_id") == F.col("e_id")).select("source_id", "_pos", "confirmation_status")
    paths = rows.select("source_id", "source_type", F.explode(F.array_distinct(F.filter(above, lambda p: p != ""))).alias("_up"))
    by_path = paths.join(e, (F.col("_up") == F.col("e_path")) & (F.col("source_type") == F.col("e_kind"))).select("source_id", "_pos", "confirmation_status")
    first = by_id.union(by_path).groupBy(F.col("source_id").alias("m_id")).agg(F.min_by("confirmation_status", "_pos").alias("entry"))
    both = rows.join(first, F.col("source_id") == F.col("m_id"), "left")
    local = F.lit(False)
    for r in local_roots:
        local = local | F.startswith(path, F.lit(r))
    absolute = path.rlike(r"^([A-Za-z]:[\\/]|/|\\\\)")
    reason = (
        F.when(absolute & ~local, "non-local path cannot be indexed from this local machine")
        .when(F.col("entry").isNotNull() & (F.col("entry") != "confirmed"), "disabled catalog source should not block readiness")
        .when(F.col("entry").isNull() & F.col("status").isin("missing", "error"), "stale ledger row has no confirmed catalog source")
        .when((F.col("status") == "missing") & T.contains_literal("error_message", "previously indexed source file no longer exists"), "removed local source file is no longer active")
    )
    done = both.withColumn("reason", reason).where("reason is not null")
    return done.select("source_id", "source_type", "source_path_or_alias", F.lit("mark_ledger_expected_skip").alias("action"), F.col("status").alias("previous_status"), F.lit("skipped").alias("next_status"), "reason")


def cleanup_message(reason: Column | str) -> Column:
    """The message that a cleaned ledger row gets."""
    r = T._c(reason)
    return (
        F.when(F.contains(r, F.lit("non-local path")), "non-local path: no local filesystem indexing")
        .when(F.contains(r, F.lit("disabled catalog source")), "disabled catalog source: local path not indexed")
        .when(F.contains(r, F.lit("stale ledger")), "stale ledger: no confirmed catalog source")
        .when(F.contains(r, F.lit("removed local source")), "removed local source: no active local content")
        .otherwise(r)
    )


def apply_cleanup(ledger: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    a = actions.select(F.col("source_id").alias("a_id"), cleanup_message("reason").alias("a_text"))
    rows = ledger.join(a, F.col("source_id") == F.col("a_id"), "left").drop("a_id")
    hit = F.col("a_text").isNotNull()
    return rows.withColumn("status", F.when(hit, "skipped").otherwise(F.col("status"))).withColumn("error_message", F.coalesce("a_text", "error_message")).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("a_text")


def disable_missing(catalog: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """The catalog with confirmed local entries disabled whose path is relative or not there."""
    seen = existing_paths.select(F.col("path").alias("x_path"), F.lit(True).alias("there"))
    rows = catalog.join(seen, F.col("path_or_alias") == F.col("x_path"), "left").drop("x_path")
    absolute = F.col("path_or_alias").rlike(r"^([A-Za-z]:[\\/]|/)")
    off = (F.col("confirmation_status") == "confirmed") & (F.col("source_type") != "server_alias") & (~absolute | F.col("there").isNull())
    return rows.withColumn("confirmation_status", F.when(off, "disabled").otherwise(F.col("confirmation_status"))).drop("there")
