"""A thin command line over the engine: python -m recollect.cli --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.engine import MemoryEngine
from recollect.operators import catalog as catalogs
from recollect.functions import ids
from recollect.operators import discovery, reports
from recollect.schemas import CATALOG, CATALOG_TYPES, SCHEMA_VERSION, TABLES
from recollect.sources import files, history

VERSION = "0.2.0"


def _print(df: DataFrame, limit: int = 200) -> None:
    for row in df.limit(limit).toJSON().collect():
        print(row)


def _catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file {"version", "entries": [...]}; an absent one is empty."""
    try:
        rows = spark.read.schema(f"version string, entries array<struct<{CATALOG.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
        return rows.select(F.explode("entries").alias("e")).select("e.*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CATALOG)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recollect")
    p.add_argument("--store", default="recollect-store")
    p.add_argument("--catalog", default="catalog.json")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> None:
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            q.add_argument(flag, action="store_true") if v is False else q.add_argument(flag, default=v, type=type(v) if isinstance(v, (int, float)) else str)

    add("init")
    add("add", "content", type="note", title=None)
    add("list", status=None)
    add("index", "path")
    add("search", "query", top_k=5)
    add("logs", limit=20)
    add("log", "id")
    add("set-status", "id", "status")
    add("stats")
    add("export", "path")
    add("import", "path")
    add("backups")
    add("restore", "version")
    add("ingest", "manifest", project_root=".", dry_run=False)
    add("discover", "home")
    add("global-search", "query", top_k=10, kind="all", include_inactive=False)
    add("global-status")
    add("context", "project", limit=20)
    add("sources", include=None, exclude=None, type=None)
    add("sources-confirm", "id", status="confirmed")
    add("sources-add", "source_type", "path", project=None)
    add("sources-from", "home")
    add("sources-cleanup", apply=False)
    add("global-refresh", apply=False, stability_seconds=120)
    add("migrate", apply=False)
    add("doctor")
    add("version")
    add("health")
    add("auto-run", apply=False, limit=300, per_source=8)
    add("auto-status")
    add("auto-review", limit=20, source=None)
    add("approve", "id")
    add("reject", "id")
    add("promote", "id", "title", "content", type="note")
    add("prune", apply=False, source=None, limit=100)
    add("task-open", "title", "type", project=None)
    add("task-step", "task", prompt=None, output=None, judgment=None, tokens=0, seconds=0.0)
    add("task-close", "task", outcome=None, comment=None)
    add("task-list", project=None, status=None, type=None)
    add("task-show", "task")
    add("calibration", project=None)
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    e, c = MemoryEngine(spark, args.store), args.command
    frames = {
        "list": lambda: e.list(args.status), "search": lambda: e.search(args.query, args.top_k), "logs": lambda: e.logs(args.limit), "log": lambda: e.log(args.id), "stats": e.stats, "global-search": lambda: e.global_search(args.query, args.top_k, args.kind, include_inactive=args.include_inactive),
        "global-status": lambda: e.status(_catalog(spark, args.catalog)), "auto-review": lambda: e.auto_review(args.limit, args.source), "auto-run": lambda: e.auto_run(not args.apply, limit=args.limit, per_source=args.per_source),
        "prune": lambda: e.prune(not args.apply, args.source, args.limit), "task-list": lambda: e.task_list(project=args.project, status=args.status, type=args.type), "add": lambda: e.add(args.content, args.type, args.title),
        "sources": lambda: catalogs.select_entries(_catalog(spark, args.catalog), tuple(filter(None, [args.include])), tuple(filter(None, [args.exclude])), args.type), "health": lambda: reports.cleanup_actions(e._t("source_ledger"), _catalog(spark, args.catalog)),
        "discover": lambda: _discover(spark, args.home), "sources-cleanup": lambda: e.cleanup(_catalog(spark, args.catalog), not args.apply), "global-refresh": lambda: e.global_refresh(_catalog(spark, args.catalog), dry_run=not args.apply, seconds=args.stability_seconds),
    }
    many = {"auto-status": lambda: e.auto_status(_catalog(spark, args.catalog)), "context": lambda: e.project_context(_catalog(spark, args.catalog), args.project, args.limit), "task-show": lambda: e.task_show(args.task), "calibration": lambda: e.calibration(args.project)}
    calls = {
        "sources-confirm": lambda: _save(spark, args.catalog, catalogs.confirm(_catalog(spark, args.catalog), [args.id], args.status)), "sources-add": lambda: _add_source(spark, args), "doctor": lambda: _doctor(spark, e, args.catalog), "version": lambda: VERSION,
        "sources-from": lambda: _save(spark, args.catalog, _merged(_catalog(spark, args.catalog), discovery.catalog_entries(_discover(spark, args.home)))), "migrate": lambda: _migrate(e, args.apply),
        "init": e.init, "index": lambda: e.index(args.path), "set-status": lambda: e.set_status(args.id, args.status), "export": lambda: e.store.export(args.path), "import": lambda: e.store.load_export(args.path), "backups": e.store.backups, "restore": lambda: e.store.restore(int(args.version)),
        "ingest": lambda: e.ingest(args.manifest, args.project_root, args.dry_run), "approve": lambda: e.approve(args.id), "reject": lambda: e.reject(args.id), "promote": lambda: e.promote(args.id, args.title, args.content, args.type), "task-open": lambda: e.task_open(args.title, args.type, args.project),
        "task-step": lambda: e.task_step_add(args.task, args.prompt, args.output, args.judgment, args.tokens, args.seconds), "task-close": lambda: e.task_close(args.task, None if args.outcome is None else int(args.outcome), args.comment),
    }
    if c in frames:
        _print(frames[c]())
    elif c in many:
        for name, df in many[c]().items():
            print(f"# {name}")
            _print(df)
    else:
        print(json.dumps({"result": calls[c]()}))


MAX_WARNINGS_PER_ROOT, MAX_WARNINGS = 10, 50


def _agent_texts(spark: SparkSession, home: str) -> tuple[DataFrame, list[str]]:
    """Texts of all agent roots below a home directory that are there, and warnings of those that cannot be read."""
    texts, warnings = spark.createDataFrame([], "label string, position struct<file:string,line_no:long,k:int>, file string, text string"), []
    for label, base, rest in history.AGENT_ROOTS:
        at = f"{home.rstrip('/')}/{base}/{rest}"
        if not files.exists(spark, at):
            continue
        try:
            own = history.history_texts(spark, at, label)
            files_cut = history.prose(spark, at).where("truncated").select("file").orderBy("file").limit(MAX_WARNINGS_PER_ROOT).collect()
        except Exception as e:  # one root's failure is its own
            warnings.append(f"{label}: {type(e).__name__}: {e}"[:200])
            continue
        warnings += [f"{label}: truncated {r['file']}" for r in files_cut]
        texts = texts.unionByName(own)
    return texts, warnings[:MAX_WARNINGS]


def _present(spark: SparkSession, scored: DataFrame, limit: int = 10_000) -> DataFrame:
    """Which of the first candidates' paths are there: path, is_dir. Only so many are looked up; the others count as absent."""
    rows = []
    for r in scored.where("section <> 'server_alias'").select("path").distinct().orderBy("path").limit(limit).collect():
        if files.exists(spark, r["path"]):
            rows.append((r["path"], files.is_dir(spark, r["path"])))
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def _discover(spark: SparkSession, home: str) -> DataFrame:
    """Scored candidates from the files of all agent roots; skill files are documents themselves."""
    texts, warnings = _agent_texts(spark, home)
    for w in warnings:
        print(w, file=sys.stderr)
    rows = texts.select("label", "position", "text")
    first = discovery.report(rows, spark.createDataFrame([], "path string, is_dir boolean"))
    found = discovery.report(rows, _present(spark, first))
    skills = history.skill_documents(texts)
    known = found.where("section = 'document'").select(F.col("path").alias("k_path"))
    return found.unionByName(skills.join(known, F.col("path") == F.col("k_path"), "left_anti")).orderBy("section", F.desc("confidence"), F.lower("path"))


def _save(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Write a catalog file; it is a small configuration that people edit. Returns how many entries it has."""
    entries = [json.loads(x) for x in rows.orderBy("source_type", "path_or_alias", "id").toJSON().collect()]
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps({"version": "1", "entries": entries}, indent=1, sort_keys=True).encode()))
    out.close()
    return len(entries)


def _add_source(spark: SparkSession, args: argparse.Namespace) -> int:
    old = _catalog(spark, args.catalog)
    kind = F.lit(args.source_type)
    row = spark.range(1).select(ids.source_id(args.source_type, F.lit(args.path)).alias("id"), kind.alias("source_type"), F.lit(args.path).alias("path_or_alias"), F.lit(args.project).alias("project_name"), F.array(F.lit("manual")).alias("discovered_from"), F.lit("confirmed").alias("confirmation_status"), F.lit("local_only").alias("privacy_scope"), F.lit(1.0).alias("confidence"), F.lit(1).alias("evidence_count"))
    if args.source_type not in CATALOG_TYPES:
        raise ValueError(f"type must be one of {', '.join(CATALOG_TYPES)}")
    return _save(spark, args.catalog, catalogs.upsert(old, row))


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """New candidates join the catalog; entries that are there keep their status."""
    return old.unionByName(new.join(old.select(F.col("id").alias("o_id")), F.col("id") == F.col("o_id"), "left_anti").select(*old.columns))


def _migrate(e: MemoryEngine, apply: bool) -> dict[str, object]:
    """Tables that this version of the schema has and the store has not; with apply they are made."""
    missing = sorted(set(TABLES) - set(e.store.current()["tables"]))
    if apply:
        e.init()
    return {"schema_version": SCHEMA_VERSION, "missing": missing, "applied": apply}


def _doctor(spark: SparkSession, e: MemoryEngine, catalog: str) -> dict[str, object]:
    """What is there: the store's version, its tables, the catalog."""
    state = e.store.current()
    return {"version": VERSION, "store": state["n"], "tables": sorted(state["tables"]), "missing": sorted(set(TABLES) - set(state["tables"])), "catalog": files.exists(spark, catalog), "spark": spark.version}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("recollect").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
