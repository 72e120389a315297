"""The engine's facade: a store with search, memory, refresh, review and task calls. All results are DataFrames."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recollect.functions import ids
from recollect.functions import text as T
from recollect.operators import candidates, chunking, context, embedding, entries, lifecycle, refresh, reports, retrieval, vector_index, vector_store
from recollect.schemas import CHUNK_CHARS, EMBEDDING_DIMENSIONS, JUDGMENTS, LEDGER_STATUSES, MEMORY_STATUSES, RECORD, SESSION_CHUNK_CHARS, STABILITY_SECONDS, TABLES, TASK_TYPES
from recollect.scratch import Scratch
from recollect.sources import files, manifest, store, walk
from recollect.sources.store import ConflictError, Store


def _now(at: datetime | None):
    return F.lit(at or datetime.now(timezone.utc)).cast("timestamp")


class MemoryEngine:
    """Times can be given as `at` to make runs repeatable.

    Calls that change tables work from one version of the store, and again from the next one if
    another writer came first; rows that are only added never conflict.
    """

    def __init__(self, spark: SparkSession, root: str, vectors: bool = True, embedder: vector_store.Embedder | None = None):
        """embedder: takes the place of the built-in hashing one for chunks and queries."""
        self.spark, self.store, self.vectors, self.embedder = spark, Store(spark, root), vectors, embedder
        self.counters: dict[str, int] = {}  # of the last refresh
        self._run: Scratch | None = None
        self._auto: Scratch | None = None

    def init(self) -> None:
        self.store.init()

    def close(self) -> None:
        """Delete the last runs' tables; the frames that they returned are lost."""
        for run in filter(None, (self._run, self._auto)):
            run.close()
        self._run = self._auto = None

    def _new_run(self) -> Scratch:
        if self._run is not None:
            self._run.close()
        self._run = Scratch(self.spark)
        return self._run

    def _new_auto(self) -> Scratch:
        if self._auto is not None:
            self._auto.close()
        self._auto = Scratch(self.spark)
        return self._auto

    def _t(self, name: str, base: dict | None = None) -> DataFrame:
        return self.store.read(name, base)

    def _edit(self, table: str, keys: DataFrame, key: str, new: Callable[[DataFrame], DataFrame]) -> int:
        """Change the rows of some keys; files without any stay."""
        return self.store.change(lambda base: {table: self.store.replaced(base, table, keys, key, new)})

    def _one(self, key: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{key} string")

    # memory

    def add(self, content: str, memory_type: str = "note", title: str | None = None, at: datetime | None = None) -> DataFrame:
        row = store.new_memory(self.spark, content, _now(at), memory_type, title)
        self.store.append({"memory_nodes": row})
        return row

    def list(self, status: str | None = None) -> DataFrame:
        if status is not None and status not in MEMORY_STATUSES:
            raise ValueError(f"status must be one of {', '.join(MEMORY_STATUSES)}")
        rows = self._t("memory_nodes")
        return (rows.where(F.col("status") == status) if status else rows).orderBy("created_at", "id")

    def set_status(self, memory_id: str, status: str, at: datetime | None = None) -> None:
        if status not in MEMORY_STATUSES:
            raise ValueError(f"status must be one of {', '.join(MEMORY_STATUSES)}")
        if self._t("memory_nodes").where(F.col("id") == memory_id).isEmpty():
            raise LookupError(memory_id)
        self._edit("memory_nodes", self._one("id", memory_id), "id", lambda old: lifecycle.set_status(old, memory_id, status, _now(at)))

    def set_ledger_status(self, source_id: str, status: str, error_message: str | None = None, at: datetime | None = None) -> DataFrame:
        """Set one source's status and message; returns its row."""
        if status not in LEDGER_STATUSES:
            raise ValueError(f"status must be one of {', '.join(LEDGER_STATUSES)}")
        if self.ledger_row(source_id).isEmpty():
            raise LookupError(source_id)
        hit = F.col("source_id") == source_id
        put = {"status": F.lit(status), "error_message": F.lit(error_message).cast("string"), "updated_at": _now(at)}
        self._edit("source_ledger", self._one("source_id", source_id), "source_id", lambda old: old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}))
        return self.ledger_row(source_id)

    # indexing

    def _indexed(self, records: DataFrame, now, preamble: bool, run: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows of documents and chunks for ingestion records (RECORD columns), and the documents that failed: document_id, error.

        Each record is a document. A document with a chunk that the embedder fails on is left out whole.
        """
        columns = {c: F.col(c) for c in records.columns}
        path = ids.exchange_path("source_path", "exchange_index") if "exchange_index" in columns else F.col("source_path")
        text = F.col("text")
        if preamble:
            fields = {k: columns[k] for k in ("project", "source_type", "source_tool", "source_path", "session_id", "created_at", "privacy_scope", "exchange_index", "session_line_count") if k in columns}
            if "last_modified" in columns:
                fields["last_modified"] = F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ssXXX")
            if "is_compaction" in columns:
                fields["is_compaction"] = F.when(F.col("is_compaction"), F.lit(True))
            text = T.with_preamble("text", fields)
        docs = records.select(ids.document_id(path).alias("id"), F.lit("default").alias("project_id"), path.alias("path"), T.basename(T.physical_path("source_path")).alias("filename"), ids.content_hash("text").alias("content_hash"), now.alias("last_indexed_at"), now.alias("created_at"), now.alias("updated_at"), text.alias("text"), "source_type")
        # of several records of one document, the one of the greatest hash counts, in every run
        docs = docs.groupBy("id").agg(F.max_by(F.struct(*(c for c in docs.columns if c != "id")), "content_hash").alias("r")).select("id", "r.*")
        docs = run.keep(docs, "documents")
        parts = None
        for kind, size in (("agent_session", SESSION_CHUNK_CHARS), (None, CHUNK_CHARS)):
            own = docs.where(F.col("source_type") == kind) if kind else docs.where(~F.col("source_type").eqNullSafe("agent_session"))
            cut = chunking.chunk(own, "text", size, ("id", "source_type"))
            parts = cut if parts is None else parts.unionByName(cut)
        rows = parts.withColumnRenamed("id", "document_id").withColumn("id", ids.chunk_id("document_id", "chunk_index")).withColumn("vector_point_id", ids.vector_point_id("id"))
        none = F.lit(None).cast("string")
        if self.embedder is not None:
            embed = vector_store.register_checked(self.spark, self.embedder)
            rows = rows.withColumn("e", embed("content")).withColumn("embedding", F.col("e.vector")).withColumn("error", F.col("e.error")).drop("e").withColumn("embedding_model", F.lit(self.embedder.name))
        elif self.vectors:
            v = embedding.embed(rows.select("id", "content")).withColumnRenamed("id", "v_id")
            rows = rows.join(v, F.col("id") == F.col("v_id"), "left").withColumn("embedding_model", F.lit("hashing")).withColumn("error", none)
        else:
            rows = rows.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("embedding_model", none).withColumn("error", none)
        names = [f.strip().split(" ")[0] for f in TABLES["chunks"].split(", ")]
        rows = run.keep(rows.withColumn("created_at", now).withColumn("updated_at", now).select(*names, "error"), "chunks")
        failed = rows.where("error is not null").groupBy("document_id").agg(F.min("error").alias("error"))
        if self.embedder is None:
            return docs.drop("text", "source_type"), rows.drop("error"), failed
        bad = failed.select(F.col("document_id").alias("bad_id"))
        fine = docs.join(bad, F.col("id") == F.col("bad_id"), "left_anti")
        return fine.drop("text", "source_type"), rows.join(bad, F.col("document_id") == F.col("bad_id"), "left_anti").drop("error"), failed

    def _taken_in(self, base: dict, docs: DataFrame, chunks: DataFrame) -> dict[str, list[dict]]:
        """The folders of documents and chunks with these rows in. A document whose new text gives no chunks loses its old ones, too."""
        own = docs.select(F.col("id").alias("document_id"))

        def swapped(old: DataFrame) -> DataFrame:
            gone = own.withColumnRenamed("document_id", "n_doc")
            return old.join(gone, F.col("document_id") == F.col("n_doc"), "left_anti").unionByName(chunks)

        return {
            "documents": self.store.replaced(base, "documents", docs, "id", lambda old: refresh.upsert(old, docs, "id")),
            "chunks": self.store.replaced(base, "chunks", own, "document_id", swapped),
        }

    def index_records(self, records: DataFrame, at: datetime | None = None, preamble: bool = True) -> int:
        """Chunk, embed and store ingestion records, each with a line of metadata before its text. Returns the version.

        A record that cannot be embedded stays out, and its earlier version in.
        """
        run = Scratch(self.spark)
        try:
            docs, chunks, _ = self._indexed(records, _now(at), preamble, run)
            return self.store.change(lambda base: self._taken_in(base, docs, chunks))
        finally:
            run.close()

    def index(self, path: str, at: datetime | None = None) -> int:
        rows = files.scan_project(self.spark, path).select(F.col("path").alias("source_path"), "text", F.lit("project_docs").alias("source_type"))
        return self.index_records(rows, at, preamble=False)

    def ingest(self, manifest_path: str, project_root: str, dry_run: bool = False, at: datetime | None = None) -> list[dict[str, str]]:
        records, report = manifest.ingest(self.spark, manifest.load_manifest(manifest_path), project_root)
        if records is not None and not dry_run:
            self.index_records(records, at)
        return report

    def _applied(self, base: dict, done: DataFrame, records: DataFrame, errors: DataFrame | None, now, run: Scratch) -> tuple[dict[str, list[dict]], DataFrame, DataFrame]:
        """After new and modified sources of a classified listing are indexed: folders of documents and chunks, changed ledger rows, all errors.

        records has a source_id. errors: source_id, error_message of sources that could not be read. A
        source that fails keeps its documents and chunks.
        """
        todo = done.where("action in ('new', 'modified')").select(F.col("source_id").alias("t_id"))
        own = records.join(todo, F.col("source_id") == F.col("t_id"), "left_semi")
        path = ids.exchange_path("source_path", "exchange_index") if "exchange_index" in records.columns else F.col("source_path")
        docs, chunks, failed = self._indexed(own, now, True, run)
        documents = own.select("source_id", ids.document_id(path).alias("c_doc")).distinct()
        wrong = documents.join(failed, F.col("c_doc") == F.col("document_id")).groupBy("source_id").agg(F.min("error").alias("error_message"))
        errors = run.keep(wrong if errors is None else errors.unionByName(wrong), "errors")
        counts = documents.join(chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count")), F.col("c_doc") == F.col("document_id"), "left").groupBy("source_id").agg(F.sum("chunk_count").alias("chunk_count"))
        # rows of the ledger that the listing has nothing to say about stay where they are
        met = done.select(F.col("source_id").alias("d_id")).distinct()
        ledger = self._t("source_ledger", base).join(met, F.col("source_id") == F.col("d_id"), "left_semi")
        after = refresh.touched(done, refresh.ledger_after(done, ledger, now, errors, counts))
        if "project" in records.columns:
            names = records.groupBy(F.col("source_id").alias("p_id")).agg(F.max("project").alias("p_name"))
            after = after.join(names, F.col("source_id") == F.col("p_id"), "left").withColumn("project_name", F.coalesce("project_name", "p_name")).drop("p_id", "p_name")
        return self._taken_in(base, docs, chunks), run.keep(after, "ledger"), errors

    def _ledger_with(self, base: dict, rows: DataFrame) -> list[dict]:
        return self.store.replaced(base, "source_ledger", rows, "source_id", lambda old: refresh.upsert(old, rows, "source_id"))

    def refresh(self, listing: DataFrame, records: DataFrame, at: datetime | None = None, dry_run: bool = True) -> DataFrame:
        """Classify a listing against the ledger; unless dry, index the new and modified sources and update the ledger, all in one version."""
        now, base, run = _now(at), self.store.current(), self._new_run()
        done = run.keep(refresh.classify(listing, self._t("source_ledger", base), now), "actions")
        if not dry_run:
            folders, ledger, _ = self._applied(base, done, records, None, now, run)
            self.store.commit(base, folders | {"source_ledger": self._ledger_with(base, ledger)})
        return done

    def global_refresh(self, catalog: DataFrame, at: datetime | None = None, dry_run: bool = True, seconds: int = STABILITY_SECONDS, auto_memory: bool = False) -> DataFrame:
        """Walk the catalog's confirmed entries and bring store and ledger up to date, in one version.

        Returns one row for each entry that is not walked and each source found or gone, with its
        action; the frame lasts until the next refresh or close(). `counters` then holds the
        run's counts, observed by the action that wrote them. Trees are listed without opening
        files; only files whose ledger rows do not all say active, and of the same time, are opened. A
        file that cannot be read, or a record that cannot be indexed, becomes an error, and what is
        stored of it stays; an entry that cannot be read likewise. With auto_memory, memory
        candidates are admitted afterwards and counted. A dry run changes nothing in the store.
        If another version comes in between, the run starts anew.
        """
        for left in (2, 1, 0):
            try:
                done = self._refreshed(catalog, _now(at), dry_run, seconds)
                break
            except ConflictError:
                if not left:
                    raise
        if auto_memory:
            self.counters |= self._auto_counters(self.auto_run(dry_run, at))
        return done

    def _auto_counters(self, admitted: DataFrame) -> dict[str, int]:
        """The counts of a run over memory candidates."""
        n = lambda *states: F.count_if(F.col("state").isin(*states))
        names = {"duplicate_active": "duplicate_active", "duplicate_unverified": "duplicate_unverified", "duplicate_rejected": "duplicate_rejected", "low_confidence": "low_confidence", "limit_skipped": "limit", "source_limit_skipped": "source_limit", "non_document_skipped": "non_document", "noisy_session_skipped": "noisy", "created": "created"}
        row = admitted.agg(F.count_if(F.col("verdict") == "candidate").alias("candidates"), F.count_if(F.col("state").startswith("duplicate_")).alias("duplicates"), *(n(s).alias(k) for k, s in names.items())).first()
        return {f"auto_memory_{k}": v for k, v in row.asDict().items()}

    def _parsed(self, kind: str, stale: DataFrame, entry, run: Scratch) -> DataFrame:
        """Records of one entry's stale files, by the parser registered for its kind; read now, so that a failure is this entry's."""
        paths = [r["path"] for r in stale.select("path").distinct().collect()]
        name = entry["project_name"] or os.path.basename(entry["path_or_alias"].replace("\\", "/").rstrip("/"))
        more = {"run": run} if manifest.PARSERS[kind] is manifest.session_records else {}
        own = manifest.PARSERS[kind](self.spark, paths, name, (entry["discovered_from"] or ["global-refresh"])[0], entry["privacy_scope"] or "local_only", **more)
        return run.keep(own, "records")

    def _refreshed(self, catalog: DataFrame, now, dry_run: bool, seconds: int) -> DataFrame:
        run, base = self._new_run(), self.store.current()
        rows = catalog.where("confirmation_status = 'confirmed'").collect()  # a configuration, not data
        failed, there = {}, []
        for r in rows:
            try:
                if r["path_or_alias"] and files.exists(self.spark, r["path_or_alias"]):
                    there.append((r["path_or_alias"],))
            except OSError as e:  # not there and not gone
                there.append((r["path_or_alias"],))
                failed[r["id"]] = str(e)[:200]
        plan = entries.dispatch(catalog, self.spark.createDataFrame(there, "path string"))
        actions = {r["id"]: r["action"] for r in plan.collect()}
        walked = {i: r for i, r in enumerate(rows) if actions.get(r["id"]) == "walk" and r["id"] not in failed}
        kinds = {i: entries.PARSED_AS[r["source_type"]] for i, r in walked.items()}

        # what is there, and which of it may have changed
        rules = {i: files.DOCUMENTS if kind == "project_docs" else files.LOGS for i, kind in kinds.items()}
        listed = run.keep(walk.listing(self.spark, [(i, r["path_or_alias"]) for i, r in walked.items()], rules, run), "listing")
        roots = {(i, files.plain_text(walk.absolute(r["path_or_alias"]))) for i, r in walked.items()}
        problems = listed.where("problem is not null")
        for r in problems.select("entry", "path", "problem").limit(10_000).collect():
            if (r["entry"], files.plain_text(r["path"])) in roots:
                failed[walked[r["entry"]]["id"]] = r["problem"]
        there_now = listed.where("problem is null").withColumn("plain", files.plain("path"))
        ledger = self._t("source_ledger", base).withColumn("plain", T.physical_path(files.plain("source_path_or_alias")))
        stale = refresh.needs_hash(there_now.select(F.col("plain").alias("path"), "modified").distinct(), ledger.withColumn("source_path_or_alias", F.col("plain")))
        stale = run.keep(there_now.join(stale.select(F.col("path").alias("s_path")), F.col("plain") == F.col("s_path"), "left_semi"), "stale")

        # only those are opened: documents of all entries in one pass, logs entry by entry
        set_based = {i for i, kind in kinds.items() if kind == "project_docs" and manifest.PARSERS[kind] is manifest.document_records}
        records = self.spark.createDataFrame([], RECORD)
        opened, errors = Observation(), self.spark.createDataFrame([], "source_id string, source_path string, source_type string, error_message string, modified timestamp")
        self.counters = {"files_opened": 0}
        if set_based:
            about = self.spark.createDataFrame([(i, r["project_name"] or os.path.basename(r["path_or_alias"].replace("\\", "/").rstrip("/")), (r["discovered_from"] or ["global-refresh"])[0], r["privacy_scope"] or "local_only") for i, r in walked.items() if i in set_based], "a_entry int, project string, source_tool string, privacy_scope string")
            # a file of several entries is the first one's
            own = stale.where(F.col("entry").isin(list(set_based))).groupBy("path").agg(F.min("entry").alias("entry"), F.max("modified").alias("modified"), F.max("length").alias("length"))
            texts = walk.read_texts(own.join(F.broadcast(about), F.col("entry") == F.col("a_entry")).drop("entry", "a_entry"))
            texts = run.keep(texts, "texts", opened, n=F.count("*"))
            self.counters["files_opened"] = opened.get["n"]
            found = files.as_records(texts)
            records = records.unionByName(found.where("error is null").where(T.passes_alpha_filter("text")).drop("error"))
            errors = found.where("error is not null").select(ids.source_id("source_type", F.col("source_path")).alias("source_id"), "source_path", "source_type", F.col("error").alias("error_message"), F.col("last_modified").alias("modified"))
        for i, r in walked.items():
            if i in set_based or r["id"] in failed:
                continue
            try:
                mine = stale.where(F.col("entry") == i)
                records = records.unionByName(self._parsed(kinds[i], mine, r, run), allowMissingColumns=True)
                self.counters["files_opened"] += mine.select("path").distinct().count()
            except Exception as e:  # one entry's failure is its own
                failed[r["id"]] = f"{type(e).__name__}: {e}"[:200]
        if failed:
            told = self.spark.createDataFrame(list(failed.items()), "f_id string, f_text string")
            plan = plan.join(F.broadcast(told), F.col("id") == F.col("f_id"), "left").select("id", "path_or_alias", "source_type", F.when(F.col("f_id").isNotNull(), "error").otherwise(F.col("action")).alias("action"), F.coalesce("f_text", "reason").alias("reason"))

        # against the ledger
        path = ids.exchange_path("source_path", "exchange_index")
        records = run.keep(records.withColumn("source_id", ids.source_id(F.col("source_type"), path)), "records")
        new = records.groupBy("source_id").agg(F.min(path).alias("source_path"), F.min("source_type").alias("source_type"), F.max(ids.content_hash("text")).alias("content_hash"), F.max("last_modified").alias("modified"))
        new = new.unionByName(errors.select("source_id", "source_path", "source_type", F.lit(None).cast("string").alias("content_hash"), "modified"))
        gone = [r["path_or_alias"] for r in rows if actions.get(r["id"]) == "missing"]
        whole = [files.plain_text(walk.absolute(r["path_or_alias"])) for r in walked.values() if r["id"] not in failed]
        seen = ledger.join(new.select(F.col("source_id").alias("l_id")), F.col("source_id") == F.col("l_id"), "left_semi")
        lost = ledger.where(entries.inside_any(F.col("plain"), [*whole, *map(files.plain_text, gone)]))
        lost = lost.join(there_now.select(F.col("plain").alias("h_path")).distinct(), F.col("plain") == F.col("h_path"), "left_anti")  # the file itself is gone, not just a part of it
        lost = entries.outside(lost, problems.select(files.plain("path").alias("dir")))  # what could not be listed is not gone
        lost = lost.join(new.select(F.col("source_id").alias("k_id")), F.col("source_id") == F.col("k_id"), "left_anti")
        columns = self._t("source_ledger", base).columns
        done = refresh.classify(new, seen.select(columns).unionByName(lost.select(columns)), now, seconds)
        fresh = there_now.join(stale.select(F.col("plain").alias("s_plain")).distinct(), F.col("plain") == F.col("s_plain"), "left_anti").select(F.col("plain").alias("f_plain"), F.col("modified").alias("f_time")).distinct()
        done = run.keep(done.unionByName(refresh.as_unchanged(ledger.join(fresh, F.col("plain") == F.col("f_plain")), "f_time")), "classified")
        if not dry_run:
            folders, after, errors = self._applied(base, done, records, errors.select("source_id", "error_message"), now, run)
            after = after.unionByName(entries.ledger_rows(plan, catalog, now).select(*after.columns))
            self.store.commit(base, folders | {"source_ledger": self._ledger_with(base, after)})
        wrong = errors.select(F.col("source_id").alias("w_id"), "error_message").groupBy("w_id").agg(F.min("error_message").alias("w_text"))
        told = done.join(wrong, F.col("source_id") == F.col("w_id"), "left").withColumn("action", F.when(F.col("w_id").isNotNull() & F.col("action").isin("new", "modified"), "error").otherwise(F.col("action"))).withColumn("reason", F.coalesce("w_text", "reason")).drop("w_id", "w_text")
        told = told.unionByName(entries.as_actions(plan)).unionByName(entries.listing_errors(problems, [r for r in roots]))
        counted, n = Observation(), lambda a: F.count_if(F.col("action") == a)
        out = run.keep(told, "actions", counted, new=n("new"), modified=n("modified"), unchanged=n("unchanged"), skipped=n("skipped"), missing=n("missing"), errors=n("error"))
        got = counted.get
        self.counters |= got | {"indexed_records": 0 if dry_run else got["new"] + got["modified"], "catalog_entries": len(rows)}
        return out

    def refresh_report(self, actions: DataFrame) -> DataFrame:
        """One row of counters over the actions of a refresh."""
        n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
        return actions.agg(F.count("*").alias("total"), *(n(a) for a in ("new", "modified", "unchanged", "missing", "skipped", "error")))

    # plain texts and lookups

    def add_text(self, text: str, metadata: dict | None = None, at: datetime | None = None) -> DataFrame:
        """Append to the plain text table; ids count up from 1."""
        self.store.change(lambda base: {"memories": self.store.appended(base, "memories", self.store.write("memories", store.legacy_text(self._t("memories", base), text, metadata, _now(at))))})
        return self._t("memories").orderBy(F.desc("id")).limit(1)

    def memory_by_hash(self, content: str) -> DataFrame:
        """The oldest memory of this content, if there is one."""
        return self._t("memory_nodes").where(F.col("content_hash") == hashlib.sha256(content.encode()).hexdigest()).orderBy("created_at", "id").limit(1)

    def ledger_row(self, source_id: str) -> DataFrame:
        return self._t("source_ledger").where(F.col("source_id") == source_id)

    # search

    def search(self, query: str, top_k: int = 5, at: datetime | None = None, log: bool = True) -> DataFrame:
        """Semantic hits if there are any, else lexical ones; logged unless the query has no tokens."""
        retrieval.check_top_k(top_k)
        if not retrieval.query_terms(query):
            return retrieval.project_search(self._t("chunks"), self._t("documents"), None, self._t("memory_nodes"), query, top_k)
        vector = self.embedder.embed([query])[0] if self.embedder is not None else embedding.embed_text(query) if self.vectors else None
        hits = retrieval.project_search(self._t("chunks"), self._t("documents"), self._t("source_ledger"), self._t("memory_nodes"), query, top_k, vector)
        if not log:
            return hits
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # top_k rows: found once, logged and returned
        self._log(hits, query, top_k, _now(at))
        return hits

    def _log(self, hits: DataFrame, query: str, top_k: int, now) -> None:
        each = F.struct((-F.col("score")).alias("s"), "kind_rank", "id", F.struct(*retrieval.PAYLOAD).alias("hit"))
        row = hits.agg(F.count("*").cast("int").alias("result_count"), F.transform(F.array_sort(F.collect_list(each)), lambda x: x["hit"]).alias("results"))
        key = F.substring(F.sha2(F.concat_ws("|", F.lit(query), now.cast("string")).cast("binary"), 256), 1, 32)
        row = row.select(F.concat(F.lit("ret_"), key).alias("id"), F.lit("default").alias("project_id"), F.lit(query).alias("query"), F.lit(top_k).alias("top_k"), "result_count", "results", now.alias("created_at"))
        self.store.append({"retrieval_logs": row})

    def _vector_index(self) -> vector_index.VectorIndex:
        size = self.embedder.dimensions if self.embedder is not None else EMBEDDING_DIMENSIONS
        return vector_index.VectorIndex(self.spark, f"{self.store.root}/vectors", size)

    def sync_vectors(self) -> tuple[int, int]:
        """Bring the index of chunk vectors up to the store: how many chunks went in, and how many out."""
        return vector_index.sync(self._vector_index(), self._t("chunks"))

    def semantic_search(self, query: str, top_k: int = 5, probe: int | None = None) -> DataFrame:
        """The best visible chunks by similarity from the index of vectors; `probe` cells of it, or all.

        Chunks changed since the last sync_vectors() are no hits until the next one.
        """
        retrieval.check_top_k(top_k)
        vector = vector_store.HashingEmbedder().embed([query])[0] if self.embedder is None else self.embedder.embed([query])[0]
        hits = vector_index.semantic_hits(self._vector_index(), self._t("chunks"), self._t("documents"), self._t("source_ledger"), vector, top_k, probe, stamped=True)
        return hits.select("id", "path", "heading_path", "content", "score").orderBy(F.desc("score"), "id")

    def global_search(self, query: str, top_k: int = 10, kind: str = "all", **more) -> DataFrame:
        return retrieval.global_search(self._t("chunks"), self._t("documents"), self._t("source_ledger"), self._t("memory_nodes"), query, top_k, kind, **more)

    def logs(self, limit: int = 20) -> DataFrame:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        return self._t("retrieval_logs").orderBy(F.desc("created_at"), "id").limit(limit)

    def log(self, log_id: str) -> DataFrame:
        return self._t("retrieval_logs").where(F.col("id") == log_id)

    # reports

    def stats(self) -> DataFrame:
        return reports.table_counts(**{t: self._t(t) for t in ("documents", "chunks", "memory_nodes", "retrieval_logs")})

    def status(self, catalog: DataFrame) -> DataFrame:
        return reports.global_status(self._t("source_ledger"), catalog, self._t("documents"), self._t("chunks"), self._t("memory_nodes"))

    def readiness(self, catalog: DataFrame, at: datetime | None = None) -> DataFrame:
        return reports.readiness(self._t("source_ledger"), catalog, _now(at))

    def auto_status(self, catalog: DataFrame, at: datetime | None = None) -> dict[str, DataFrame]:
        """Everything on one page: counts, readiness, expected skips, their reasons, unstable files, passing and stale ones, candidates."""
        ledger, now = self._t("source_ledger"), _now(at)
        found = candidates.candidates(self._t("chunks"), self._t("documents"), ledger)
        return {
            "status": self.status(catalog), "readiness": self.readiness(catalog, at), "skips": reports.skip_split(ledger), "reasons": reports.skip_reasons(ledger), "unstable": reports.unstable_files(ledger, now),
            "freshness": reports.freshness_split(ledger, now), "candidates": candidates.telemetry(found, candidates.blocklist(self._t("memory_nodes"))),
        }

    def cleanup(self, catalog: DataFrame, dry_run: bool = True, at: datetime | None = None) -> DataFrame:
        """What the health report would do to the ledger; unless dry, it is done."""
        actions = reports.cleanup_actions(self._t("source_ledger"), catalog)
        if not dry_run:
            # the actions follow from the version that they are applied to
            fresh = lambda base: reports.cleanup_actions(self._t("source_ledger", base), catalog)
            self.store.change(lambda base: {"source_ledger": self.store.replaced(base, "source_ledger", fresh(base), "source_id", lambda old: reports.apply_cleanup(old, fresh(base), _now(at)))})
        return actions

    def project_context(self, catalog: DataFrame, project: str, limit: int = 20) -> dict[str, DataFrame]:
        if not project.strip():
            raise ValueError("project cannot be empty")
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        roots = context.resolve(catalog.where("confirmation_status = 'confirmed' and source_type = 'project_root'"), project)
        one = roots.where("not ambiguous")
        docs = context.documents_of(self._t("documents"), self._t("source_ledger"), one)
        return {"roots": roots, "ledger": context.ledger_rows(self._t("source_ledger"), one), "documents": docs, "chunks": context.excerpts(self._t("chunks"), docs, limit), "memories": context.memories(self._t("memory_nodes"), ["default"], limit), "related_documents": context.related_documents(catalog, one), "related_servers": context.related_servers(catalog, one)}

    # candidates and review

    def auto_run(self, dry_run: bool = True, at: datetime | None = None, **limits) -> DataFrame:
        """Admit memory candidates; unless dry, the created ones are stored."""
        def admitted(base: dict) -> DataFrame:
            found = candidates.candidates(*(self._t(t, base) for t in ("chunks", "documents", "source_ledger")))
            return (candidates.admit if dry_run else candidates.admit_in_order)(found, candidates.blocklist(self._t("memory_nodes", base)), **limits)

        if dry_run:
            return admitted(self.store.current())
        runs: list[DataFrame] = []

        def made(base: dict) -> dict[str, list[dict]]:
            # written once, so that the frame returned tells what was created, whatever is stored later
            runs.append(self._new_auto().keep(admitted(base), "admitted"))
            return {"memory_nodes": self.store.appended(base, "memory_nodes", self.store.write("memory_nodes", candidates.new_memories(runs[-1], _now(at))))}

        self.store.change(made)
        return runs[-1]

    def auto_review(self, limit: int = 20, source: str | None = None) -> DataFrame:
        return lifecycle.review_list(self._t("memory_nodes"), limit, source_filter=source)

    def approve(self, memory_id: str, at: datetime | None = None) -> int:
        return self._edit("memory_nodes", self._one("id", memory_id), "id", lambda old: lifecycle.approve(old, F.col("id") == memory_id, _now(at)))

    def reject(self, memory_id: str, at: datetime | None = None) -> int:
        return self._edit("memory_nodes", self._one("id", memory_id), "id", lambda old: lifecycle.reject(old, F.col("id") == memory_id, _now(at)))

    def promote(self, memory_id: str, title: str, content: str, memory_type: str = "note", at: datetime | None = None) -> int:
        """Whether the content is free is a question to the whole table, so the change is made from one version of it."""

        def made(base: dict) -> dict[str, list[dict]]:
            whole = self._t("memory_nodes", base)
            new = lifecycle.promote(whole, memory_id, title, content, _now(at), memory_type)
            changed = new.where(F.col("updated_at") == _now(at)).join(whole.select(F.col("id").alias("w_id"), F.col("updated_at").alias("w_time")), (F.col("id") == F.col("w_id")) & (F.col("updated_at") == F.col("w_time")), "left_anti")
            return {"memory_nodes": self.store.replaced(base, "memory_nodes", changed, "id", lambda old: refresh.upsert(old, changed, "id"))}

        return self.store.change(made)

    def prune(self, dry_run: bool = True, source: str | None = None, limit: int = lifecycle.PRUNE_LIMIT, at: datetime | None = None) -> DataFrame:
        rows = lifecycle.prunable(self._t("memory_nodes"), source, limit)
        if not dry_run:

            def made(base: dict) -> dict[str, list[dict]]:
                whole = self._t("memory_nodes", base)
                pruned = lifecycle.prune(lifecycle.prunable(whole, source, limit), _now(at), source, limit)
                return {"memory_nodes": self.store.replaced(base, "memory_nodes", pruned, "id", lambda old: refresh.upsert(old, pruned, "id"))}

            self.store.change(made)
        return rows

    # tasks

    def _row(self, table: str, **values) -> DataFrame:
        return self.spark.range(1).select(*(F.lit(values.get(n)).cast(t).alias(n) for n, t in (f.strip().split(" ", 1) for f in TABLES[table].split(", "))))

    def task_open(self, title: str, task_type: str, project: str | None = None, session: str | None = None, at: datetime | None = None) -> str:
        if not title.strip():
            raise ValueError("title cannot be empty")
        if task_type not in TASK_TYPES:
            raise ValueError(f"type must be one of {', '.join(TASK_TYPES)}")
        at = at or datetime.now(timezone.utc)
        key = "task_" + hashlib.sha256(f"{title}|{task_type}|{project}|{at.isoformat()}".encode()).hexdigest()[:32]
        self.store.append({"tasks": self._row("tasks", task_id=key, title=title.strip(), type=task_type, project=project, agent_session_id=session, status="open", created_at=at)})
        return key

    def _task(self, task_id: str) -> None:
        if self._t("tasks").where(F.col("task_id") == task_id).isEmpty():
            raise LookupError(task_id)

    def task_step_add(self, task_id: str, prompt: str | None = None, output: str | None = None, judgment: str | None = None, tokens: int | None = None, seconds: float | None = None, model: str | None = None, at: datetime | None = None) -> int:
        self._task(task_id)
        if judgment is not None and judgment not in JUDGMENTS:
            raise ValueError(f"judgment must be one of {', '.join(JUDGMENTS)}")
        at, used = at or datetime.now(timezone.utc), []

        def made(base: dict) -> dict[str, list[dict]]:
            own = self._t("task_steps", base).where(F.col("task_id") == task_id)
            used.append(own.agg((F.coalesce(F.max("step_index"), F.lit(-1)) + 1).alias("i")).first()["i"])
            row = self._row("task_steps", step_id=f"step_{task_id}_{used[-1]}", task_id=task_id, step_index=used[-1], prompt_used=prompt, output=output, brain_judgment=judgment, tokens_used=tokens, duration_s=seconds, model_used=model, created_at=at)
            return {"task_steps": self.store.appended(base, "task_steps", self.store.write("task_steps", row))}

        self.store.change(made)
        return used[-1]

    def verifier_round_add(self, task_id: str, suggestion_type: str, accepted: bool, rationale: str | None = None, step_id: str | None = None, at: datetime | None = None) -> None:
        self._task(task_id)
        at = at or datetime.now(timezone.utc)

        def made(base: dict) -> dict[str, list[dict]]:
            n = self._t("verifier_rounds", base).where(F.col("task_id") == task_id).count()
            row = self._row("verifier_rounds", round_id=f"vround_{task_id}_{n}", task_id=task_id, step_id=step_id, suggestion_type=suggestion_type, brain_accepted=accepted, brain_rationale=rationale, created_at=at)
            return {"verifier_rounds": self.store.appended(base, "verifier_rounds", self.store.write("verifier_rounds", row))}

        self.store.change(made)

    def task_close(self, task_id: str, outcome: int | None = None, comment: str | None = None, at: datetime | None = None) -> None:
        """Close a task with the sums of its steps; without an outcome it is unrated."""
        self._task(task_id)
        if outcome not in (None, 1, 0, -1):
            raise ValueError("outcome must be 1, 0 or -1")

        def closed(base: dict, tasks: DataFrame) -> DataFrame:
            sums = reports.task_rollup(tasks.where(F.col("task_id") == task_id), self._t("task_steps", base)).select(F.col("task_id").alias("s_id"), F.col("total_tokens").alias("s_tokens"), F.col("total_duration_s").alias("s_seconds"))
            rows = tasks.join(F.broadcast(sums), F.col("task_id") == F.col("s_id"), "left")
            hit = F.col("s_id").isNotNull()
            put = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
            new = {"status": F.lit("closed" if outcome is not None else "unrated"), "human_outcome": F.lit(outcome).cast("int"), "human_comment": F.lit(comment).cast("string"), "total_tokens": F.col("s_tokens"), "total_duration_s": F.col("s_seconds"), "closed_at": _now(at)}
            return rows.select(*(put(c, new[c]) if c in new else F.col(c) for c in tasks.columns))

        self.store.change(lambda base: {"tasks": self.store.replaced(base, "tasks", self._one("task_id", task_id), "task_id", lambda old: closed(base, old))})

    def task_list(self, **equal) -> DataFrame:
        return reports.list_tasks(self._t("tasks"), **equal)

    def task_show(self, task_id: str) -> dict[str, DataFrame]:
        self._task(task_id)
        return {"task": self._t("tasks").where(F.col("task_id") == task_id), "steps": self._t("task_steps").where(F.col("task_id") == task_id).orderBy("step_index")}

    def calibration(self, project: str | None = None) -> dict[str, DataFrame]:
        return {"verifier": reports.verifier_acceptance(self._t("verifier_rounds"), self._t("tasks"), project), "judgments": reports.judgment_outcomes(self._t("tasks"), self._t("task_steps"), project)}


#: Tool calls by name, for hosts that dispatch by name.
TOOLS = {
    "memory_search": MemoryEngine.search, "memory_add": MemoryEngine.add, "global_status": MemoryEngine.status, "global_project_context": MemoryEngine.project_context,
    "task_open": MemoryEngine.task_open, "task_step_add": MemoryEngine.task_step_add, "task_close": MemoryEngine.task_close,
}
