"""Queries of candidates, life cycles, refresh, reports and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import candidates as C
from recollect.operators import lifecycle as L
from recollect.operators import refresh as R
from recollect.operators import reports as P
from recollect.plans import fixtures as fx
from recollect.plans import sql as S
from recollect.sources import store

def _now() -> Column:
    return F.lit(fx.NOW).cast("timestamp")


def _found(spark: SparkSession, d: str) -> DataFrame:
    return C.candidates(fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d))


def _blocked(spark: SparkSession, d: str) -> DataFrame:
    """Memories whose content is that of some candidates, so that all reasons occur."""
    m = fx.memory(spark, d).where("status <> 'active' or type = 'note'")
    return C.blocklist(m.withColumn("content_hash", F.sha2(T.strip("content").cast("binary"), 256)))


def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = _found(spark, d).where("verdict = 'candidate'")
    return rows.orderBy(*C.ranking()).limit(60).select("source_chunk_id", "source_path", "tokens", "is_compaction", "confidence", "content_hash")


def candidate_states(spark: SparkSession, d: str) -> DataFrame:
    rows = C.admit(_found(spark, d), _blocked(spark, d), 0.55, 0, 0)
    return rows.select("source_chunk_id", "state")


def candidate_caps(spark: SparkSession, d: str) -> DataFrame:
    """One source for each project here, so that both caps bind."""
    rows = _found(spark, d).withColumn("source_path", F.substring_index("source_path", "/", 3)).withColumn("verdict", F.lit("candidate"))
    done = C.admit(rows, _blocked(spark, d).where(F.lit(False)), 0.0, 40, 4)
    return done.select("source_chunk_id", "source_path", "state")


def candidate_in_order(spark: SparkSession, d: str) -> DataFrame:
    return C.admit_in_order(_found(spark, d), _blocked(spark, d), 0.55, 100, 3).select("source_chunk_id", "source_path", "state")


def candidate_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Without a limit, one source for each project, and contents by their first words, so that both the cap and repeats bind."""
    rows = _found(spark, d).withColumn("source_path", F.substring_index("source_path", "/", 3)).withColumn("content_hash", F.lower(F.substring("content", 1, 2)))
    return C.admit_in_order(rows, _blocked(spark, d).where(F.lit(False)), 0.0, 0, 7).select("source_chunk_id", "source_path", "state")


def blocklist_reasons(spark: SparkSession, d: str) -> DataFrame:
    return C.blocklist(fx.memory(spark, d).unionByName(fx.memory(spark, d).withColumn("status", F.lit("active")).where("id like '%7'")))


def blocklist_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text is blocked."""
    texts = fx.load(spark, d, "documents").select("doc_id", F.sha2(T.strip("text").cast("binary"), 256).alias("content_hash"))
    return texts.join(_blocked(spark, d), "content_hash").select("doc_id", "reason")


def candidate_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return C.telemetry(_found(spark, d), _blocked(spark, d), 0.55)


def noisy_transcripts(spark: SparkSession, d: str) -> DataFrame:
    shapes = F.expr("""case turn % 5 when 0 then concat('[User]: ', text) when 1 then concat('1. run `git status`\n2. check `ls -la`\n', text) when 2 then concat('3. All user messages: ', text) when 3 then concat(text, ' Continue the conversation from where it left off') else text end""")
    return fx.load(spark, d, "conversations").where(C.noisy_transcript(shapes)).select("conv_id", "turn")


def json_dump_filter(spark: SparkSession, d: str) -> DataFrame:
    e = fx.load(spark, d, "events").withColumn("t", F.expr("""case event_id % 3 when 0 then concat(' {"x": ', props, ', "type" : 1}') else props end"""))
    return e.where(C.json_dump("t")).select("event_id")


def approve_guard(spark: SparkSession, d: str) -> DataFrame:
    m = fx.memory(spark, d)
    return L.approve(m, F.col("id").endswith("6"), _now()).select("id", "status", F.col("updated_at").cast("string").alias("updated_at"))


def reject_guard(spark: SparkSession, d: str) -> DataFrame:
    return L.reject(fx.memory(spark, d), F.col("id").endswith("6"), _now()).groupBy("status").agg(F.count("*").alias("n"))


def prune_select(spark: SparkSession, d: str) -> DataFrame:
    return L.prunable(fx.memory(spark, d), "SRC1", 15).select("id", F.length("content").alias("n"))


def prune_apply(spark: SparkSession, d: str) -> DataFrame:
    return L.prune(fx.memory(spark, d), _now(), None, 10).select("id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), "content_hash", F.col("updated_at").cast("string").alias("updated_at"))


def promote_snapshot(spark: SparkSession, d: str) -> DataFrame:
    m = fx.memory(spark, d)
    one = "m16"  # generated and unverified
    return L.promote(m, one, "A  curated title", "curated content", _now()).groupBy("status", "source_kind").agg(F.count("*").alias("n"))


def literal_like_filter(spark: SparkSession, d: str) -> DataFrame:
    return fx.memory(spark, d).where(T.contains_literal("title", "%") | T.contains_literal("source_path", "SRC1/NOTES")).select("id")


def review_by_source(spark: SparkSession, d: str) -> DataFrame:
    return L.review_by_source(fx.memory(spark, d))


def review_list(spark: SparkSession, d: str) -> DataFrame:
    return L.review_list(fx.memory(spark, d), 25).select("id", "source_path", "title", "content_excerpt")


def ledger_transitions(spark: SparkSession, d: str) -> DataFrame:
    led = fx.ledger(spark, d).select("status").distinct()
    pairs = led.select(F.col("status").alias("previous")).union(spark.createDataFrame([(None,)], "previous string"))
    nexts = spark.createDataFrame([(s,) for s in ("active", "missing", "error", "skipped", "pending")], "following string")
    # five known statuses against six
    return pairs.join(F.broadcast(nexts)).select("previous", "following", L.transition_allowed(F.col("previous"), F.col("following")).alias("allowed"))


def refresh_classify(spark: SparkSession, d: str) -> DataFrame:
    return R.classify(fx.listing(spark, d), fx.known(spark, d), _now()).select("source_id", "source_path", "action", "reason", "previous_status", "previous_hash")


def refresh_counters(spark: SparkSession, d: str) -> DataFrame:
    return R.counters(R.classify(fx.listing(spark, d), fx.known(spark, d), _now()))


def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.detail_summary(R.classify(fx.listing(spark, d), fx.known(spark, d), _now()))


def mtime_fast_path(spark: SparkSession, d: str) -> DataFrame:
    files = fx.listing(spark, d).select(F.col("source_path").alias("path"), "modified")
    return R.needs_hash(files, fx.known(spark, d)).select("path")


def stability_gate(spark: SparkSession, d: str) -> DataFrame:
    return fx.listing(spark, d).where(R.stable(F.col("modified"), _now())).select("source_id")


def missing_detection(spark: SparkSession, d: str) -> DataFrame:
    known, seen = fx.known(spark, d), fx.listing(spark, d)
    physical = known.where("source_id like '%2'").select(F.col("source_path_or_alias").alias("path"))
    return R.missing_sources(known, seen, physical, "/srv/SRC1/").select("source_id")


def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    known = fx.known(spark, d)
    new = fx.listing(spark, d).where("source_id like '%3' or source_id like '%0'").selectExpr(
        "source_id", "source_path as source_path_or_alias", "cast(null as string) as project_name", "source_type", "'1' as parser_version", "content_hash", "modified as last_modified_at", f"timestamp'{fx.NOW}' as last_indexed_at", "'pending' as status", "cast(null as string) as error_message", "0 as chunk_count", f"timestamp'{fx.NOW}' as created_at", f"timestamp'{fx.NOW}' as updated_at"
    )
    out = R.upsert(known, new, "source_id")
    return out.select("source_id", "status", "content_hash", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"))


def ledger_after_run(spark: SparkSession, d: str) -> DataFrame:
    known = fx.known(spark, d)
    done = R.classify(fx.listing(spark, d), known, _now())
    errors = done.where("action in ('new', 'modified') and source_id like '%4'").select("source_id", F.lit("cannot be read").alias("error_message"))
    return R.ledger_after(done, known, _now(), errors).select("source_id", "status", "content_hash", "error_message")


def ledger_touch(spark: SparkSession, d: str) -> DataFrame:
    """Unchanged files whose times have moved on by an hour."""
    known = fx.known(spark, d)
    later = fx.listing(spark, d).withColumn("modified", F.expr("modified + interval 1 hour"))
    return R.touched(R.classify(later, known, _now(), 0), known).select("source_id", "last_modified_at", "content_hash")


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after documents with ids that three divides came again in two chunks."""
    old = fx.chunks(spark, d).select("id", "document_id", "chunk_index", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    again = fx.chunks(spark, d).where("doc_id % 3 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    new = again.select(F.concat("document_id", F.lit("_chunk_"), F.col("k").cast("string")).alias("id"), "document_id", F.col("k").alias("chunk_index"), F.sha2(F.concat("content", F.col("k").cast("string")).cast("binary"), 256).alias("digest"))
    return R.replace_chunks(old, new)


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.table_counts(documents=fx.documents(spark, d), chunks=fx.chunks(spark, d), memory_nodes=fx.memory(spark, d), source_ledger=fx.ledger(spark, d))


def ledger_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.ledger_counts(fx.ledger(spark, d))


def global_status(spark: SparkSession, d: str) -> DataFrame:
    return P.global_status(fx.ledger(spark, d), fx.catalog(spark, d), fx.documents(spark, d), fx.chunks(spark, d), fx.memory(spark, d))


def last_indexed(spark: SparkSession, d: str) -> DataFrame:
    return P.last_indexed(fx.ledger(spark, d), fx.documents(spark, d)).select(F.col("last_indexed_at").cast("string").alias("last_indexed_at"))


def recent_problems(spark: SparkSession, d: str) -> DataFrame:
    return P.recent_problems(fx.ledger(spark, d)).withColumn("updated_at", F.col("updated_at").cast("string"))


def skip_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.skip_reasons(fx.ledger(spark, d))


def expected_skip_split(spark: SparkSession, d: str) -> DataFrame:
    return P.skip_split(fx.ledger(spark, d))


def unstable_files(spark: SparkSession, d: str) -> DataFrame:
    rows = P.unstable_files(fx.ledger(spark, d).withColumn("source_type", F.lit("agent_session")))
    return rows.select("path", "n", *(F.col(c).cast("string").alias(c) for c in ("first_modified", "last_modified", "last_updated")))


def transient_stale_split(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-01-01 04:00:00").cast("timestamp")
    return P.freshness_split(fx.ledger(spark, d).withColumn("source_type", F.lit("agent_session")), now)


def readiness(spark: SparkSession, d: str) -> DataFrame:
    return P.readiness(fx.ledger(spark, d).withColumn("source_type", F.when(F.col("source_type") == "agent_memory", "agent_session").otherwise(F.col("source_type"))), fx.catalog(spark, d), F.lit("2026-01-01 04:00:00").cast("timestamp"))


def task_list(spark: SparkSession, d: str) -> DataFrame:
    return P.list_tasks(fx.tasks(spark, d), project="p3", status="closed", type=None).select("task_id", "title", "type", F.col("created_at").cast("string").alias("created_at"))


def task_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = P.task_rollup(fx.tasks(spark, d), fx.steps(spark, d))
    return r.select("task_id", F.col("total_tokens").cast("double").alias("total_tokens"), F.round("total_duration_s", 5).alias("total_duration_s"), "n_steps")


def next_step_index(spark: SparkSession, d: str) -> DataFrame:
    return P.next_step_index(fx.tasks(spark, d), fx.steps(spark, d))


def verifier_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return P.verifier_acceptance(fx.rounds(spark, d))


def verifier_by_project(spark: SparkSession, d: str) -> DataFrame:
    return P.verifier_acceptance(fx.rounds(spark, d), fx.tasks(spark, d), "p3")


def judgment_outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.judgment_outcomes(fx.tasks(spark, d), fx.steps(spark, d))


def cleanup_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ledger(spark, d).withColumn("source_path_or_alias", F.when(F.col("source_id").endswith("5"), F.concat(F.lit("D:/far"), "source_path_or_alias")).otherwise(F.col("source_path_or_alias")))
    roots = fx.catalog(spark, d).where("source_type = 'project_root' and cast(substring(project_name, 4) as int) % 2 = 1")
    return P.cleanup_actions(rows.withColumn("source_type", F.lit("project_docs")), roots.orderBy("id")).select("source_id", "previous_status", "reason")


def export_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Equal digests for a table in two orders of rows and columns, another for one with a row changed."""
    n = fx.load(spark, d, "nation")
    a = store.fingerprint(n).select("fingerprint").withColumnRenamed("fingerprint", "a")
    b = store.fingerprint(n.orderBy(F.desc("n_name")).select(*reversed(n.columns))).select(F.col("fingerprint").alias("b"))
    c = store.fingerprint(n.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "x").otherwise(F.col("n_name")))).select(F.col("fingerprint").alias("c"))
    return a.join(b).join(c).select((F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("changed_same"))


_CAND_TEXT = S.strip_candidate("c.content")
_CAND = f"""
, cand0 as (select c.id as source_chunk_id, d.path as source_path, c.chunk_index, l.source_type, {_CAND_TEXT} as content, regexp_matches(c.content, '"is_compaction"\\s*:\\s*true') as flag from m_chunks c join m_documents d on d.id = c.document_id join m_ledger l on l.source_path_or_alias = d.path where l.status = 'active')
, cand1 as (select *, cast({S.token_estimate("content")} as int) as tokens, sha256(content) as content_hash, source_type = 'agent_session' and flag as is_compaction from cand0 where not regexp_matches(substr(content, 1, 300), '(?s)^\\s*\\{{.*"type"\\s*:'))
, cand as (select *, case when is_compaction then 0.75 when source_type = 'project_docs' then 0.8 when source_type = 'agent_session' then 0.6 else 0.5 end::double as confidence,
    case when source_type = 'agent_session' then case when regexp_matches(content, '(?i)(^|\\n)\\s*\\[(user|assistant)\\]:') then 'noisy' else 'candidate' end when ends_with(source_path, '.py') then 'non_document' else 'candidate' end as verdict from cand1 where tokens >= 8)
, blocked as (select sha256({S.strip("content")}) as b_hash, min(case status when 'active' then 0 when 'unverified' then 1 else 2 end) as r from m_memory where (status <> 'active' or type = 'note') and (status in ('active', 'unverified') or (status = 'obsolete' and source_kind = 'auto' and created_by = 'auto')) group by 1)
, judged as (select cand.*, case when verdict <> 'candidate' then verdict when r is not null then 'duplicate_' || ['active', 'unverified', 'rejected'][r + 1] when confidence < 0.55 then 'low_confidence' else 'eligible' end as state from cand left join blocked on b_hash = content_hash)
"""
_RANK = "is_compaction desc, case when source_type = 'agent_session' then 0 else 1 end, tokens desc, source_path, chunk_index, source_chunk_id"
_COUNT = lambda c: f"count(*) filter (where {c})"
_EXPECTED = "(source_type = 'server_alias' or " + " or ".join(f"contains(lower(coalesce(error_message, '')), '{m}')" for m in P.EXPECTED_PARTS) + ")"
_EXPECTED_MSG = "(" + " or ".join(f"contains(lower(coalesce(error_message, '')), '{m}')" for m in P.EXPECTED_MARKERS) + ")"
_UNSTABLE = "status = 'skipped' and (contains(lower(coalesce(error_message, '')), 'not yet stable') or contains(lower(coalesce(error_message, '')), 'unstable'))"
_REVIEW = "status = 'unverified' and source_kind = 'auto' and created_by = 'auto'"
_PRUNE = "project_id = 'default' and status = 'obsolete' and source_kind = 'auto' and created_by = 'auto' and content_hash is not null"
_CLASS = f"""
, cls as (select coalesce(n.source_id, o.source_id) as source_id, coalesce(n.source_path, o.source_path_or_alias) as source_path, coalesce(n.source_type, o.source_type) as source_type, o.status as previous_status, o.content_hash as o_hash, n.content_hash as n_hash,
  case when n.source_id is null then case when o.status = 'active' then 'missing' end
       when n.source_type = 'agent_session' and timestamp '{fx.NOW}' - n.modified < interval 120 second then 'skipped'
       when o.source_id is null then 'new' when o.status = 'active' and o.content_hash = n.content_hash then 'unchanged' when o.status = 'active' then 'modified' else 'new' end as action
  from m_listing n full join m_known o on n.source_id = o.source_id)
, cl as (select *, case action when 'skipped' then '{R.UNSTABLE}' when 'missing' then '{R.GONE}' end as reason from cls where action is not null)
"""

def _in_order(rows: str, limit: int, per_source: int) -> str:
    """Row by row in order, with the contents and sources of what was created so far."""
    return S.model(f"""{_CAND}, base as (select * from {rows}), ok as (select source_chunk_id, source_path, content_hash, row_number() over (order by {_RANK}) as i from base where state = 'eligible')
, walk as (
    select 0::bigint as i, ''::varchar as state, []::varchar[] as hashes, []::varchar[] as sources
    union all
    select i, state, case when state = 'created' then list_append(hashes, content_hash) else hashes end, case when state = 'created' then list_append(sources, source_path) else sources end
    from (select ok.i, hashes, sources, content_hash, source_path, case when list_contains(hashes, content_hash) then 'duplicate_unverified'
        when len(list_filter(sources, lambda x: x = source_path)) >= {per_source} then 'source_limit' when len(hashes) >= {limit} then 'limit' else 'created' end as state from walk join ok on ok.i = walk.i + 1)
)
select source_chunk_id, source_path, state from base where state <> 'eligible' union all select source_chunk_id, source_path, walk.state from walk join ok using (i)""").replace("with ", "with recursive ", 1)


QUERIES = {
    "candidate_ranking": (candidate_ranking, S.model(f"{_CAND} select source_chunk_id, source_path, tokens, is_compaction, confidence, content_hash from cand where verdict = 'candidate' order by {_RANK} limit 60")),
    "candidate_states": (candidate_states, S.model(f"{_CAND} select source_chunk_id, case when state = 'eligible' then 'created' else state end as state from judged")),
    "candidate_caps": (
        candidate_caps,
        S.model(f"""{_CAND}, src as (select cand.* replace (array_to_string(list_slice(string_split(source_path, '/'), 1, 3), '/') as source_path) from cand)
, a as (select *, row_number() over (partition by source_path order by {_RANK}) as rs from src), b as (select *, case when rs <= 4 then row_number() over (partition by rs <= 4 order by {_RANK}) end as rg from a)
, f as (select source_path, count(*) as filled from b where rs <= 4 and rg <= 40 group by 1)
select source_chunk_id, b.source_path, case when rs <= 4 and rg <= 40 then 'created' when rs > 4 and coalesce(filled, 0) >= 4 then 'source_limit' else 'limit' end as state from b left join f using (source_path)"""),
    ),
    "candidate_in_order": (candidate_in_order, _in_order("judged", 100, 3)),
    "candidate_in_rounds": (
        candidate_in_rounds,
        _in_order("(select cand.* replace (array_to_string(list_slice(string_split(source_path, '/'), 1, 3), '/') as source_path, lower(substr(content, 1, 2)) as content_hash), case verdict when 'candidate' then 'eligible' else verdict end as state from cand)", 1_000_000_000, 7),
    ),
    "blocklist_reasons": (blocklist_reasons, S.model("""select content_hash, ['active', 'unverified', 'rejected'][min(r) + 1] as reason from (select content_hash, case status when 'active' then 0 when 'unverified' then 1 else 2 end as r from m_memory where status in ('active', 'unverified') or (status = 'obsolete' and source_kind = 'auto' and created_by = 'auto') union all select content_hash, 0 from m_memory where id like '%7') group by 1""")),
    "blocklist_dedup": (blocklist_dedup, S.model(f"{_CAND} select doc_id, ['active', 'unverified', 'rejected'][r + 1] as reason from documents join blocked on b_hash = sha256({S.strip('text')})")),
    "candidate_telemetry": (
        candidate_telemetry,
        S.model(f"""{_CAND} select {_COUNT("verdict = 'candidate'")} as candidates, {_COUNT("starts_with(state, 'duplicate_')")} as duplicate_skips, {_COUNT("state = 'duplicate_active'")} as duplicate_active, {_COUNT("state = 'duplicate_unverified'")} as duplicate_unverified, {_COUNT("state = 'duplicate_rejected'")} as duplicate_rejected,
{_COUNT("state = 'low_confidence'")} as low_confidence, {_COUNT("state = 'non_document'")} as non_document_skipped, {_COUNT("state = 'noisy'")} as noisy_session_skipped from judged"""),
    ),
    "noisy_transcripts": (noisy_transcripts, "select conv_id, turn from conversations where turn % 5 <> 4"),
    "json_dump_filter": (json_dump_filter, "select event_id from events where event_id % 3 = 0"),
    "approve_guard": (approve_guard, S.model(f"select id, case when id like '%6' and {_REVIEW} then 'active' else status end as status, cast(case when id like '%6' and {_REVIEW} then timestamp '{fx.NOW}' else updated_at end as varchar) as updated_at from m_memory")),
    "reject_guard": (reject_guard, S.model(f"select case when id like '%6' and {_REVIEW} then 'obsolete' else status end as status, count(*) as n from m_memory group by 1")),
    "prune_select": (prune_select, S.model(f"select id, cast(length(content) as int) as n from (select * from m_memory where {_PRUNE} and contains(lower(coalesce(source_path, '')), 'src1') order by updated_at, created_at, id limit 15)")),
    "prune_apply": (
        prune_apply,
        S.model(f", p as (select id from m_memory where {_PRUNE} order by updated_at, created_at, id limit 10) select id, sha256(case when id in (select id from p) then '{L.TOMBSTONE}' else content end) as digest, content_hash, cast(case when id in (select id from p) then timestamp '{fx.NOW}' else updated_at end as varchar) as updated_at from m_memory"),
    ),
    "promote_snapshot": (promote_snapshot, S.model(f", ok as (select count(*) > 0 as done from m_memory where id = 'm16' and {_REVIEW}), s as (select case when id = 'm16' and {_REVIEW} then 'obsolete' else status end as status, source_kind from m_memory union all select 'active', 'curated_auto' from ok where done) select status, source_kind, count(*) as n from s group by 1, 2")),
    "literal_like_filter": (literal_like_filter, S.model("select id from m_memory where contains(title, '%') or contains(lower(coalesce(source_path, '')), 'src1/notes')")),
    "review_by_source": (review_by_source, S.model(f"select source_path, count(*) as n from m_memory where {_REVIEW} group by 1")),
    "review_list": (review_list, S.model(f"select id, source_path, title, {S.excerpt('content', 160)} as content_excerpt from (select * from m_memory where {_REVIEW} order by source_path nulls first, title, created_at, id limit 25)")),
    "ledger_transitions": (
        ledger_transitions,
        S.model(""", p as (select distinct status as previous from m_ledger union all select null), n as (select unnest(['active', 'missing', 'error', 'skipped', 'pending']) as following)
select previous, following, case coalesce(previous, 'none') when 'missing' then following in ('missing', 'active') when 'error' then following in ('error', 'active', 'missing') else following in ('active', 'skipped', 'missing', 'error') end as allowed from p cross join n"""),
    ),
    "refresh_classify": (refresh_classify, S.model(f"{_CLASS} select source_id, source_path, action, reason, previous_status, case when action = 'modified' then o_hash end as previous_hash from cl")),
    "refresh_counters": (refresh_counters, S.model(f"{_CLASS} select count(*) as total, " + ", ".join(f"count(*) filter (where action = '{a}') as n_{a}" for a in ("new", "modified", "unchanged", "missing", "skipped")) + " from cl")),
    "refresh_summary": (refresh_summary, S.model(f"{_CLASS} select 'action' as facet, action as value, count(*) as n from cl group by 2 union all select 'source_type', source_type, count(*) from cl group by 2 union all select 'reason', reason, count(*) from cl where reason is not null group by 2")),
    "mtime_fast_path": (mtime_fast_path, S.model("select n.source_path as path from m_listing n left join m_known o on o.source_path_or_alias = n.source_path group by 1 having not bool_and(coalesce(o.status = 'active' and o.last_modified_at = n.modified, false))")),
    "stability_gate": (stability_gate, S.model(f"select source_id from m_listing where timestamp '{fx.NOW}' - modified >= interval 120 second")),
    "missing_detection": (missing_detection, S.model("select source_id from m_known where status = 'active' and starts_with(source_path_or_alias, '/srv/src1/') and source_id not in (select source_id from m_listing) and source_id not like '%2'")),
    "ledger_upsert": (
        ledger_upsert,
        S.model(f", n as (select * from m_listing where source_id like '%3' or source_id like '%0') select coalesce(n.source_id, o.source_id) as source_id, case when n.source_id is not null then 'pending' else o.status end as status, case when n.source_id is not null then n.content_hash else o.content_hash end as content_hash, cast(coalesce(o.created_at, timestamp '{fx.NOW}') as varchar) as created_at, cast(case when n.source_id is not null then timestamp '{fx.NOW}' else o.updated_at end as varchar) as updated_at from n full join m_known o on n.source_id = o.source_id"),
    ),
    "ledger_after_run": (
        ledger_after_run,
        S.model(f"""{_CLASS}, e as (select *, action in ('new', 'modified') and source_id like '%4' as failed from cl)
, ch as (select *, case when failed then 'error' when action in ('new', 'modified') then 'active' when action = 'missing' then 'missing' else 'skipped' end as st, (failed and coalesce(previous_status, '') = 'active') or action = 'missing' as keep from e where action in ('new', 'modified', 'missing') or (action = 'skipped' and coalesce(previous_status, '') <> 'active'))
select coalesce(o.source_id, ch.source_id) as source_id, coalesce(ch.st, o.status) as status, case when ch.source_id is not null and not (keep and o.source_id is not null) then ch.n_hash else o.content_hash end as content_hash, case when failed then 'cannot be read' when ch.source_id is not null then ch.reason end as error_message from m_known o full join ch on o.source_id = ch.source_id"""),
    ),
    "ledger_touch": (ledger_touch, S.model("select k.source_id, case when l.source_id is not null and k.status = 'active' and l.content_hash is not distinct from k.content_hash then l.modified + interval 1 hour else k.last_modified_at end as last_modified_at, k.content_hash from m_known k left join m_listing l on l.source_id = k.source_id")),
    "document_upsert": (document_upsert, S.model("select id, document_id, cast(chunk_index as int) as chunk_index, sha256(content) as digest from m_chunks where doc_id % 3 <> 0 union all select document_id || '_chunk_' || k, document_id, cast(k as int), sha256(content || k) from m_chunks cross join (select unnest([0, 1]) as k) where doc_id % 3 = 0")),
    "table_counts": (table_counts, S.model("select 'documents' as name, count(*) as n from m_documents union all select 'chunks', count(*) from m_chunks union all select 'memory_nodes', count(*) from m_memory union all select 'source_ledger', count(*) from m_ledger")),
    "ledger_status_counts": (ledger_status_counts, S.model("select 'status' as facet, status as value, count(*) as n from m_ledger group by 2 union all select 'source_type', source_type, count(*) from m_ledger group by 2")),
    "global_status": (
        global_status,
        S.model("""select 'ledger_status' as facet, status as value, count(*) as n from m_ledger group by 2 union all select 'ledger_source_type', source_type, count(*) from m_ledger group by 2 union all select 'catalog_source_type', source_type, count(*) from m_catalog group by 2 union all select 'catalog_confirmation_status', confirmation_status, count(*) from m_catalog group by 2
union all select 'table', 'documents', count(*) from m_documents union all select 'table', 'chunks', count(*) from m_chunks union all select 'table', 'memory_nodes', count(*) from m_memory"""),
    ),
    "last_indexed": (last_indexed, S.model("select cast(max(t) as varchar) as last_indexed_at from (select last_indexed_at as t from m_ledger union all select last_indexed_at from m_documents)")),
    "recent_problems": (recent_problems, S.model("select source_id, source_path_or_alias, source_type, status, error_message, cast(updated_at as varchar) as updated_at from m_ledger where status in ('missing', 'error', 'skipped') order by m_ledger.updated_at desc, source_id limit 10")),
    "skip_reason_histogram": (skip_reason_histogram, S.model("select source_type, coalesce(error_message, '') as reason, count(*) as n from m_ledger where status = 'skipped' group by 1, 2 order by n desc, 1, 2 limit 20")),
    "expected_skip_split": (expected_skip_split, S.model(f"select count(*) filter (where status = 'skipped' and {_EXPECTED}) as expected, count(*) filter (where status = 'skipped' and not {_EXPECTED}) as other, count(*) filter (where status = 'skipped' and {_EXPECTED_MSG}) as expected_by_message from m_ledger")),
    "unstable_files": (unstable_files, S.model(f"select string_split(source_path_or_alias, '::')[1] as path, count(*) as n, cast(min(last_modified_at) as varchar) as first_modified, cast(max(last_modified_at) as varchar) as last_modified, cast(max(updated_at) as varchar) as last_updated from m_ledger where {_UNSTABLE} group by 1")),
    "transient_stale_split": (transient_stale_split, S.model(f", f as (select string_split(source_path_or_alias, '::')[1] as path, count(*) as n, max(last_modified_at) as m from m_ledger where {_UNSTABLE} group by 1) select cast(coalesce(sum(n) filter (where timestamp '2026-01-01 04:00:00' - m < interval 120 second), 0) as bigint) as transient, cast(coalesce(sum(n) filter (where not timestamp '2026-01-01 04:00:00' - m < interval 120 second), 0) as bigint) as stale from f")),
    "readiness": (
        readiness,
        S.model(f""", led as (select * replace (case when source_type = 'agent_memory' then 'agent_session' else source_type end as source_type) from m_ledger), f as (select string_split(source_path_or_alias, '::')[1] as path, count(*) as n, max(last_modified_at) as m from led where {_UNSTABLE} and source_type = 'agent_session' group by 1)
, s as (select coalesce(sum(n) filter (where timestamp '2026-01-01 04:00:00' - m < interval 120 second), 0)::bigint as tr, coalesce(sum(n) filter (where not timestamp '2026-01-01 04:00:00' - m < interval 120 second), 0)::bigint as st from f)
, c as (select count(*) filter (where status = 'active') as a, count(*) filter (where status = 'missing') as mi, count(*) filter (where status = 'error') as er, count(*) filter (where status = 'skipped' and not {_EXPECTED}) as o from led), k as (select count(*) filter (where confirmation_status = 'confirmed') as cf from m_catalog)
, w as (select list_filter([case when cf = 0 then 'catalog has no confirmed sources' end, case when a = 0 then 'no active indexed sources found' end, case when mi > 0 then mi || ' source(s) are missing' end, case when er > 0 then er || ' source(s) have indexing errors' end, case when greatest(0, o - tr) - st > 0 then (greatest(0, o - tr) - st) || ' actionable non-expected source(s) are skipped' end, case when st > 0 then st || ' agent session source(s) remain unstable after the stability window' end], lambda x: x is not null) as w from c, s, k)
select len(w) = 0 as ready, array_to_string(w, '; ') as warnings from w"""),
    ),
    "task_list": (task_list, S.model("select task_id, title, type, cast(created_at as varchar) as created_at from m_tasks where project = 'p3' and status = 'closed'")),
    "task_rollup": (task_rollup, S.model("select t.task_id, cast(sum(tokens_used) as double) as total_tokens, round(sum(duration_s), 5) as total_duration_s, count(s.task_id) as n_steps from m_tasks t left join m_steps s on s.task_id = t.task_id group by 1")),
    "next_step_index": (next_step_index, S.model("select t.task_id, cast(coalesce(max(step_index), -1) + 1 as int) as next_index from m_tasks t left join m_steps s on s.task_id = t.task_id group by 1")),
    "verifier_acceptance": (verifier_acceptance, S.model("select suggestion_type, count(*) as total, cast(count(*) filter (where brain_accepted) as bigint) as accepted, round(count(*) filter (where brain_accepted) / count(*)::double, 3) as acceptance_rate from m_rounds group by 1")),
    "verifier_by_project": (verifier_by_project, S.model("select suggestion_type, count(*) as total, cast(count(*) filter (where brain_accepted) as bigint) as accepted, round(count(*) filter (where brain_accepted) / count(*)::double, 3) as acceptance_rate from m_rounds where task_id in (select task_id from m_tasks where project = 'p3') group by 1")),
    "judgment_outcome_matrix": (judgment_outcome_matrix, S.model("select brain_judgment, human_outcome, count(*) as n from m_steps s join m_tasks t on t.task_id = s.task_id where brain_judgment is not null and human_outcome is not null group by 1, 2")),
    "cleanup_actions": (
        cleanup_actions,
        S.model(f""", led as (select source_id, status, error_message, case when source_id like '%5' then 'D:/far' || source_path_or_alias else source_path_or_alias end as p from m_ledger where status in ('missing', 'error', 'skipped') and not (status = 'skipped' and {_EXPECTED_MSG}))
, r as (select lower(path_or_alias) as rp, confirmation_status as cs from m_catalog where source_type = 'project_root' and cast(substr(project_name, 4) as int) % 2 = 1)
, j as (select led.*, (select min(cs) from r where starts_with(p, rp || '/')) as cs from led)
, x as (select source_id, status as previous_status, case when starts_with(p, 'D:') then 'non-local path cannot be indexed from this local machine' when cs is not null and cs <> 'confirmed' then 'disabled catalog source should not block readiness' when cs is null and status in ('missing', 'error') then 'stale ledger row has no confirmed catalog source' when status = 'missing' and contains(lower(coalesce(error_message, '')), 'previously indexed source file no longer exists') then 'removed local source file is no longer active' end as reason from j)
select * from x where reason is not null"""),
    ),
    "export_fingerprint": (export_fingerprint, "select true as same, false as changed_same"),
}
