"""The engine's tables as views of the synthetic test tables, in Spark and, for the oracle, in SQL.

Documents stand for documents and their chunks, labels for the ledger, conversations for
sessions, orders and lineitem for tasks and steps, events for verifier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.schemas import METADATA_MARKER

#: A fixed time for everything that depends on the present.
NOW = "2026-01-02 00:00:00"
PREAMBLE = METADATA_MARKER + ' {"exchange_index": 3, "session_id": "s-2026-02-03"}'


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(minutes: str) -> str:
    return f"timestampadd(MINUTE, cast({minutes} as int), timestamp'2026-01-01 00:00:00')"


_PATH = "concat('/srv/', source, '/notes/', doc_id, case doc_id % 4 when 0 then '.md' when 1 then '.txt' when 2 then '.py' else '.rst' end)"
_KIND = "case doc_id % 3 when 0 then 'project_docs' when 1 then 'agent_session' end"
_LEDGER_KIND = "case when doc_id % 11 = 0 then 'server_alias' when doc_id % 3 = 0 then 'project_docs' when doc_id % 3 = 1 then 'agent_session' else 'agent_memory' end"
_STATUS = "case when toxic = 1 then 'skipped' when quality = 0 then case doc_id % 3 when 0 then 'missing' when 1 then 'error' else 'pending' end else 'active' end"
_ERROR = "case when toxic = 1 or quality = 0 then case doc_id % 5 when 0 then 'JSONL modified recently, not yet stable' when 1 then 'non-local path: elsewhere' when 2 then 'No indexable records' when 3 then 'previously indexed source file no longer exists' end end"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('d', doc_id) as id", "concat('p', doc_id % 5) as project_id", f"{_PATH} as path", "cast(null as string) as filename", "sha2(cast(text as binary), 256) as content_hash", f"{_at('doc_id % 1000')} as last_indexed_at", f"{_at('doc_id % 900')} as created_at", f"{_at('doc_id % 800')} as updated_at",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(PREAMBLE + "\n\n"), "text")).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.expr("concat('d', doc_id, '_chunk_0')").alias("id"), F.expr("concat('d', doc_id)").alias("document_id"), F.lit(0).alias("chunk_index"), F.expr("case when doc_id % 5 = 0 then concat('Section ', doc_id % 7) end").alias("heading_path"), content.alias("content"), F.expr(_KIND).alias("source_type"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = load(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.selectExpr(
        "concat('src', doc_id) as source_id", f"concat({_PATH}, case when doc_id % 10 = 4 then concat('::exchange_', doc_id % 3) else '' end) as source_path_or_alias", "concat('p', doc_id % 5) as project_name", f"{_LEDGER_KIND} as source_type", "'1' as parser_version", "sha2(cast(text as binary), 256) as content_hash",
        f"{_at('doc_id % 500')} as last_modified_at", f"{_at('doc_id % 600')} as last_indexed_at", f"{_STATUS} as status", f"{_ERROR} as error_message", "1 as chunk_count", f"{_at('doc_id % 300')} as created_at", f"{_at('doc_id % 700')} as updated_at",
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(
        "concat('m', doc_id) as id", "'default' as project_id", "case doc_id % 4 when 0 then 'note' when 1 then 'decision' when 2 then 'issue' else 'pattern' end as type", "substring(text, 1, 40) as title", "text as content", "case doc_id % 5 when 0 then 'active' when 1 then 'unverified' when 2 then 'obsolete' when 3 then 'superseded' else 'conflicting' end as status",
        "case when doc_id % 2 = 0 then 'auto' else 'manual' end as source_kind", "concat('d', doc_id) as source_document_id", "concat('d', doc_id, '_chunk_0') as source_chunk_id", f"case when doc_id % 13 <> 0 then {_PATH} end as source_path", "sha2(cast(text as binary), 256) as content_hash", "case when doc_id % 2 = 0 then 'auto' else 'user' end as created_by", "cast(null as string) as model_name",
        "case when doc_id % 7 <> 0 then (doc_id % 10) / 10.0D end as confidence", f"{_at('doc_id % 400')} as created_at", f"{_at('doc_id % 450')} as updated_at",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "concat('task_', o_orderkey) as task_id", "concat('Task ', o_orderkey) as title", "case substring(o_orderpriority, 1, 1) when '1' then 'bugfix' when '2' then 'feature' when '3' then 'refactor' when '4' then 'review' else 'query' end as type", "concat('p', o_custkey % 10) as project",
        "case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'unrated' end as status", "cast(case o_orderkey % 4 when 0 then 1 when 1 then 0 when 2 then -1 end as int) as human_outcome", "o_orderdate as created_at",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(
        "concat('task_', l_orderkey) as task_id", "l_linenumber - 1 as step_index", "case l_returnflag when 'A' then 'ok' when 'N' then 'needs_revision' when 'R' then 'rejected' end as brain_judgment", "cast(l_quantity as long) as tokens_used", "l_extendedprice / 1000 as duration_s", "l_linestatus as model_used",
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("concat('round_', event_id) as round_id", "concat('task_', user_id) as task_id", "event_type as suggestion_type", "value > 50 as brain_accepted", "ts as created_at")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    status = "case when try_cast(substring(source, 4) as int) % 4 = 3 then 'pending' else 'confirmed' end"
    roots = docs.select("source").distinct().selectExpr("concat('root_', source) as id", "'project_root' as source_type", "concat('/srv/', source) as path_or_alias", "source as project_name", "array('codex-sessions') as discovered_from", f"{status} as confirmation_status", "1.0D as confidence", "1 as evidence_count")
    some = docs.selectExpr("concat('doc_', doc_id) as id", "'document' as source_type", f"{_PATH} as path_or_alias", "cast(null as string) as project_name", "array('claude-projects', concat('root_src', doc_id % 20)) as discovered_from", f"{status} as confirmation_status", "0.5D as confidence", "2 as evidence_count")
    hosts = load(spark, sf_dir, "nation").selectExpr("concat('host_', n_nationkey) as id", "'server_alias' as source_type", "concat('host-', n_nationkey, '.example.com') as path_or_alias", "cast(null as string) as project_name", "array(concat('seen in src', n_nationkey, ' notes')) as discovered_from", "'confirmed' as confirmation_status", "1.5D as confidence", "1 as evidence_count")
    return roots.union(some).union(hosts)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds now."""
    kind = "case when doc_id % 3 = 1 then 'agent_session' else 'project_docs' end"
    path = "concat('/srv/', source, '/', doc_id, case when doc_id % 3 = 1 then '.jsonl' else '.md' end)"
    return load(spark, sf_dir, "documents").where("lang <> 'es'").selectExpr("concat('s', doc_id) as source_id", f"{path} as source_path", f"{kind} as source_type", "sha2(cast(text as binary), 256) as content_hash", f"timestampadd(SECOND, -cast(doc_id % 300 as int), timestamp'{NOW}') as modified")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger before that scan."""
    kind = "case when doc_id % 3 = 1 then 'agent_session' else 'project_docs' end"
    path = "concat('/srv/', source, '/', doc_id, case when doc_id % 3 = 1 then '.jsonl' else '.md' end)"
    return load(spark, sf_dir, "documents").where("lang <> 'fr'").selectExpr(
        "concat('s', doc_id) as source_id", f"{path} as source_path_or_alias", "cast(null as string) as project_name", f"{kind} as source_type", "'1' as parser_version", "sha2(cast(concat(text, case when doc_id % 7 = 0 then 'x' else '' end) as binary), 256) as content_hash",
        f"timestampadd(SECOND, -cast(doc_id % 300 as int), timestamp'{NOW}') as last_modified_at", f"{_at('doc_id % 60')} as last_indexed_at", "case when doc_id % 9 = 0 then 'error' else 'active' end as status", "cast(null as string) as error_message", "1 as chunk_count", f"{_at('0')} as created_at", f"{_at('doc_id % 60')} as updated_at",
    )


def _sql_at(minutes: str) -> str:
    return f"timestamp '2026-01-01 00:00:00' + to_minutes({minutes})"


_SQL_PATH = _PATH
_LIST_KIND = "case when doc_id % 3 = 1 then 'agent_session' else 'project_docs' end"
_LIST_PATH = "concat('/srv/', source, '/', doc_id, case when doc_id % 3 = 1 then '.jsonl' else '.md' end)"

#: The same tables as common table expressions of the oracle's SQL.
MODEL = f"""
with m_documents as (
  select doc_id, concat('d', doc_id) as id, concat('p', doc_id % 5) as project_id, {_PATH} as path, sha256(text) as content_hash, {_sql_at('doc_id % 1000')} as last_indexed_at, {_sql_at('doc_id % 900')} as created_at, {_sql_at('doc_id % 800')} as updated_at, text from documents
), m_chunks as (
  select doc_id, concat('d', doc_id, '_chunk_0') as id, concat('d', doc_id) as document_id, 0 as chunk_index, case when doc_id % 5 = 0 then concat('Section ', doc_id % 7) end as heading_path,
         case when doc_id % 6 = 0 then '{PREAMBLE}' || chr(10) || chr(10) || text else text end as content, text, {_KIND} as source_type from documents
), m_ledger as (
  select doc_id, concat('src', doc_id) as source_id, concat({_PATH}, case when doc_id % 10 = 4 then concat('::exchange_', doc_id % 3) else '' end) as source_path_or_alias, concat('p', doc_id % 5) as project_name, {_LEDGER_KIND} as source_type, sha256(text) as content_hash,
         {_sql_at('doc_id % 500')} as last_modified_at, {_sql_at('doc_id % 600')} as last_indexed_at, {_STATUS} as status, {_ERROR} as error_message, {_sql_at('doc_id % 700')} as updated_at
  from labels join documents using (doc_id)
), m_memory as (
  select doc_id, concat('m', doc_id) as id, 'default' as project_id, case doc_id % 4 when 0 then 'note' when 1 then 'decision' when 2 then 'issue' else 'pattern' end as type, substr(text, 1, 40) as title, text as content,
         case doc_id % 5 when 0 then 'active' when 1 then 'unverified' when 2 then 'obsolete' when 3 then 'superseded' else 'conflicting' end as status, case when doc_id % 2 = 0 then 'auto' else 'manual' end as source_kind, case when doc_id % 13 <> 0 then {_PATH} end as source_path,
         sha256(text) as content_hash, case when doc_id % 2 = 0 then 'auto' else 'user' end as created_by, case when doc_id % 7 <> 0 then (doc_id % 10) / 10.0::double end as confidence, {_sql_at('doc_id % 400')} as created_at, {_sql_at('doc_id % 450')} as updated_at
  from documents
), m_tasks as (
  select concat('task_', o_orderkey) as task_id, concat('Task ', o_orderkey) as title, case substr(o_orderpriority, 1, 1) when '1' then 'bugfix' when '2' then 'feature' when '3' then 'refactor' when '4' then 'review' else 'query' end as type, concat('p', o_custkey % 10) as project,
         case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'unrated' end as status, case o_orderkey % 4 when 0 then 1 when 1 then 0 when 2 then -1 end as human_outcome, o_orderdate as created_at from orders
), m_steps as (
  select concat('task_', l_orderkey) as task_id, l_linenumber - 1 as step_index, case l_returnflag when 'A' then 'ok' when 'N' then 'needs_revision' when 'R' then 'rejected' end as brain_judgment, cast(l_quantity as bigint) as tokens_used, l_extendedprice / 1000 as duration_s from lineitem
), m_rounds as (
  select concat('task_', user_id) as task_id, event_type as suggestion_type, value > 50 as brain_accepted from events
), m_catalog as (
  select distinct concat('root_', source) as id, 'project_root' as source_type, concat('/srv/', source) as path_or_alias, source as project_name, ['codex-sessions'] as discovered_from, case when cast(substr(source, 4) as int) % 4 = 3 then 'pending' else 'confirmed' end as confirmation_status, 1.0::double as confidence from documents
  union all select concat('doc_', doc_id), 'document', {_PATH}, null, ['claude-projects', concat('root_src', doc_id % 20)], case when cast(substr(source, 4) as int) % 4 = 3 then 'pending' else 'confirmed' end, 0.5 from documents
  union all select concat('host_', n_nationkey), 'server_alias', concat('host-', n_nationkey, '.example.com'), null, [concat('seen in src', n_nationkey, ' notes')], 'confirmed', 1.5 from nation
), m_listing as (
  select doc_id, concat('s', doc_id) as source_id, {_LIST_PATH} as source_path, {_LIST_KIND} as source_type, sha256(text) as content_hash, timestamp '{NOW}' - to_seconds(doc_id % 300) as modified from documents where lang <> 'es'
), m_known as (
  select doc_id, concat('s', doc_id) as source_id, {_LIST_PATH} as source_path_or_alias, {_LIST_KIND} as source_type, sha256(concat(text, case when doc_id % 7 = 0 then 'x' else '' end)) as content_hash, timestamp '{NOW}' - to_seconds(doc_id % 300) as last_modified_at,
         case when doc_id % 9 = 0 then 'error' else 'active' end as status, {_sql_at('0')} as created_at, {_sql_at('doc_id % 60')} as updated_at from documents where lang <> 'fr'
)
"""
