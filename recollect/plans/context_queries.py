"""Queries of discovery, context, the catalog and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import catalog as K
from recollect.operators import context as X
from recollect.operators import discovery as D
from recollect.operators import entries as N
from recollect.plans import fixtures as fx
from recollect.plans import sql as S
from recollect.scratch import shared_dir
from recollect.streaming import streams

#: Texts with paths, documents and hosts in them, made from the test tables.
_MIX = """concat('see /home/dev', doc_id % 7, '/proj', doc_id % 11, '/src/main.py, then C:\\\\Users\\\\me\\\\Documents\\\\App', doc_id % 5, '\\\\x.txt and docs/guide', doc_id % 3, '.md plus README.md; ssh root@host-', doc_id % 9, '.example.com or ssh db', doc_id % 4, '.internal', ' ', text)"""
_MIX_SQL = """concat('see /home/dev', doc_id % 7, '/proj', doc_id % 11, '/src/main.py, then C:\\Users\\me\\Documents\\App', doc_id % 5, '\\x.txt and docs/guide', doc_id % 3, '.md plus README.md; ssh root@host-', doc_id % 9, '.example.com or ssh db', doc_id % 4, '.internal', ' ', text)"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return fx.load(spark, d, "documents").select("doc_id", F.expr(_MIX).alias("text"), F.expr("concat('root', doc_id % 6)").alias("label"), F.col("doc_id").alias("position"))


def extract_paths(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", F.posexplode(D.paths("text")).alias("k", "path"))


def extract_doc_paths(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", F.posexplode(D.doc_paths("text")).alias("k", "path"))


def extract_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", F.posexplode(D.hosts("text")).alias("k", "host"))


def project_roots(spark: SparkSession, d: str) -> DataFrame:
    rows = _mixed(spark, d).select(F.explode(D.paths("text")).alias("path"))
    return rows.select("path", D.project_root("path").alias("root")).groupBy("root").agg(F.count("*").alias("n"))


def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = _mixed(spark, d).select("label", "position", F.explode(D.hosts("text")).alias("host"))
    return D.merge_sources(rows.withColumn("host", F.when(F.col("position") % 2 == 0, F.upper("host")).otherwise(F.col("host"))), "host", "label", "position").select("key", "host", F.array_join("discovered_from", ",").alias("discovered_from"))


def discovery_scores(spark: SparkSession, d: str) -> DataFrame:
    hosts = _mixed(spark, d).select("label", "position", F.explode(D.hosts("text")).alias("host"))
    merged = D.merge_sources(hosts, "host", "label", "position")
    return merged.select("host", D.score_server("host", "discovered_from").alias("confidence")).orderBy(F.desc("confidence"), F.lower("host"))


def discovery_report(spark: SparkSession, d: str) -> DataFrame:
    existing = spark.createDataFrame([("/home/dev1/proj1", True)], "path string, is_dir boolean")
    r = D.report(_mixed(spark, d), existing)
    return r.groupBy("section").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 1).alias("top"))


def section_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.catalog(spark, d).select(F.col("source_type").alias("section"), F.col("path_or_alias").alias("path"), "confidence")
    return K.section_limits(rows, 7).select("section", "path", "position")


def document_projects(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("concat(case doc_id % 3 when 0 then '/srv/app' when 1 then 'C:\\\\x\\\\lib' else '..' end, doc_id % 5, case doc_id % 2 when 0 then '/README.md' else '\\\\notes.md' end)")
    return fx.load(spark, d, "documents").select("doc_id", D.document_project(p).alias("project"))


def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.select_entries(fx.catalog(spark, d), (" SRC1", "host-2", ""), ("notes/1",)).select("id")


def confirmed_only(spark: SparkSession, d: str) -> DataFrame:
    return K.confirmed(fx.catalog(spark, d)).select("id", "source_type")


def project_resolution(spark: SparkSession, d: str) -> DataFrame:
    roots = K.roots(fx.catalog(spark, d))
    out = None
    for q in ("SRC4", "/srv/src5/", "src", "nothing"):
        rows = X.resolve(roots, q).select(F.lit(q).alias("query"), "id", "method", "ambiguous")
        out = rows if out is None else out.union(rows)
    return out


def _one(spark: SparkSession, d: str) -> DataFrame:
    return X.resolve(K.roots(fx.catalog(spark, d)), "src5")


def path_containment_join(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/SRV/src1/",), ("/srv/src2",), ("/srv/src1/notes",)], "path_or_alias string")
    return X.inside_any(fx.documents(spark, d), "path", "id", roots)


def context_ledger(spark: SparkSession, d: str) -> DataFrame:
    return X.ledger_rows(fx.ledger(spark, d), _one(spark, d)).select("source_id", "status")


def context_documents(spark: SparkSession, d: str) -> DataFrame:
    led = fx.ledger(spark, d).withColumn("project_name", F.when(F.col("project_name") == "p2", " SRC5 ").otherwise(F.col("project_name")))
    return X.documents_of(fx.documents(spark, d), led, _one(spark, d)).select("id", "path", "origin")


def context_excerpts(spark: SparkSession, d: str) -> DataFrame:
    docs = X.documents_of(fx.documents(spark, d), fx.ledger(spark, d), _one(spark, d))
    return X.excerpts(fx.chunks(spark, d), docs, 15).select("id", "path", F.sha2(F.col("excerpt").cast("binary"), 256).alias("digest"), "truncated")


def context_memories(spark: SparkSession, d: str) -> DataFrame:
    return X.memories(fx.memory(spark, d), ["default"], 30).select("id", "status", "confidence")


def related_documents(spark: SparkSession, d: str) -> DataFrame:
    return X.related_documents(fx.catalog(spark, d), _one(spark, d)).select("id")


def related_servers(spark: SparkSession, d: str) -> DataFrame:
    return X.related_servers(fx.catalog(spark, d), _one(spark, d)).select("id")


def servers_of_any_root(spark: SparkSession, d: str) -> DataFrame:
    """Servers that name any confirmed root."""
    catalog = fx.catalog(spark, d)
    roots = catalog.where("source_type = 'project_root' and confirmation_status = 'confirmed'")
    return X.related_servers(catalog, roots).select("id")



# streams: the table as a file stream, run to its end; the result must be that of the batch


def _place(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/recollect/stream-{uuid.uuid4().hex}"


def _drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a streaming frame to its end and return what it wrote."""
    out = _place(spark)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a file stream: a directory of files, as a feed leaves them."""
    rows, at = spark.read.parquet(f"{d}/{name}.parquet"), _place(spark)
    if "ts" in rows.columns:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(at)
    return spark.readStream.schema(rows.schema).parquet(at)


def stream_session_windows(spark: SparkSession, d: str) -> DataFrame:
    out = streams.quiet_sessions(fx.load(spark, d, "events"), seconds=1800)
    return out.select("user_id", F.col("started").cast("string").alias("started"), "n")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = streams.tumbling(fx.load(spark, d, "events"))
    return out.select(F.col("started").cast("string").alias("started"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_session_windows_live(spark: SparkSession, d: str) -> DataFrame:
    """The same on a stream, closed sessions only."""
    return _drained(spark, streams.quiet_sessions(_stream(spark, d, "events"), seconds=1800))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """User and type pairs seen on a stream, whatever the order of arrival."""
    rows = _stream(spark, d, "events")
    return _drained(spark, streams.dedup(rows, ["user_id", "event_type"], within="3650 days").select("user_id", "event_type"))


def stream_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges that a later message of the user has closed; the open one of each session stays in the state."""
    rows = _stream(spark, d, "conversations")
    out = _drained(spark, streams.exchanges(rows, None))
    return out.select("conv_id", "exchange_index", F.sha2(F.col("user").cast("binary"), 256).alias("user"), F.sha2(F.col("assistant").cast("binary"), 256).alias("assistant"))


_MIXED = f"with mx as (select doc_id, {_MIX_SQL} as t, concat('root', doc_id % 6) as label from documents)"
_HOST_ROWS = ", h as (select doc_id, label, unnest(['host-' || (doc_id % 9) || '.example.com', 'db' || (doc_id % 4) || '.internal']) as host from mx)"
def entry_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The catalog with entries of unknown types and foreign paths beside it; roots and Markdown files of even length are there."""
    catalog = fx.catalog(spark, d).withColumn("path_or_alias", F.expr("case when source_type = 'document' and length(path_or_alias) % 5 = 0 then concat('C:\\\\', path_or_alias) else path_or_alias end"))
    catalog = catalog.withColumn("source_type", F.expr("case when source_type = 'project_root' and project_name like '%7' then 'mailbox' else source_type end"))
    present = catalog.where("source_type in ('project_root', 'document') and length(path_or_alias) % 2 = 0").select(F.col("path_or_alias").alias("path"))
    return N.dispatch(catalog, present).select("id", "action", "reason")


def metadata_preamble(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.load(spark, d, "documents")
    fields = {"project": F.col("source"), "source_type": F.col("lang"), "source_path": F.expr("concat('/srv/\"q\" ', source)"), "session_id": F.expr("case when n_chars % 2 = 0 then '' else lang end"), "exchange_index": F.expr("case when n_chars % 3 = 0 then n_chars end"), "is_compaction": F.expr("case when n_chars % 5 = 0 then true end")}
    return docs.select("doc_id", T.with_preamble("text", fields).alias("t")).select("doc_id", F.substring_index("t", "\n\n", 1).alias("line"), F.sha2("t", 256).alias("digest"))


_DOCS_OF = """, own as (select source_path_or_alias as p from m_ledger where starts_with(source_path_or_alias, '/srv/src5/') {more})
, dd as (select *, case when project_id = 'src5' or starts_with(path, '/srv/src5/') then 0 else 1 end as origin from m_documents where project_id = 'src5' or starts_with(path, '/srv/src5/') or path in (select p from own))"""
_CONTEXT_BODY = "case when starts_with(content, 'INGESTION_METADATA') then case when contains(content, chr(10) || chr(10)) then {strip} else '' end else content end".format(strip=S.strip(r"case when len(string_split(content, chr(10) || chr(10))) = 2 then string_split(content, chr(10) || chr(10))[2] else array_to_string(list_slice(string_split(content, chr(10) || chr(10)), 3, 100000), chr(10) || chr(10)) end"))

QUERIES = {
    "extract_paths": (
        extract_paths,
        rf"""{_MIXED}, w as (select doc_id, regexp_extract_all(t, '[A-Za-z]:[\\/][^\s"''<>|*?]+') as a, list_transform(regexp_extract_all(t, '(?:^|\s)/(?:[^\s"''*?|]+/)+[^\s"''*?|]*'), lambda x: trim(x)) as b from mx)
, p as (select doc_id, list_transform(list_concat(a, b), lambda x: rtrim(x, '.,;:!?"''')) as ps from w) select doc_id, cast(u.i - 1 as int) as k, ps[u.i] as path from p, unnest(range(1, len(ps) + 1)) as u(i)""",
    ),
    "extract_doc_paths": (
        extract_doc_paths,
        rf"""{_MIXED}, w as (select doc_id, list_transform(regexp_extract_all(t, '(?i)[^\s"''<>|]*\.(?:md|txt|json|ya?ml|toml)'), lambda x: rtrim(x, '.,;:!?"''')) as ps from mx)
, p as (select doc_id, list_filter(ps, lambda x: (contains(replace(x, chr(92), '/'), '/') or lower(x) in ('agents.md', 'claude.md', 'readme.md')) and not starts_with(lower(x), 'http') and not regexp_matches(x, '[<>\[\](){{}}`]')) as ps from w)
select doc_id, cast(u.i - 1 as int) as k, ps[u.i] as path from p, unnest(range(1, len(ps) + 1)) as u(i)""",
    ),
    "extract_hosts": (
        extract_hosts,
        rf"""{_MIXED}, w as (select doc_id, list_filter(regexp_extract_all(t, '(?i)\bssh\s+(?:root@)?([\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.-]*)\b', 1), lambda x: contains(x, '.') or contains(x, '-')) as hs from mx)
select doc_id, cast(u.i - 1 as int) as k, hs[u.i] as host from w, unnest(range(1, len(hs) + 1)) as u(i)""",
    ),
    "project_roots": (
        project_roots,
        """with p as (select unnest(['/home/dev' || (doc_id % 7) || '/proj' || (doc_id % 11), 'C:' || chr(92) || 'Users' || chr(92) || 'me' || chr(92) || 'Documents' || chr(92) || 'App' || (doc_id % 5)]) as root from documents)
select root, count(*) as n from p group by 1""",
    ),
    "merge_sources": (
        merge_sources,
        f"""{_MIXED}{_HOST_ROWS}, e as (select lower(host) as key, label, min(doc_id) as pos, arg_min(case when doc_id % 2 = 0 then upper(host) else host end, doc_id) as name from h group by 1, 2)
select key, arg_min(name, pos) as host, string_agg(label, ',' order by pos, label) as discovered_from from e group by 1""",
    ),
    "discovery_scores": (discovery_scores, f"{_MIXED}{_HOST_ROWS} select host, count(distinct label) + case when contains(host, '.') then 0.5 else 0 end + case when contains(host, '-') then 0.5 else 0 end::double as confidence from h group by 1"),
    "discovery_report": (discovery_report, None),
    "section_limits": (section_limits, S.model("select section, path, cast(position as int) as position from (select source_type as section, path_or_alias as path, row_number() over (partition by source_type order by confidence desc, lower(path_or_alias), path_or_alias) as position from m_catalog) where position <= 7")),
    "document_projects": (document_projects, "select doc_id, case when doc_id % 2 = 0 then case doc_id % 3 when 0 then 'app' || (doc_id % 5) when 1 then 'lib' || (doc_id % 5) else '..' || (doc_id % 5) end end as project from documents"),
    "catalog_filter": (catalog_filter, S.model(", h as (select id, lower(concat_ws(' ', id, source_type, path_or_alias, coalesce(project_name, ''), array_to_string(discovered_from, ' '))) as hay from m_catalog) select id from h where (contains(hay, 'src1') or contains(hay, 'host-2')) and not contains(hay, 'notes/1')")),
    "entry_dispatch": (
        entry_dispatch,
        S.model(r""", c as (select id, case when source_type = 'document' and length(path_or_alias) % 5 = 0 then 'C:\' || path_or_alias else path_or_alias end as p, case when source_type = 'project_root' and project_name like '%7' then 'mailbox' else source_type end as t from m_catalog where confirmation_status = 'confirmed')
, r as (select id, case when t = 'server_alias' then 'server_alias not indexable' when t = 'mailbox' then 'no parser registered for catalog source type' when length(p) % 2 = 0 then null when starts_with(p, 'C:') then 'non-local absolute path not indexable on this platform' else 'source path not found' end as reason from c)
select id, case when reason is null then 'walk' when reason = 'source path not found' then 'missing' else 'skipped' end as action, reason from r"""),
    ),
    "metadata_preamble": (
        metadata_preamble,
        """with p as (select doc_id, text, list_filter([case when n_chars % 3 = 0 then '"exchange_index": ' || n_chars end, case when n_chars % 5 = 0 then '"is_compaction": true' end, '"project": ' || to_json(source), case when n_chars % 2 <> 0 then '"session_id": ' || to_json(lang) end, '"source_path": ' || to_json('/srv/"q" ' || source), '"source_type": ' || to_json(lang)], lambda x: x is not null) as f from documents)
, q as (select doc_id, 'INGESTION_METADATA {' || array_to_string(f, ', ') || '}' as line, text from p) select doc_id, line, sha256(line || chr(10) || chr(10) || text) as digest from q""",
    ),
    "confirmed_only": (confirmed_only, S.model("select id, source_type from m_catalog where confirmation_status = 'confirmed'")),
    "project_resolution": (
        project_resolution,
        S.model(""", r as (select * from m_catalog where source_type = 'project_root' and confirmation_status = 'confirmed') select 'SRC4' as query, id, 'exact_name' as method, false as ambiguous from r where project_name = 'src4' union all select '/srv/src5/', id, 'path_alias', false from r where path_or_alias = '/srv/src5'
union all select 'src', id, 'substring', (select count(*) from r) > 1 from r"""),
    ),
    "path_containment_join": (path_containment_join, S.model("select id from m_documents where starts_with(lower(path), '/srv/src1/') or starts_with(lower(path), '/srv/src2/')")),
    "context_ledger": (context_ledger, S.model("select source_id, status from m_ledger where starts_with(source_path_or_alias, '/srv/src5/') or project_name = 'src5'")),
    "context_documents": (context_documents, S.model(_DOCS_OF.format(more="or project_name = 'p2'") + "select id, path, cast(origin as int) as origin from dd")),
    "context_excerpts": (
        context_excerpts,
        S.model(_DOCS_OF.format(more="") + f", f as (select c.id, dd.path, c.content from m_chunks c join dd on dd.id = c.document_id order by origin, dd.path, c.chunk_index, c.id limit 15), b as (select id, path, {_CONTEXT_BODY} as body from f) select id, path, sha256(case when length(body) > 400 then substr(body, 1, 400) || '...' else body end) as digest, length(body) > 400 as truncated from b"),
    ),
    "context_memories": (context_memories, S.model("select id, status, confidence from (select * from m_memory where status in ('active', 'unverified') and (confidence is null or confidence >= 0.5) order by case when status = 'active' then 0 else 1 end, confidence desc nulls last, created_at desc, id limit 30)")),
    "related_documents": (related_documents, S.model("select id from m_catalog where source_type = 'document' and (starts_with(path_or_alias, '/srv/src5/') or list_contains(discovered_from, 'root_src5'))")),
    "related_servers": (related_servers, S.model("select id from m_catalog where source_type = 'server_alias' and (contains(array_to_string(discovered_from, ' '), 'src5') or contains(array_to_string(discovered_from, ' '), '/srv/src5'))")),
    "servers_of_any_root": (servers_of_any_root, S.model("select s.id from m_catalog s where s.source_type = 'server_alias' and exists (select 1 from m_catalog r where r.source_type = 'project_root' and r.confirmation_status = 'confirmed' and (contains(array_to_string(s.discovered_from, ' '), lower(r.project_name)) or contains(array_to_string(s.discovered_from, ' '), r.path_or_alias)))")),
    "stream_session_windows": (
        stream_session_windows,
        "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1800 second then 0 else 1 end as opens from events), s as (select user_id, ts, sum(opens) over (partition by user_id order by ts, opens desc rows unbounded preceding) as k from g) select user_id, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') as started, count(*) as n from s group by user_id, k",
    ),
    "stream_tumbling": (stream_tumbling, "select cast(date_trunc('hour', ts) as varchar) as started, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"),
    "stream_session_windows_live": (stream_session_windows_live, None),
    "stream_dedup": (stream_dedup, "select distinct user_id, event_type from events"),
    "stream_exchanges": (
        stream_exchanges,
        f"""with k as (select conv_id, turn, role, {S.strip("text")} as t, case when role = 'user' and length({S.strip("text")}) >= 3 then 1 else 0 end as opens from conversations where role in ('user', 'assistant'))
, g as (select *, sum(opens) over (partition by conv_id order by turn rows unbounded preceding) as ex from k where role = 'assistant' or opens = 1)
, x as (select conv_id, ex, max(case when role = 'user' then t end) as u, coalesce(string_agg(case when role = 'assistant' and t <> '' then t end, ' ' order by turn), '') as a, max(ex) over (partition by conv_id) as last from g where ex > 0 group by conv_id, ex)
select conv_id, cast(ex - 1 as int) as exchange_index, sha256(u) as user, sha256(a) as assistant from x where ex < last""",
    ),
}
