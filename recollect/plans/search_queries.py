"""Queries of retrieval, text functions and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import ids
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import chunking, embedding, postings, retrieval, vector_index
from recollect.plans import fixtures as fx
from recollect.plans import sql as S
from recollect.scratch import Scratch
from recollect.sources import sessions

TERMS = ["of", "the", "tion", "erly", "que", "und"]
QUERY = " ".join(TERMS)
_T = sorted(TERMS)


def _text(spark: SparkSession, d: str) -> DataFrame:
    return fx.load(spark, d, "documents").select("doc_id", "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.bm25(_text(spark, d), _T, "text")
    return hits.select("doc_id", F.round("raw_score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from a postings index. Ids are padded, so that ties stand in the order of numbers."""
    index = postings.Postings(spark, Scratch(spark).at)
    index.update(None, _text(spark, d).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "text"), "text")
    # a place more than wanted at the end: scores are ranked before they are rounded
    hits = index.search(_T, 50 + len(_T))
    return hits.select(F.col("id").cast("long").alias("doc_id"), F.round("raw_score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def bm25_gated_boosted(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search_chunks(fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), QUERY)
    return hits.select("id", "path", "score").orderBy(F.desc("score"), "id").limit(50)


def ledger_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.gated_chunks(fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d))
    return rows.select("id", "path")


def token_overlap_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_memories(fx.memory(spark, d), QUERY).select("id", "score").orderBy(F.desc("score"), "id").limit(50)


def global_search_union(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.global_search(fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), fx.memory(spark, d), QUERY, top_k=50)
    return hits.select("id", "kind", "title", "source_path", "memory_type", "status", "score", "content_excerpt")


def global_search_memory(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.global_search(fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), fx.memory(spark, d), QUERY, top_k=40, kind="memory", include_inactive=True)
    return hits.select("id", "title", "status", "score", "confidence")


def project_search_lexical(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.project_search(fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), fx.memory(spark, d), QUERY, top_k=40)
    return hits.select("id", "title", "source_path", "memory_type", "status", "score")


def and_substring_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _text(spark, d).withColumnRenamed("doc_id", "id")
    return retrieval.substring_search(rows, "the tion", 30).select("id", F.length("text").cast("long").alias("n"))


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The first vector, as a query: a single row."""
    return [float(x) for x in fx.load(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    points = fx.load(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.vector_search(points, _vector(spark, d), 25).select("point_id", "score")


def _vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = fx.load(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return fx.chunks(spark, d).join(v, F.col("doc_id") == F.col("v_id"))


def dot_topk_gated(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.semantic_hits(_vector_chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), _vector(spark, d), 25)
    return hits.select("id", "path", "score")


def _indexed(spark: SparkSession, d: str, key: str) -> vector_index.VectorIndex:
    points = fx.load(spark, d, "embeddings").select(F.expr(key).alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = vector_index.VectorIndex(spark, Scratch(spark).at, len(_vector(spark, d)))
    index.upsert(points)
    return index


def cosine_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from the index of cells, all of them probed."""
    hits = _indexed(spark, d, "cast(vec_id as string)").nearest(_vector(spark, d), 25, cosine=True)
    return hits.select(F.col("id").cast("long").alias("point_id"), F.round("sim", 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "point_id").limit(25)


def dot_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """dot_topk_gated from the index of cells, all of them probed."""
    index = _indexed(spark, d, "concat('d', vec_id, '_chunk_0')")
    return vector_index.semantic_hits(index, fx.chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), _vector(spark, d), 25).select("id", "path", "score")


def semantic_then_lexical(spark: SparkSession, d: str) -> DataFrame:
    """With vectors there: semantic hits alone."""
    hits = retrieval.project_search(_vector_chunks(spark, d), fx.documents(spark, d), fx.ledger(spark, d), fx.memory(spark, d), QUERY, 25, _vector(spark, d))
    return hits.select("id", "memory_type", "score")


def semantic_empty_then_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Without vectors: the lexical branch of the same plan."""
    rows = fx.chunks(spark, d).withColumn("embedding", F.lit(None).cast("array<double>"))
    hits = retrieval.project_search(rows, fx.documents(spark, d), fx.ledger(spark, d), fx.memory(spark, d), QUERY, 40, [1.0, 0.0])
    return hits.select("id", "memory_type", "score")


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = fx.load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = v.select("vec_id", V.l2_normalized("v").alias("u"), V.norm("v").alias("norm"))
    return n.select("vec_id", F.round("norm", 4).alias("norm"), F.round(F.col("u")[0], 4).alias("u0"), F.round(V.norm("u"), 6).alias("unit"))


def hash_embed_sha2(spark: SparkSession, d: str) -> DataFrame:
    v = embedding.embed_sha2(_text(spark, d), "doc_id", "text")
    cells = v.select("doc_id", F.posexplode("embedding").alias("cell", "x")).where("x <> 0")
    return cells.groupBy("doc_id").agg(F.count("*").alias("n_cells"), (F.round(F.sum("x"), 4) + F.lit(0.0)).alias("total"), F.round(F.max("x"), 4).alias("largest"), F.min("cell").alias("first_cell"))


def hash_embed_blake2b(spark: SparkSession, d: str) -> DataFrame:
    v = embedding.embed(_text(spark, d), "doc_id", "text", prefix="passage: ")
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_cells"), F.round(V.norm("embedding"), 6).alias("unit"))


def doc_ids_and_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.documents(spark, d)
    doc = ids.document_id("path")
    chunk = ids.chunk_id(doc, F.lit(0))
    return rows.select("doc_id", "content_hash", doc.alias("document_id"), chunk.alias("chunk_id"), ids.vector_point_id(chunk).alias("point_id"), ids.source_id("document", F.concat(F.lit(" "), F.upper("path"), F.lit("/ "))).alias("source_id"), T.basename("path").alias("basename"), T.suffix("path").alias("suffix"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = _text(spark, d)
    return t.select("doc_id", T.token_estimate("text").alias("n_tokens"), F.size(T.token_set("text")).alias("n_distinct"), F.length(T.normalize_newlines("text")).alias("n_chars"))


def alpha_ratio_filter(spark: SparkSession, d: str) -> DataFrame:
    return _text(spark, d).where(T.passes_alpha_filter("text", 0.75)).select("doc_id", F.round(T.alpha_ratio("text"), 6).alias("ratio"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return _text(spark, d).select("doc_id", T.excerpt("text", 120).alias("excerpt"), F.length(T.head("text", 400)).alias("n_head"), T.first_line_title("text").alias("title"))


def strip_preambles(spark: SparkSession, d: str) -> DataFrame:
    c = fx.chunks(spark, d)
    return c.select("id", F.sha2(T.strip_preamble_search("content").cast("binary"), 256).alias("search"), F.sha2(T.strip_preamble_candidate("content").cast("binary"), 256).alias("candidate"))


#: Lines that become headings of three depths, by how they begin.
_AS_HEADINGS = ((r"(?m)^([A-D].*)$", "# "), (r"(?m)^([E-L].*)$", "### "), (r"(?m)^([M-P].*)$", "## "))


def _headed(text):
    for pattern, mark in _AS_HEADINGS:
        text = F.regexp_replace(text, pattern, mark + "$1")
    return text


def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the texts stand for headings by their first letter, as the texts have none."""
    docs = _text(spark, d).select("doc_id", _headed(F.col("text")).alias("text"))
    return chunking.chunk(docs, "text", 1200, ("doc_id",)).select("doc_id", "chunk_index", "heading_path", "content_hash", "token_count")


def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any chunking: all words of a text, headings included, are in its chunks."""
    parts = chunking.chunk(_text(spark, d), "text", 1200, ("doc_id",))
    return parts.groupBy("doc_id").agg(F.sum("token_count").alias("n_tokens"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return fx.load(spark, d, "conversations")


def session_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return sessions.exchanges(_turns(spark, d), "conv_id", "turn")


def session_first_values(spark: SparkSession, d: str) -> DataFrame:
    """Turns as log lines: the first id, time and model of each session, by the operator that reads logs."""
    turn = F.col("turn")
    lines = _turns(spark, d).select(
        F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), turn.alias("line_no"),
        F.struct(
            F.when(F.col("role") == "assistant", "system").otherwise(F.col("role")).alias("type"), F.when((turn > 0) & (F.col("conv_id") % 3 > 0), F.substring("text", 1, 12)).alias("session_id"),
            F.struct(F.when(F.col("role") == "user", (F.lit(1767225600) + turn * 60).cast("long")).alias("timestamp"), F.when((F.col("conv_id") % 3 == 0) & (turn > 1), F.concat(F.lit("p-"), turn.cast("string"))).alias("id")).alias("payload"),
            F.substring("text", 1, 5).alias("model"),
        ).alias("row"),
    )
    values = sessions.session_values(lines.select("file", "line_no", F.parse_json(F.to_json("row")).alias("v")))
    return values.select("file", "session_id", "created_at", "model", F.col("n_lines").cast("long").alias("n_lines"))


def noise_user_filter(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).withColumn("text", F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" <system>"), "text")).when(F.col("turn") % 7 == 3, F.substring("text", 1, 2)).otherwise(F.col("text")))
    return t.where((F.col("role") == "user") & ~sessions.noise_user_text("text")).select("conv_id", "turn")


def epoch_values(spark: SparkSession, d: str) -> DataFrame:
    """Seconds, milliseconds and overflow."""
    e = fx.load(spark, d, "events")
    x = F.expr("case event_id % 3 when 0 then 1767225600.0D + event_id when 1 then 1770887989000.0D + event_id * 1000 else 1e30D end")
    return e.select("event_id", sessions.epoch_to_iso(x).alias("iso"))


_BM25_DOCS = S.bm25("rows_", _T)
_GATED = f"""
, rows_ as (select c.id || coalesce(l.source_id, '') as row_id, c.*, d.path, {{body}} as body from m_chunks c join m_documents d on d.id = c.document_id left join m_ledger l on l.source_path_or_alias = d.path where {S.VISIBLE})
"""
_CHUNK_HITS = f"select r.id, r.path, round(raw * {S.BOOST}, 6) as score from scored s join rows_ r using (row_id)"
_MEM = "select id, round(0, 4) as x"
_OVERLAP = S.overlap("concat(coalesce(title, ''), ' ', coalesce(content, ''))", _T)
_OVERLAP10 = S.overlap("concat(coalesce(title, ''), ' ', coalesce(content, ''), ' ', coalesce(source_path, ''))", _T, "10.0")
_ACTIVE = "status in ('active', 'unverified')"
_BASENAME = "list_extract(string_split({0}, '/'), -1)"
_VEC = "(select embedding from embeddings order by vec_id limit 1)"
_DOT = f"list_dot_product(cast(e.embedding as double[]), cast({_VEC} as double[]))"
_LEXICAL = f"""
{_GATED.format(body="c.content")}{_BM25_DOCS}
, lex as (select id, 0 as kr, title, source_path, type as memory_type, status, {_OVERLAP} as score from m_memory where {_ACTIVE}
          union all select r.id, 1, coalesce(nullif(r.heading_path, ''), {_BASENAME.format("r.path")}), r.path, 'document_chunk', 'active', round(raw * {S.BOOST}, 6) from scored s join rows_ r using (row_id))
"""

def _headed_sql(text: str) -> str:
    for pattern, mark in _AS_HEADINGS:
        text = rf"regexp_replace({text}, '{pattern}', '{mark}\1', 'g')"
    return text


#: Line by line: a heading, or a line that does not fit, opens a chunk; headings of the same or a greater depth go when one comes.
_HEAD = rf"regexp_extract(line, '\A(#{{1,6}}){S.WS}+(.+?){S.WS}*\z', ['depth', 'title'])"
_HEADING_CHUNKS = rf"""with recursive lines as (
    select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as line from (select doc_id, string_split({S.strip(r"regexp_replace(text, '\r\n?', chr(10), 'g')")}, chr(10)) as ls from (select doc_id, {_headed_sql("text")} as text from documents where text is not null))
), heads as (
    select doc_id, i, line, length(line) as n, length(h.depth) as depth, {S.strip("h.title")} as title from (select *, {_HEAD} as h from lines)
), cut as (
    select doc_id, i, 0 as chunk, n + 1 as size, case when depth > 0 then [{{'d': depth, 't': title}}] else [] end as path from heads where i = 1
    union all
    select h.doc_id, h.i, case when h.depth > 0 or c.size + h.n > 1200 then c.chunk + 1 else c.chunk end, case when h.depth > 0 or c.size + h.n > 1200 then h.n + 1 else c.size + h.n + 1 end,
        case when h.depth > 0 then list_append(list_filter(c.path, lambda p: p.d < h.depth), {{'d': h.depth, 't': h.title}}) else c.path end
    from cut c join heads h on h.doc_id = c.doc_id and h.i = c.i + 1
), bodies as (
    select doc_id, chunk, any_value(path) as path, {S.strip("string_agg(line, chr(10) order by i)")} as body from cut join lines using (doc_id, i) group by doc_id, chunk
)
select doc_id, cast(row_number() over (partition by doc_id order by chunk) - 1 as int) as chunk_index, case when len(path) > 0 then array_to_string(list_transform(path, lambda p: p.t), ' > ') end as heading_path,
    sha256(body) as content_hash, cast({S.token_estimate("body")} as int) as token_count from bodies where body <> ''"""


_BM25_TOPK = f"with rows_ as (select doc_id as row_id, text as body from documents) {_BM25_DOCS} select row_id as doc_id, round(raw, 6) as score from scored order by score desc, doc_id limit 50"

QUERIES = {
    "bm25_topk": (bm25_topk, _BM25_TOPK),
    "bm25_postings": (bm25_postings, _BM25_TOPK),
    "bm25_gated_boosted": (bm25_gated_boosted, S.model(f"{_GATED.format(body='c.content')}{_BM25_DOCS}{_CHUNK_HITS} order by score desc, id limit 50")),
    "ledger_gate": (ledger_gate, S.model(f"select c.id, d.path from m_chunks c join m_documents d on d.id = c.document_id left join m_ledger l on l.source_path_or_alias = d.path where {S.VISIBLE}")),
    "token_overlap_search": (token_overlap_search, S.model(f"select * from (select id, {_OVERLAP} as score from m_memory where {_ACTIVE}) where score > 0 order by score desc, id limit 50")),
    "global_search_union": (
        global_search_union,
        S.model(f"""{_GATED.format(body=S.strip_search("c.content"))}{_BM25_DOCS}
, both_ as (select id, 'memory_node' as kind, 0 as kr, title, content, source_path, type as memory_type, status, {_OVERLAP10} as score from m_memory where {_ACTIVE}
           union all select r.id, 'document_chunk', 1, coalesce(nullif(r.heading_path, ''), {_BASENAME.format("r.path")}), r.body, r.path, 'document_chunk', 'active', round(raw * {S.BOOST}, 6) from scored s join rows_ r using (row_id))
, best as (select * from both_ where score > 0 order by score desc, kr, title, id limit 50)
select id, kind, title, source_path, memory_type, status, score, {S.excerpt("content", 240)} as content_excerpt from best"""),
    ),
    "global_search_memory": (global_search_memory, S.model(f"select * from (select id, title, status, {_OVERLAP10} as score, confidence from m_memory) where score > 0 order by score desc, title, id limit 40")),
    "project_search_lexical": (project_search_lexical, S.model(f"{_LEXICAL} select id, title, source_path, memory_type, status, score from lex where score > 0 order by score desc, kr, id limit 40")),
    "and_substring_search": (and_substring_search, "select doc_id as id, length(text) as n from documents where contains(lower(text), 'the') and contains(lower(text), 'tion') order by doc_id limit 30"),
    "cosine_topk": (cosine_topk, f"select * from (select vec_id as point_id, round(list_cosine_similarity(cast(embedding as double[]), cast({_VEC} as double[])), 4) as score from embeddings) where score > 0 order by score desc, point_id limit 25"),
    "cosine_topk_indexed": (cosine_topk_indexed, f"select * from (select vec_id as point_id, round(list_cosine_similarity(cast(embedding as double[]), cast({_VEC} as double[])), 4) as score from embeddings) where score > 0 order by score desc, point_id limit 25"),
    "dot_topk_gated": (dot_topk_gated, S.model(f"select * from (select c.id, d.path, round({_DOT}, 4) as score from m_chunks c join embeddings e on e.vec_id = c.doc_id join m_documents d on d.id = c.document_id left join m_ledger l on l.source_path_or_alias = d.path where {S.VISIBLE} and {_DOT} > 0) order by score desc, id limit 25")),
    "dot_topk_indexed": (dot_topk_indexed, S.model(f"select * from (select c.id, d.path, round({_DOT}, 4) as score from m_chunks c join embeddings e on e.vec_id = c.doc_id join m_documents d on d.id = c.document_id left join m_ledger l on l.source_path_or_alias = d.path where {S.VISIBLE} and {_DOT} > 0) order by score desc, id limit 25")),
    "semantic_then_lexical": (semantic_then_lexical, S.model(f"select id, 'document_chunk' as memory_type, score from (select c.id, round({_DOT}, 4) as score from m_chunks c join embeddings e on e.vec_id = c.doc_id join m_documents d on d.id = c.document_id left join m_ledger l on l.source_path_or_alias = d.path where {S.VISIBLE} and {_DOT} > 0) order by score desc, id limit 25")),
    "semantic_empty_then_lexical": (semantic_empty_then_lexical, S.model(f"{_LEXICAL} select id, memory_type, score from lex where score > 0 order by score desc, kr, id limit 40")),
    "l2_normalize": (l2_normalize, "with v as (select vec_id, cast(embedding as double[]) as v from embeddings), n as (select *, sqrt(list_dot_product(v, v)) as nn from v) select vec_id, round(nn, 4) as norm, round(v[1] / nn, 4) as u0, case when nn = 0 then 0.0::double else 1.0::double end as unit from n"),
    "hash_embed_sha2": (
        hash_embed_sha2,
        r"""with t as (select doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) as token from documents), c as (select doc_id, token, count(*) as n, sha256(token) as h from t group by 1, 2)
, x as (select doc_id, cast('0x' || substr(h, 1, 7) as bigint) % 384 as cell, sum(n * case when cast('0x' || substr(h, 8, 1) as int) % 2 = 0 then 1.0 else -1.0 end)::double as x from c group by 1, 2)
, u as (select doc_id, cell, x / sqrt(sum(x * x) over (partition by doc_id)) as u from x where x <> 0)
select doc_id, count(*) as n_cells, round(sum(u), 4) + 0.0::double as total, round(max(u), 4) as largest, cast(min(cell) as int) as first_cell from u group by 1""",
    ),
    "hash_embed_blake2b": (hash_embed_blake2b, None),
    "doc_ids_and_hashes": (
        doc_ids_and_hashes,
        S.model("""select doc_id, content_hash, 'doc_' || substr(sha256(path), 1, 24) as document_id, 'doc_' || substr(sha256(path), 1, 24) || '_chunk_0' as chunk_id,
regexp_replace(substr(sha256('doc_' || substr(sha256(path), 1, 24) || '_chunk_0'), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as point_id, 'document:' || substr(sha256(lower(path)), 1, 32) as source_id,
list_extract(string_split(path, '/'), -1) as basename, '.' || list_extract(string_split(path, '.'), -1) as suffix from m_documents"""),
    ),
    "token_estimate": (token_estimate, rf"select doc_id, cast({S.token_estimate('text')} as int) as n_tokens, cast(len(list_distinct({S.tokens('text')})) as int) as n_distinct, cast(length({S.strip(r"regexp_replace(text, '\r\n?', chr(10), 'g')")}) as int) as n_chars from documents"),
    "alpha_ratio_filter": (alpha_ratio_filter, r"select * from (select doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::double, 6) as ratio, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::double as raw from documents where length(text) > 0) where raw >= 0.75".replace("select * from", "select doc_id, ratio from")),
    "excerpts": (excerpts, f"select doc_id, {S.excerpt('text', 120)} as excerpt, cast(case when length(text) > 400 then 403 else length(text) end as int) as n_head, substr({S.strip(f'list_extract(string_split({S.strip("text")}, chr(10)), 1)')}, 1, 80) as title from documents"),
    "strip_preambles": (strip_preambles, S.model(f"select id, sha256({S.strip_search('content')}) as search, sha256({S.strip_candidate('content')}) as candidate from m_chunks")),
    "heading_chunks": (heading_chunks, _HEADING_CHUNKS),
    "chunk_bounds": (chunk_bounds, f"select doc_id, cast({S.token_estimate('text')} as bigint) as n_tokens from documents where {S.token_estimate('text')} > 0"),
    "session_exchanges": (
        session_exchanges,
        f"""with k as (select conv_id, turn, role, text, case when role = 'user' and length({S.strip("text")}) >= 3 then 1 else 0 end as opens from conversations where role in ('user', 'assistant'))
, g as (select *, sum(opens) over (partition by conv_id order by turn rows unbounded preceding) as ex from k where role = 'assistant' or opens = 1)
, t as (select conv_id, ex, max(case when role = 'user' then {S.strip("text")} end) as u, {S.strip("string_agg(case when role = 'assistant' then " + S.strip("text") + " end, ' ' order by turn)")} as a from g where ex > 0 group by 1, 2)
select conv_id, cast(ex - 1 as int) as exchange_index, case when coalesce(a, '') <> '' and 600 - length(substr(u, 1, 600)) > 20 then '[User]: ' || substr(u, 1, 600) || chr(10) || '[Assistant]: ' || substr(a, 1, 600 - length(substr(u, 1, 600))) else '[User]: ' || substr(u, 1, 600) end as text from t""",
    ),
    "session_first_values": (
        session_first_values,
        f"""with t as (select *, {S.strip("substr(text, 1, 12)")} as short, {S.strip("substr(text, 1, 5)")} as name from conversations)
select '/logs/' || conv_id || '.jsonl' as file, coalesce(arg_min(case when conv_id % 3 = 0 then case when turn > 1 then 'p-' || turn end when turn > 0 then nullif(short, '') end, turn), 'session:' || conv_id) as session_id,
    arg_min(case when role = 'user' then strftime(to_timestamp(1767225600 + turn * 60) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' end, turn) as created_at,
    arg_min(case when role in ('assistant', 'system') then nullif(name, '') end, turn) as model, count(*) as n_lines from t group by conv_id""",
    ),
    "noise_user_filter": (
        noise_user_filter,
        f"""with t as (select conv_id, turn, role, {S.strip("case when turn % 4 = 0 then ' <system>' || text when turn % 7 = 3 then substr(text, 1, 2) else text end")} as t from conversations)
select conv_id, turn from t where role = 'user' and length(t) >= 3 and not ({" or ".join(f"starts_with(t, '{p}')" for p in sessions.NOISE_PREFIXES)})""",
    ),
    "epoch_values": (epoch_values, "select event_id, case event_id % 3 when 0 then strftime(to_timestamp(1767225600 + event_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' when 1 then strftime(to_timestamp(1770887989 + event_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' end as iso from events"),
}
