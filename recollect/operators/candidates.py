"""Memory candidates: from active chunks to admitted, deduplicated, capped memory nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recollect.functions import ids
from recollect.functions import text as T
from recollect.schemas import CANDIDATE_EXTENSIONS, CANDIDATE_LIMIT, CANDIDATE_SOURCE_LIMIT, COMPACTION_CONFIDENCE, CONFIDENCE, DEFAULT_CONFIDENCE, METADATA_MARKER, MIN_CANDIDATE_TOKENS
from recollect.scratch import Scratch

# Fixed patterns
COMPACTION_FLAG = r'"is_compaction"\s*:\s*true'
JSON_DUMP = r'(?s)^\s*\{.*"type"\s*:'
RESUME_PHRASE = "continue the conversation from where it left off"
TRANSCRIPT_LINE = r"(?i)(^|\n)\s*\[(?:user|assistant)\]:"
MESSAGE_INVENTORY = r"(?i)(^|\n)\s*\d+\.\s+all user messages\s*:"
NUMBERED_LINE = r"^\s*\d+\."
COMMAND_LINE = r"(?i)^\s*\d+\.\s*(?:build|check|copy|deploy|execute|find|lancia|mostra|open|restore|run|show|start|stop|trova|verifica|verify)\b.*`[^`]*(?:cargo|cp|docker|find|git|grep|ls|npm|powershell|ssh)[^`]*`"

_DATE = r"\d{4}-\d{2}-\d{2}"


def looks_like_commands(text: Column | str) -> Column:
    """Two numbered command lines or more that make up at least 66 % of the numbered lines."""
    lines = F.filter(F.split(T._c(text), "\r\n|\n|\r"), lambda x: x.rlike(NUMBERED_LINE))
    commands = F.size(F.filter(lines, lambda x: T.strip(x).rlike(COMMAND_LINE)))
    return (F.size(lines) >= 2) & (commands >= 2) & (commands / F.greatest(F.size(lines), F.lit(1)) >= 0.66)


def noisy_transcript(text: Column | str) -> Column:
    """Raw session fragments that stay searchable but should not become memories."""
    t = T.strip(text)
    return (F.instr(F.lower(t), RESUME_PHRASE) > 0) | t.rlike(MESSAGE_INVENTORY) | t.rlike(TRANSCRIPT_LINE) | looks_like_commands(t)


def json_dump(text: Column | str) -> Column:
    return F.substring(T._c(text), 1, 300).rlike(JSON_DUMP)


def session_title(path: str, content: str, marker: str = METADATA_MARKER) -> Column:
    """A title from the metadata line: the date of a digest, or the number and start of an exchange."""
    raw = F.regexp_extract(content, rf"(?m)^{marker}\s+(\{{.*\}})", 1)
    field = lambda k: F.get_json_object(raw, f"$.{k}")
    stem = F.regexp_replace(T.basename(T.physical_path(path)), r"(?<=[^.])\.[^.]*$", "")
    some = lambda c: F.when(c != "", c)
    stamp = F.coalesce(some(field("created_at")), some(field("last_modified")))
    dated = F.when(stamp.isNotNull(), F.substring(stamp, 1, 10)).otherwise(F.regexp_extract(F.coalesce(field("session_id"), F.lit("")), _DATE, 0))
    date = F.coalesce(some(dated), some(F.regexp_extract(stem, _DATE, 0)), stem)
    snippet = T.strip(F.regexp_replace(F.substring(T.strip_preamble_candidate(content, marker), 1, 60), "\n", " "))
    number = F.when(field("exchange_index").isNotNull(), F.concat(F.lit("#"), field("exchange_index"))).otherwise(F.lit(""))
    plain = F.when(snippet != "", F.concat(F.lit("Session Exchange"), F.when(number != "", F.concat(F.lit(" "), number)).otherwise(F.lit("")), F.lit(": "), snippet))
    fallback = F.concat(F.lit("Session Exchange "), number, F.lit(" ("), date, F.lit(")"))
    digest = F.when(date != "", F.concat(F.lit("Session Summary: "), date)).otherwise(F.lit("Session Summary"))
    return F.when(field("is_compaction") == "true", digest).otherwise(F.coalesce(plain, fallback))


def candidates(chunks: DataFrame, documents: DataFrame, ledger: DataFrame, marker: str = METADATA_MARKER) -> DataFrame:
    """Candidates of active sources with their class; JSON dumps and short texts are gone.

    `verdict` is non_document, noisy or candidate; `position` columns give the order of processing.
    """
    d = documents.select(F.col("id").alias("d_id"), F.col("path").alias("source_path"))
    live = ledger.where("status = 'active'").select(F.col("source_path_or_alias").alias("l_path"), F.col("source_type").alias("kind"))
    rows = chunks.select(F.col("id").alias("source_chunk_id"), "document_id", "chunk_index", "heading_path", "content").join(d, F.col("document_id") == F.col("d_id")).join(live, F.col("source_path") == F.col("l_path"))
    body = T.strip_preamble_candidate("content", marker)
    session = F.col("kind") == "agent_session"
    rows = rows.withColumn("text", body).withColumn("tokens", T.token_estimate("text")).where(~json_dump("text") & (F.col("tokens") >= MIN_CANDIDATE_TOKENS))
    flag = F.col("content").rlike(COMPACTION_FLAG)
    rows = rows.withColumn("is_compaction", F.coalesce(session & flag, F.lit(False)))
    confidence = F.when(F.col("is_compaction"), COMPACTION_CONFIDENCE)
    for k, v in CONFIDENCE.items():
        confidence = confidence.when(F.col("kind") == k, v)
    title = F.when(session, session_title("source_path", "content", marker)).otherwise(F.coalesce(F.when(F.col("heading_path") != "", F.col("heading_path")), T.basename("source_path")))
    verdict = F.when(session, F.when(noisy_transcript("text"), "noisy").otherwise("candidate")).when(T.suffix("source_path").isin(*CANDIDATE_EXTENSIONS), "candidate").otherwise("non_document")
    return rows.select(
        "source_chunk_id", F.col("document_id").alias("source_document_id"), "source_path", "chunk_index", F.col("kind").alias("source_type"), F.col("text").alias("content"), "tokens", "is_compaction",
        confidence.otherwise(DEFAULT_CONFIDENCE).alias("confidence"), title.alias("title"), F.coalesce(verdict, F.lit("non_document")).alias("verdict"), ids.content_hash("text").alias("content_hash"),
    )


#: Digests first, sessions before documents, longer ones first; then the order of the source.
def ranking() -> list[Column]:
    return [F.desc("is_compaction"), F.when(F.col("source_type") == "agent_session", 0).otherwise(1).asc(), F.desc("tokens"), F.asc("source_path"), F.asc("chunk_index"), F.asc("source_chunk_id")]


def blocklist(memory: DataFrame) -> DataFrame:
    """content_hash and the strongest reason against a new memory: active, unverified, or rejected (generated and obsolete)."""
    rejected = (F.col("status") == "obsolete") & (F.col("source_kind") == "auto") & (F.col("created_by") == "auto")
    rows = memory.where(F.coalesce(F.col("content_hash") != "", F.lit(False)) & (F.col("status").isin("active", "unverified") | rejected))
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "unverified", 1).otherwise(2)
    least = rows.groupBy("content_hash").agg(F.min(rank).alias("r"))
    return least.select("content_hash", F.element_at(F.array(F.lit("active"), F.lit("unverified"), F.lit("rejected")), F.col("r") + 1).alias("reason"))


def _judged(found: DataFrame, blocked: DataFrame, min_confidence: float) -> DataFrame:
    b = blocked.select(F.col("content_hash").alias("b_hash"), "reason")
    rows = found.join(b, F.col("content_hash") == F.col("b_hash"), "left").drop("b_hash")
    state = F.when(F.col("verdict") != "candidate", F.col("verdict")).when(F.col("reason").isNotNull(), F.concat(F.lit("duplicate_"), F.col("reason"))).when(F.col("confidence") < min_confidence, F.lit("low_confidence")).otherwise(F.lit("eligible"))
    return rows.withColumn("state", state).drop("reason")


def admit(found: DataFrame, blocked: DataFrame, min_confidence: float = DEFAULT_CONFIDENCE, limit: int = CANDIDATE_LIMIT, per_source: int = CANDIDATE_SOURCE_LIMIT) -> DataFrame:
    """Every candidate with its `state`, as a dry run counts them: created, source_limit, limit, or why not.

    The source cap comes before the global one and counters advance only on admission; with
    windows this is exact as long as hashes are not deduplicated within the run. A cap of 0
    means none.
    """
    rows = _judged(found, blocked, min_confidence)
    order = ranking()
    ok = rows.where("state = 'eligible'")
    by_source = ok.withColumn("at_source", F.row_number().over(Window.partitionBy("source_path").orderBy(*order)))
    if per_source > 0:
        passing = by_source.where(F.col("at_source") <= per_source)
    else:
        passing = by_source
    if limit > 0:
        # the first `limit` in order are a bounded set; who is in it decides everything else
        first = passing.orderBy(*order).limit(limit).select(F.col("source_chunk_id").alias("in_id"), F.col("source_path").alias("in_path"))
        full = first.groupBy("in_path").agg(F.count("*").alias("in_n"))
        tagged = by_source.join(F.broadcast(first.select("in_id", "in_path")), (F.col("source_chunk_id") == F.col("in_id")) & (F.col("source_path") == F.col("in_path")), "left").drop("in_path")
        tagged = tagged.join(F.broadcast(full), F.col("source_path") == F.col("in_path"), "left")
        over = (F.col("at_source") > per_source) & (F.coalesce("in_n", F.lit(0)) >= per_source) if per_source > 0 else F.lit(False)
        state = F.when(F.col("in_id").isNotNull(), "created").when(over, "source_limit").otherwise("limit")
        done = tagged.withColumn("state", state).drop("in_id", "in_path", "in_n", "at_source")
    else:
        over = F.col("at_source") > per_source if per_source > 0 else F.lit(False)
        done = by_source.withColumn("state", F.when(over, "source_limit").otherwise("created")).drop("at_source")
    return rows.where("state <> 'eligible'").unionByName(done)


def _decided(ordered: DataFrame, limit: int, per_source: int) -> DataFrame:
    """A table in order with the outcome of each row as `final`, worked out in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        used: dict[str, int] = {}
        made = 0
        for b in batches:
            out = []
            for path, digest in zip(b["source_path"], b["content_hash"], strict=True):
                if digest in seen:
                    out.append("duplicate_unverified")
                elif per_source > 0 and used.get(path, 0) >= per_source:
                    out.append("source_limit")
                elif limit > 0 and made >= limit:
                    out.append("limit")
                else:
                    out.append("created")
                    made += 1
                    used[path] = used.get(path, 0) + 1
                    seen.add(digest)
            yield b.assign(final=out)

    return ordered.coalesce(1).mapInPandas(run, StructType([*ordered.schema.fields, StructField("final", StringType())]))


def _prefix(thin: DataFrame, limit: int, per_source: int) -> DataFrame:
    """The rows, in order, that decide what is created: a bounded number, whatever the table.

    Of equal contents in a source only the first can be created. A content that is not yet created was turned
    away by full sources only, of which there are at most limit / per_source; a source's candidates were turned
    away by created contents only, of which there are at most `limit`. So before the last creation stand at most
    `limit` contents with that many sources each, and as many full sources with `limit` contents each.
    """
    order = ranking()
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    full = limit // per_source if per_source > 0 else 0
    rows = thin.withColumn("at", rank("content_hash", "source_path")).where("at = 1")
    rows = rows.withColumn("at", rank("content_hash")).where(F.col("at") <= full + 1)
    if per_source > 0:
        rows = rows.withColumn("at", rank("source_path")).where(F.col("at") <= limit)
    return rows.drop("at").orderBy(*order).limit(limit * (full + 1) + full * limit)


def _in_rounds(thin: DataFrame, per_source: int, run: Scratch) -> tuple[DataFrame, int]:
    """The rows that an ordered run without a limit creates, found in parallel rounds, and how many rounds it took.

    A row that is the first left of its content, and no farther back in its source than the source
    has room, is created whatever becomes of the rows before it. What it blocks leaves: all of its
    content, and all of its source if that is full. The first row of all is always such a row, so
    each round ends with fewer. Only rows left are carried on, as ids and hashes; limits of the
    windows act in the tasks, so that no frequent content or source gathers.
    """
    order, made, rounds = ranking(), [], 0
    first = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    # a null source is one source
    left = run.keep(thin.withColumn("source", F.struct(F.col("source_path").isNull(), F.coalesce("source_path", F.lit(""))).cast("string")), "undecided")
    used = left.select("source").where("false").withColumn("used", F.lit(0).cast("long"))
    while not left.isEmpty():
        rounds += 1
        heads = left.withColumn("at", first("content_hash", 1)).where("at = 1").drop("at")
        if per_source > 0:
            front = left.withColumn("at", first("source", per_source)).where(F.col("at") <= per_source).select(F.col("source_chunk_id").alias("f_id"), F.col("source").alias("f_source"), "at")
            room = front.join(used.withColumnRenamed("source", "u_source"), F.col("f_source") == F.col("u_source"), "left").where(F.col("at") + F.coalesce("used", F.lit(0)) <= per_source).select("f_id", "f_source")
            heads = heads.join(room, (F.col("source_chunk_id") == F.col("f_id")) & (F.col("source") == F.col("f_source")), "left_semi")
        now = run.keep(heads, "created")
        made.append(now)
        left = left.join(now.select(F.col("content_hash").alias("n_hash")), F.col("content_hash") == F.col("n_hash"), "left_anti")
        if per_source > 0:
            used = run.keep(used.unionByName(now.groupBy("source").agg(F.count("*").alias("used"))).groupBy("source").agg(F.sum("used").alias("used")), "used")
            left = left.join(used.where(F.col("used") >= per_source).select(F.col("source").alias("full")), F.col("source") == F.col("full"), "left_anti")
        left = run.keep(left, "undecided")
    out = thin.where("false")
    for part in made:
        out = out.union(part.select(thin.columns))
    return out, rounds


def admit_in_order(found: DataFrame, blocked: DataFrame, min_confidence: float = DEFAULT_CONFIDENCE, limit: int = CANDIDATE_LIMIT, per_source: int = CANDIDATE_SOURCE_LIMIT, run: Scratch | None = None) -> DataFrame:
    """The real run: as admit(), but a created memory blocks its content for the rest of the run.

    What is admitted depends on all that came before. With a `limit`, a bounded number of rows decides which are
    created, and those go through one task in order. Without one (0), the created rows are found in
    parallel rounds. Every other row is decided by joins with the created ones. A chunk's id is expected once in a source.
    """
    run = run or Scratch(found.sparkSession)
    # judged once; contents are joined for what is returned
    rows = run.keep(_judged(found, blocked, min_confidence), "judged")
    thin = rows.where("state = 'eligible'").select("source_chunk_id", "source_path", "content_hash", "is_compaction", "source_type", "tokens", "chunk_index")
    # a row's place in the order as a struct, which compares field by field
    place = F.struct(~F.col("is_compaction"), F.coalesce(F.col("source_type") != "agent_session", F.lit(True)), -F.col("tokens"), "source_path", "chunk_index", "source_chunk_id")
    made = _in_rounds(thin, per_source, run)[0] if limit <= 0 else _decided(_prefix(thin, limit, per_source), limit, per_source).where("final = 'created'")
    made = made.select(F.col("content_hash").alias("m_hash"), F.col("source_path").alias("m_path"), place.alias("m_at"))
    in_source = Window.partitionBy("m_path").orderBy("m_at")
    filled = made.withColumn("n", F.row_number().over(in_source)).where(F.col("n") == per_source).select(F.col("m_path").alias("f_path"), F.col("m_at").alias("f_at"))
    last = made.agg(F.count("*").alias("made_n"), F.max("m_at").alias("last_at"))
    # with a limit, at most so many rows on the small side of each join
    small = F.broadcast if limit > 0 else lambda df: df
    at = rows.where("state = 'eligible'").withColumn("place", place)
    at = at.join(small(made.select("m_hash", F.col("m_at"))), F.col("content_hash") == F.col("m_hash"), "left")
    at = at.join(small(filled), F.col("source_path").eqNullSafe(F.col("f_path")), "left").join(F.broadcast(last))
    state = F.when(F.col("m_at") == F.col("place"), "created").when(F.col("m_at") < F.col("place"), "duplicate_unverified").when(F.col("f_at") < F.col("place"), "source_limit").when((F.col("made_n") >= limit) & (F.col("last_at") < F.col("place")), "limit")
    ok = at.withColumn("state", state).drop("place", "m_hash", "m_at", "f_path", "f_at", "made_n", "last_at")
    return rows.where("state <> 'eligible'").unionByName(ok)


def telemetry(found: DataFrame, blocked: DataFrame, min_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """One row of counts over the candidates, without admitting any."""
    rows = _judged(found, blocked, min_confidence)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    s = F.col("state")
    return rows.agg(
        n(F.col("verdict") == "candidate").alias("candidates"), n(s.startswith("duplicate_")).alias("duplicate_skips"), n(s == "duplicate_active").alias("duplicate_active"), n(s == "duplicate_unverified").alias("duplicate_unverified"),
        n(s == "duplicate_rejected").alias("duplicate_rejected"), n(s == "low_confidence").alias("low_confidence"), n(s == "non_document").alias("non_document_skipped"), n(s == "noisy").alias("noisy_session_skipped"),
    )


def new_memories(admitted: DataFrame, now: Column) -> DataFrame:
    """Memory nodes for the created candidates; the id follows from content and place."""
    rows = admitted.where("state = 'created'")
    key = F.substring(F.sha2(F.concat_ws("|", "source_chunk_id", "source_path", "content_hash").cast("binary"), 256), 1, 32)
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("mem_"), key).alias("id"), F.lit("default").alias("project_id"), F.lit("note").alias("type"), "title", "content", F.lit("unverified").alias("status"), F.lit("auto").alias("source_kind"), "source_document_id", "source_chunk_id",
        "source_path", "content_hash", F.lit("auto").alias("created_by"), none.alias("model_name"), "confidence", now.alias("created_at"), now.alias("updated_at"),
    )
