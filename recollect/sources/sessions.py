"""Agent session logs: JSON lines of several dialects, as VARIANT, into exchanges and digests.

Logs are read in splits, and nothing that is gathered grows with a session, but for its digests.
`content` is a string in some rows and an array of blocks in others, which is why lines are
parsed to VARIANT and not with an inferred schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.scratch import Scratch

MAX_EXCHANGE_CHARS = 600
# Fixed values
NOISE_PREFIXES = ("<environment_context>", "<turn_aborted>", "<INSTRUCTIONS>", "<instructions>", "<system>", "<tool_result>", "This session is being continued")
TOOL_BLOCKS = ("tool_use", "tool_call", "tool_result", "tool")
DIGEST_TYPES = ("compacted", "compaction", "summary")
RESUMED = "This session is being continued"
ROLES = ("user", "assistant", "system")


def log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, modified, line_no and line of the *.jsonl files below paths; large files are read in splits.

    Line numbers rise in a file, with gaps: within a split rows come in order and Spark's ids
    rise; splits are told apart by where they start.
    """
    if not paths:
        return spark.createDataFrame([], "file string, modified timestamp, line_no long, line string")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("ignoreMissingFiles", True).text(paths)
    meta = "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_block_start"
    rows = raw.select(*(F.col(m) for m in meta), F.monotonically_increasing_id().alias("i"), "value")
    line_no = F.col("file_block_start") * 1024 + F.col("i") % F.lit(1 << 33)
    return rows.select(F.col("file_path").alias("file"), F.col("file_modification_time").alias("modified"), line_no.alias("line_no"), F.col("value").alias("line")).where("trim(line) <> ''")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, modified, line_no, v: every line that is a JSON object."""
    rows = log_lines(spark, paths).withColumn("v", F.try_parse_json(T.strip("line")))
    return rows.where("v is not null and schema_of_variant(v) like 'OBJECT%'").select("file", "modified", "line_no", "v")


def _is_text(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"


def _text(v: Column, path: str) -> Column:
    """The value at a path if it is a string."""
    return F.when(_is_text(v, path), F.try_variant_get(v, path, "string"))


def _object(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))


def _kind(v: Column, path: str = "$.type") -> Column:
    return F.lower(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _filled(c: Column) -> Column:
    t = T.strip(c)
    return F.when(t != "", t)


def content_text(v: Column, path: str) -> Column:
    """The text of a content field: a string, or the texts of its blocks that are no tool calls; null if there is none."""
    blocks = F.try_variant_get(v, path, "array<variant>")
    own = F.transform(blocks, lambda b: F.when(F.schema_of_variant(b).startswith("OBJECT") & ~_kind(b).isin(*TOOL_BLOCKS), _filled(F.when(F.try_variant_get(b, "$.text", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(b, "$.text", "variant")), _text(b, "$.text")).otherwise(_text(b, "$.content")))))
    joined = F.array_join(F.filter(own, lambda t: t.isNotNull()), "\n\n")
    return F.when(_is_text(v, path), _filled(_text(v, path))).when(blocks.isNotNull(), F.when(joined != "", joined))


def messages(lines: DataFrame) -> DataFrame:
    """file, modified, line_no, role, text of the rows that are messages, whatever their dialect."""
    v = F.col("v")
    kind, inner = _kind(v), _kind(v, "$.payload.type")
    payload = _object(v, "$.payload")
    enveloped = (kind == "response_item") & payload
    event = (kind == "event_msg") & payload
    said = _text(v, "$.payload.message")
    rows = lines.withColumn("m", F.when(enveloped, F.when(inner == "message", F.try_variant_get(v, "$.payload", "variant"))).when(~event, v))
    rows = rows.withColumn("e_role", F.when(event & said.isNotNull(), F.when(inner == "user_message", "user").when(inner == "agent_message", "assistant")))
    m = F.col("m")
    pick = lambda c: F.when(c.isin(*ROLES), c)
    nested = _object(m, "$.message")
    role = F.coalesce(pick(_kind(m)), F.when(nested, F.coalesce(pick(_kind(m, "$.message.role")), pick(_kind(m, "$.message.type")))), pick(_kind(m, "$.role")))
    plain = F.coalesce(_filled(_text(m, "$.text")), _filled(_text(m, "$.message")))
    silent = (_kind(m) == "system") | (_kind(m, "$.role") == "system")
    text = F.coalesce(F.when(nested, content_text(m, "$.message.content")), content_text(m, "$.content"), F.when(~silent, plain))
    rows = rows.select("file", "modified", "line_no", F.coalesce("e_role", F.when(m.isNotNull(), role)).alias("role"), F.coalesce(F.when(F.col("e_role").isNotNull(), _filled(said)), F.when(m.isNotNull(), text)).alias("text"))
    return rows.where("role is not null and text is not null")


def noise_user_text(text: Column | str) -> Column:
    """Too short, or put in by the tool rather than the user."""
    t = T.strip(text)
    out = F.length(t) < 3
    for p in NOISE_PREFIXES:
        out = out | F.startswith(t, F.lit(p))
    return out


def exchange_text(user: Column, assistant: Column, limit: int = MAX_EXCHANGE_CHARS) -> Column:
    """Both parts within the limit; the answer only if more than 20 characters are left for it."""
    u = F.substring(user, 1, limit)
    left = limit - F.length(u)
    return F.when((assistant != "") & (left > 20), F.concat(F.lit("[User]: "), u, F.lit("\n[Assistant]: "), F.substring(assistant, F.lit(1), left))).otherwise(F.concat(F.lit("[User]: "), u))


def exchanges(rows: DataFrame, session: str = "file", order: str = "line_no", limit: int = MAX_EXCHANGE_CHARS) -> DataFrame:
    """session, exchange_index (from 0), text: a user's message and the answers up to the next one.

    rows: session, order, role, text. Messages of the user that are noise neither open nor close.
    One shuffle by session. Running sums, which need one row at a time, number the turns and tell
    where in its turn an answer begins; answers beyond the limit go before any are gathered, so a
    turn holds at most `limit` pieces, however long the session is.
    """
    opens = F.col("role").eqNullSafe("user") & ~noise_user_text("text")
    cut = rows.select(session, order, opens.alias("opens"), (F.col("role") == "assistant").alias("answers"), T.strip("text").alias("t")).where("opens or answers")
    cut = cut.select(session, order, "opens", F.length("t").alias("size"), F.substring("t", 1, limit + 1).alias("t"))
    past = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = cut.withColumn("turn", F.sum(F.col("opens").cast("int")).over(past(session))).where("turn > 0")
    # blank answers at the start of a turn are not part of the text
    said = turns.withColumn("said", F.sum((~F.col("opens") & (F.col("size") > 0)).cast("int")).over(past(session, "turn"))).where("opens or said > 0")
    before = F.sum(F.when(~F.col("opens"), F.col("size") + 1).otherwise(0)).over(past(session, "turn").rowsBetween(Window.unboundedPreceding, -1))
    kept = said.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("opens") | (F.col("before") < limit))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct(F.col(order), "t")))), lambda x: x["t"])
    grouped = kept.groupBy(session, "turn").agg(F.max(F.when(F.col("opens"), F.col("t"))).alias("user"), F.array_join(pieces, " ").alias("joined"))
    assistant = F.when(F.length("joined") > limit, F.substring("joined", 1, limit)).otherwise(T.strip("joined"))
    return grouped.select(session, (F.col("turn") - 1).cast("int").alias("exchange_index"), exchange_text(F.col("user"), assistant, limit).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """file and text: all summaries of a session in order, under one heading."""
    v = F.col("v")
    kind, inner = _kind(v), _kind(v, "$.payload.type")
    payload, nested = _object(v, "$.payload"), _object(v, "$.message")
    is_digest = kind.isin(*DIGEST_TYPES)
    own = F.when(payload & (is_digest | inner.isin(*DIGEST_TYPES)), F.coalesce(content_text(v, "$.payload.summary"), content_text(v, "$.payload.content")))
    # a row whose payload gave a summary gives nothing else
    rest = F.array(
        F.when(is_digest & nested, content_text(v, "$.message.content")), F.when(is_digest, _filled(_text(v, "$.summary"))), F.when((kind == "turn_context") & payload, _filled(_text(v, "$.payload.summary"))),
        F.when((kind == "user") & nested, F.coalesce(_filled(_text(v, "$.message.content")), _filled(F.element_at(F.filter(F.transform(F.try_variant_get(v, "$.message.content", "array<variant>"), lambda b: F.when(_kind(b) == "text", _text(b, "$.text"))), lambda t: t.isNotNull()), 1)))),
    )
    first_three = F.slice(rest, 1, 3)
    resumed = F.filter(F.slice(rest, 4, 1), lambda t: F.startswith(t, F.lit(RESUMED)))
    found = F.when(own.isNotNull(), F.array(own)).otherwise(F.filter(F.concat(first_three, resumed), lambda t: t.isNotNull()))
    rows = lines.select("file", "line_no", F.posexplode(found).alias("k", "t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "k", "t"))), lambda x: x["t"])
    return rows.groupBy("file").agg(F.concat(F.lit("## Compaction Summaries\n\n"), F.array_join(parts, "\n\n")).alias("text"))


def epoch_to_iso(value: Column | str) -> Column:
    """Seconds, or milliseconds from 1e12 on, since the epoch as ISO text; null beyond the years 1 to 9999."""
    x = T._c(value).cast("double")
    s = F.when(F.abs(x) >= 1e12, x / 1000).otherwise(x)
    inside = (s >= -62135596800.0) & (s < 253402300800.0)
    micros = F.when(inside, F.round(s * 1000000)).cast("long")
    base = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1000000))
    return F.concat(base, F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def iso_to_timestamp(value: Column | str) -> Column:
    """ISO text as a timestamp; a time without zone is UTC, bad text is null."""
    return F.try_to_timestamp(T._c(value))


def session_values(lines: DataFrame) -> DataFrame:
    """file, session_id, created_at, model, n_lines: the first value of each kind in line order."""
    v = F.col("v")
    get = lambda keys, at: [_filled(_text(v, f"$.{at}{k}")) for k in keys]
    number = lambda p: epoch_to_iso(F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, p, "double")))
    ids = F.coalesce(*get(("session_id", "conversation_id", "id"), "payload."), *get(("session_id", "conversation_id", "id"), ""))
    when = F.coalesce(*get(("created_at", "timestamp", "created"), "payload."), number("$.payload.timestamp"), *get(("created_at", "timestamp", "created"), ""), number("$.timestamp"))
    model = F.coalesce(_filled(_text(v, "$.payload.model")), F.when(_kind(v) == "system", F.coalesce(_filled(_text(v, "$.message.model")), _filled(_text(v, "$.model")))))
    rows = lines.select("file", "line_no", ids.alias("i"), when.alias("w"), model.alias("m"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    stem = F.concat(F.lit("session:"), F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))
    return rows.groupBy("file").agg(first("i").alias("i"), first("w").alias("created_at"), first("m").alias("model"), F.count("*").cast("int").alias("n_lines")).select("file", F.coalesce("i", stem).alias("session_id"), "created_at", "model", "n_lines")


def session_records(spark: SparkSession, path: str | list[str], project: str, source_tool: str = "", privacy_scope: str = "local_only", run: Scratch | None = None) -> DataFrame:
    """Ingestion records of all sessions below a path (or of a list of files): one for each exchange, and one digest.

    Parsed lines are written once, to the tables of `run`.
    """
    lines = (run or Scratch(spark)).keep(read_lines(spark, path), "lines")
    turns = exchanges(messages(lines)).withColumn("is_compaction", F.lit(False))
    n = turns.groupBy(F.col("file").alias("n_file")).agg(F.count("*").cast("int").alias("n"))
    summary = digests(lines)
    summary = summary.join(n, F.col("file") == F.col("n_file"), "left").select("file", F.coalesce("n", F.lit(0)).alias("exchange_index"), "text", F.lit(True).alias("is_compaction"))
    times = lines.groupBy(F.col("file").alias("t_file")).agg(F.max("modified").alias("modified"))
    values = session_values(lines).withColumnRenamed("file", "v_file")
    rows = turns.unionByName(summary).join(times, F.col("file") == F.col("t_file")).join(values, F.col("file") == F.col("v_file"))
    return rows.select(
        F.lit(project).alias("project"), F.lit("agent_session").alias("source_type"), F.col("file").alias("source_path"), F.lit(source_tool).alias("source_tool"), "text", "session_id", F.coalesce("created_at", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("created_at"),
        F.col("modified").alias("last_modified"), F.lit(privacy_scope).alias("privacy_scope"), "exchange_index", F.col("n_lines").alias("session_line_count"), "is_compaction",
    )
