"""Entities in free text: paths, project roots, documents and hosts, with provenance and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import ids
from recollect.functions import text as T

# Fixed patterns and word lists
WINDOWS_PATH = r"""[A-Za-z]:[\\/][^\s"'<>|*?]+"""
POSIX_PATH = r"""(?:^|\s)/(?:[^\s"'*?|]+/)+[^\s"'*?|]*"""
SSH_ALIAS = r"(?i)\bssh\s+(?:root@)?([\p{L}\p{N}_][\p{L}\p{N}_.-]*)\b"
SSH_ROOT = r"(?i)\bssh\s+root@(\S+)\b"
SSH_USER = r"(?i)\bssh\s+([\p{L}\p{N}_]+)@(\S+)\b"
#: Tried only where a run of such characters begins, as what a run's first try leaves holds no further match.
DOC_PATH = r"""(?i)(?<![^\s"'<>|])[^\s"'<>|]*\.(?:md|txt|json|ya?ml|toml)"""
DOC_EXTENSIONS = (".json", ".md", ".toml", ".txt", ".yaml", ".yml")
CANONICAL_DOCS = ("agents.md", "claude.md", "readme.md")
INDEX_DOCS = ("skill.md", "readme.md", "agents.md", "claude.md")
INTERNAL_FRAGMENTS = (".agent/", ".agents/skills/", ".claude/shell-snapshots/", ".codex/skills/", "/.agent/", "/.agents/skills/", "/.claude/shell-snapshots/", "/.codex/skills/")
EXCLUDED_SEGMENTS = (".agents", ".claude", ".codex", ".git", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "__pycache__", "node_modules", "site-packages", "venv")
WINDOWS_ANCHORS = ("projectpy", "software", "sofware", "documents", "documenti", "projects", "repos")
WINDOWS_STOPS = ("docs", "src", "tests", "memory", "diary")
NOT_PROJECTS = (".cursor", ".ssh", "appdata", "codex_tmp", "downloads", "system32", "tmp", "windows")
AGENT_SEGMENTS = (".agents", ".claude", ".codex")
SSH_NOISE = ("to", "the", "a", "an", "is", "it", "of", "in", "on", "at", "and", "or", "not", "no", "with", "for", "from", "by", "as", "be", "we", "key", "agent", "add", "config", "user", "root", "host", "server", "connection", "using", "via", "into", "references", "double-quoted", "read-only")
AGENT_PREAMBLES = ("<environment", "<system", "<developer", "<instructions", "<agent", "<turn_aborted")
MAX_MATCHES = 250


def agent_preamble(text: Column | str) -> Column:
    return T._c(text).rlike("^(" + "|".join(AGENT_PREAMBLES) + ")")


def _clean(path: Column) -> Column:
    """Without white space and brackets at both ends, nor punctuation at the end."""
    p = F.regexp_replace(T.strip(path), r"^[`\[\](){}<>]+|[`\[\](){}<>]+$", "")
    return F.regexp_replace(p, r"""[.,;:!?"']+$""", "")


def _found(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(T._c(text), F.lit(pattern), F.lit(group))


def paths(text: Column | str) -> Column:
    """Absolute paths in a text, Windows ones first, at most 250 in order."""
    win = F.filter(F.transform(_found(text, WINDOWS_PATH), _clean), lambda p: (F.length(p) >= 3) & p.rlike(r"[\\/]"))
    unix = F.filter(F.transform(_found(text, POSIX_PATH), _clean), lambda p: (F.length(p) >= 3) & F.contains(p, F.lit("/")))
    return F.slice(F.concat(win, unix), 1, MAX_MATCHES)


def doc_paths(text: Column | str) -> Column:
    """Document paths in a text: absolute, with a directory, or of a canonical name; at most 250 in order."""

    def fine(p: Column) -> Column:
        low = F.regexp_replace(F.lower(p), r"\\", "/")
        bad = F.startswith(low, F.lit("http://")) | F.startswith(low, F.lit("https://")) | p.rlike(r"[<>\[\](){}`]") | (p == "")
        for f in INTERNAL_FRAGMENTS:
            bad = bad | F.contains(low, F.lit(f))
        return ~bad & (F.contains(low, F.lit("/")) | low.isin(*CANONICAL_DOCS))

    return F.slice(F.filter(F.transform(_found(text, DOC_PATH), _clean), fine), 1, MAX_MATCHES)


def hosts(text: Column | str) -> Column:
    """Hosts that a text connects to: the first pattern's as often as found, others once."""

    def clean(a: Column) -> Column:
        plain = T.strip(F.replace(F.replace(a, F.lit("\\n"), F.lit("")), F.lit("\\r"), F.lit("")))
        return F.regexp_replace(plain, r"""^[`'".,;:!?()\[\]{}<>]+|[`'".,;:!?()\[\]{}<>]+$""", "")

    def fine(a: Column) -> Column:
        return (a != "") & ~F.lower(a).isin(*SSH_NOISE) & (a.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | a.rlike("[.-]"))

    first = F.filter(F.transform(_found(text, SSH_ALIAS, 1), clean), fine)
    rest = F.array_distinct(F.filter(F.transform(F.concat(_found(text, SSH_ROOT, 1), _found(text, SSH_USER, 2)), clean), fine))
    return F.concat(first, F.array_except(rest, first))


def looks_like_root(path: Column | str) -> Column:
    """Whether a path that need not exist has the depth of a project under a usual prefix."""
    p = T.strip(path)
    low = F.lower(F.regexp_replace(p, r"\\", "/"))
    parts = F.size(F.filter(F.split(low, "/"), lambda x: x != ""))
    depth = F.when(low.rlike("^[a-z]:/"), parts >= 3).when(low.rlike("^/(home|users)/"), parts >= 3).when(low.rlike("^/(opt|srv|workspace)/"), parts >= 2).when(low.rlike("^/var/www/"), parts >= 3).when(low.rlike("^/mnt/"), parts >= 4)
    return F.coalesce(~p.rlike(r"[{}<>\[\]`]") & ~p.rlike(r"[^./\\]\.[^./\\]+$") & depth, F.lit(False))


def project_root(path: Column | str) -> Column:
    """The project directory that a path lies in, or null."""
    p = _clean(T._c(path))
    norm = F.regexp_replace(p, r"\\", "/")
    parts = F.filter(F.split(norm, "/"), lambda x: x != "")
    low = F.transform(parts, F.lower)
    arr = lambda names: F.array(*(F.lit(n) for n in names))
    bad = (p == "") | p.rlike(r"[{}<>\[\]`]") | (F.size(F.regexp_extract_all(p, F.lit("[A-Za-z]:"), F.lit(0))) > 1) | F.coalesce(F.try_element_at(low, F.lit(1)).isin("a:", "b:"), F.lit(False)) | F.arrays_overlap(low, arr(AGENT_SEGMENTS)) | F.arrays_overlap(low, arr(NOT_PROJECTS))
    at = lambda test: F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(low), F.lit(1))), lambda i: F.when(test(i), i)), lambda i: i.isNotNull()))
    name = lambda i: F.try_element_at(low, i)
    cut = at(lambda i: name(i).isin(*EXCLUDED_SEGMENTS))
    n = F.coalesce(cut - 1, F.size(parts))
    anchor = at(lambda i: name(i).isin(*WINDOWS_ANCHORS) & (i + 1 <= n))
    stop = at(lambda i: name(i).isin(*WINDOWS_STOPS) & (i >= 2) & (i <= n))
    windows = lambda k: F.when(k == 1, F.concat(F.element_at(parts, 1), F.lit("\\"))).otherwise(F.concat_ws("\\", F.slice(parts, 1, k)))
    posix = lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))
    lower = F.lower(norm)
    drive = F.when(name(F.lit(1)).isin("c:", "d:"), F.when(anchor.isNotNull(), windows(anchor + 1)).when(stop.isNotNull(), windows(stop - 1)))
    deep = (
        F.when(lower.rlike("^/(home|users)/") & (n >= 3), posix(F.lit(3)))
        .when(lower.rlike("^/(opt|srv|workspace)/") & (n >= 2), posix(F.lit(2)))
        .when(lower.rlike("^/var/www/") & (n >= 3), posix(F.lit(3)))
        .when(lower.rlike("^/mnt/") & (n >= 4), posix(F.lit(4)))
        .when(looks_like_root(p), p)
    )
    return F.when(bad | (n < 1), F.lit(None).cast("string")).when(lower.rlike("^[a-z]:"), drive).otherwise(deep)


def document_project(path: Column | str) -> Column:
    """The parent directory's name of an index document, or null."""
    clean = F.regexp_replace(T.strip(path), r"\\", "/")
    parts = F.split(clean, "/")
    parent = F.try_element_at(parts, F.lit(-2))
    return F.when(F.lower(F.element_at(parts, -1)).isin(*INDEX_DOCS) & parent.isNotNull() & ~parent.isin("", ".", ".."), parent)


def merge_sources(found: DataFrame, value: str, label: str, position: str) -> DataFrame:
    """One row for each value without regard to case: its first spelling and its labels in order of first sight.

    Labels are made distinct before they are gathered, so a group holds at most as many as
    there are labels, however often a value was found.
    """
    key = F.lower(F.col(value))
    each = found.groupBy(key.alias("key"), F.col(label).alias("label")).agg(F.min(position).alias("at"), F.min_by(value, position).alias("name"))
    out = each.groupBy("key").agg(F.min_by("name", "at").alias(value), F.array_sort(F.collect_list(F.struct("at", "label"))).alias("l"))
    return out.select("key", value, F.transform("l", lambda x: x["label"]).alias("discovered_from"))


def split_sources(labels: Column | str) -> Column:
    return F.filter(F.transform(F.split(T._c(labels), ","), lambda x: F.trim(x)), lambda x: x != "")


def score_project(sources: Column | str, is_dir: Column) -> Column:
    return F.size(sources).cast("double") + is_dir.cast("int")


def score_document(path: Column | str, sources: Column | str, exists: Column) -> Column:
    absolute = F.regexp_replace(T.strip(path), r"\\", "/").rlike("^([a-zA-Z]:/|/)")
    canonical = F.lower(T.basename(path)).isin(*CANONICAL_DOCS)
    return F.size(sources).cast("double") + (exists & absolute).cast("int") + F.when(canonical, 0.5).otherwise(0.0)


def score_server(alias: Column | str, sources: Column | str) -> Column:
    a = T._c(alias)
    return F.size(sources).cast("double") + F.when(F.contains(a, F.lit(".")), 0.5).otherwise(0.0) + F.when(F.contains(a, F.lit("-")), 0.5).otherwise(0.0)


def report(texts: DataFrame, existing: DataFrame) -> DataFrame:
    """Scored projects, documents and servers from labelled texts (label, position, text). existing: path, is_dir."""
    base = texts.where(~agent_preamble("text"))
    place = lambda c: F.posexplode(c).alias("k", "v")
    at = F.struct("position", "k").alias("at")
    # each path is traced to its project once for a label, however often it was found
    found = base.select("label", "position", place(paths("text"))).groupBy("label", "v").agg(F.min(F.struct("position", "k")).alias("at"))
    roots = found.select("label", "at", project_root("v").alias("path")).where("path is not null")
    docs = base.select("label", "position", place(doc_paths("text"))).select("label", at, F.col("v").alias("path"))
    servers = base.select("label", "position", place(hosts("text"))).select("label", at, F.col("v").alias("path"))
    there = existing.select(F.col("path").alias("x_path"), "is_dir")

    def known(df: DataFrame) -> DataFrame:
        return df.join(there, F.col("path") == F.col("x_path"), "left")

    p = known(merge_sources(roots, "path", "label", "at")).select(F.lit("project_root").alias("section"), "path", "discovered_from", score_project("discovered_from", F.coalesce("is_dir", F.lit(False))).alias("confidence"))
    d = known(merge_sources(docs, "path", "label", "at")).select(F.lit("document").alias("section"), "path", "discovered_from", score_document("path", "discovered_from", F.col("x_path").isNotNull()).alias("confidence"))
    s = merge_sources(servers, "path", "label", "at").select(F.lit("server_alias").alias("section"), "path", "discovered_from", score_server("path", "discovered_from").alias("confidence"))
    return p.unionByName(d).unionByName(s)


def catalog_entries(scored: DataFrame, status: str = "pending") -> DataFrame:
    """Catalog rows for scored candidates."""
    clean = F.rtrim(F.regexp_replace(T.strip("path"), r"\\", "/"), F.lit("/"))
    name = F.when(F.col("section") == "project_root", F.element_at(F.split(clean, "/"), -1)).when(F.col("section") == "document", document_project("path"))
    return scored.select(
        ids.source_id(F.col("section"), F.col("path")).alias("id"), F.col("section").alias("source_type"), F.col("path").alias("path_or_alias"), F.when(name != "", name).alias("project_name"), "discovered_from", F.lit(status).alias("confirmation_status"),
        F.lit("local_only").alias("privacy_scope"), "confidence", F.size("discovered_from").alias("evidence_count"),
    )
