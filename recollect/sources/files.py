"""Text files: directory scans with exclusions, and bounded reads."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.scratch import Scratch
from recollect.sources import walk
from recollect.sources.walk import Rules

# Fixed values
PROJECT_EXTENSIONS = (".md", ".markdown", ".txt", ".py", ".toml", ".yaml", ".yml", ".json")
PROJECT_EXCLUDED = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".recollect")
DOC_EXTENSIONS = (".md", ".markdown", ".txt", ".py", ".toml", ".yaml", ".yml", ".json", ".rst", ".cfg", ".ini")
DOC_EXCLUDED = (
    ".agent", ".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".recollect", "node_modules", ".mypy_cache", ".tox", ".pytest-tmp", "pytest_tmp", ".task_work", ".task3_work",
    "site-packages", "dist-info", ".conda", "conda-meta", "dist", "build", ".eggs", ".ruff_cache", ".coverage",
)
DOC_EXCLUDED_PREFIXES = ("task_work_", "pytest-task", "pytest-cache-files-", "venv")
DOC_EXCLUDED_NAMES = (
    "tokenizer.json", "tokenizer_config.json", "vocab.json", "special_tokens_map.json", "generation_config.json", "merges.txt", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "composer.lock", "Pipfile.lock", "poetry.lock", "Gemfile.lock", "package.json",
)
MAX_READ_CHARS = 200_000


PROJECT = Rules(PROJECT_EXCLUDED, suffixes=PROJECT_EXTENSIONS)
DOCUMENTS = Rules(DOC_EXCLUDED, DOC_EXCLUDED_PREFIXES, DOC_EXTENSIONS, DOC_EXCLUDED_NAMES)
LOGS = Rules(suffixes=(".jsonl",))


def _texts(spark: SparkSession, root: str, rules: Rules) -> DataFrame:
    """path, modified, length, text of the files below a root that could be read."""
    run = Scratch(spark)
    listed = walk.listing(spark, [(0, root)], {0: rules}, run).where("problem is null")
    return walk.read_texts(listed.select("path", "modified", "length")).where("error is null").drop("error")


def scan_project(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path, modified, length (and text): files of known extensions outside the excluded directories, which are not entered."""
    if not content:
        return walk.listing(spark, [(0, root)], {0: PROJECT}, Scratch(spark)).where("problem is null").select("path", "modified", "length")
    return _texts(spark, root, PROJECT).select("path", "modified", "length", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads; a malformed one is not. A file system that fails is an error."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    except IllegalArgumentException as e:
        if "UnknownHostException" in str(e):
            raise OSError(f"{path}: {e}"[:200]) from e
        return False
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "UnsupportedFileSystemException":
            return False
        raise OSError(f"{path}: {e.java_exception.getMessage()}") from e


def is_dir(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def plain(path: Column | str) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(T._c(path), "^[a-z0-9]+:/+", "/")


def plain_text(path: str) -> str:
    return re.sub("^[a-z0-9]+:/+", "/", path)


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, content_hash, text of documents: by extension and name, mostly letters; excluded directories are not entered."""
    texts = _texts(spark, root, DOCUMENTS).where(T.passes_alpha_filter("text"))
    return texts.select("path", "modified", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text")


def as_records(rows: DataFrame) -> DataFrame:
    """RECORD rows (and error) of documents read: path, modified, text, error, project, source_tool, privacy_scope."""
    none = F.lit(None)
    return rows.select(
        "project", F.lit("project_docs").alias("source_type"), F.col("path").alias("source_path"), "source_tool", "text", none.cast("string").alias("session_id"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        F.col("modified").alias("last_modified"), "privacy_scope", none.cast("int").alias("exchange_index"), none.cast("int").alias("session_line_count"), F.lit(False).alias("is_compaction"), "error",
    )


def document_records(spark: SparkSession, root: str, project: str, source_tool: str = "", privacy_scope: str = "local_only") -> DataFrame:
    rows = scan_documents(spark, root).withColumns({"project": F.lit(project), "source_tool": F.lit(source_tool), "privacy_scope": F.lit(privacy_scope), "error": F.lit(None).cast("string")})
    return as_records(rows).drop("error")


def bounded(text: Column | str, limit: int = MAX_READ_CHARS) -> tuple[Column, Column]:
    """The first characters of a text, and whether there are more."""
    t = T._c(text)
    return F.substring(t, 1, limit), F.length(t) > limit
