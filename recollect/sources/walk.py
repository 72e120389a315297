"""Listings of directory trees, pruned before descent, and reads of listed files, both in tasks.

A walk goes in rounds. The rows of a round are directories; a task lists its own and goes on into
those that it finds, up to a bound, and what is left becomes the next round, dealt out anew. So a
deep tree takes few rounds and a wide one all tasks. A directory that is excluded is never listed.

Tasks reach local (or mounted) paths and what pyarrow's file systems open. Paths of other
schemes are walked by the driver through Hadoop's client, also directory by directory, and read
by Spark's own reader.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.scratch import Scratch
from recollect.workers import ship

LISTING = "entry int, path string, modified timestamp, length long, problem string"
#: Directories that a task lists in a round; bytes of files that it holds at once; the longest file that is read.
PER_TASK, HELD, LONGEST = 2_000, 16 << 20, 1 << 30


@dataclass(frozen=True)
class Rules:
    """Directories to leave out, by name or by the start of it; which files are listed, by suffix, and names that are not."""

    excluded: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    names: tuple[str, ...] = ()

    def enters(self, name: str) -> bool:
        return name not in self.excluded and not name.startswith(self.prefixes or ("\0",))

    def lists(self, name: str) -> bool:
        return name not in self.names and (not self.suffixes or os.path.splitext(name)[1].lower() in self.suffixes)


def _scheme(path: str) -> str:
    m = re.match("([a-z][a-z0-9+.-]+):", path)
    return m[1] if m else "file"


def _local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def absolute(path: str) -> str:
    return "file:" + os.path.abspath(_local(path)) if _scheme(path) == "file" else path


def is_reachable(path: str) -> bool:
    """Whether tasks can open the path without Spark's readers."""
    if _scheme(path) == "file":
        return True
    try:
        from pyarrow import fs

        fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError, ImportError):
        return False
    return True


def _entries(path: str) -> list[tuple[str, str, bool, int, int]]:
    """name, path, whether a directory, length and time (ms) of what lies in a directory, or of the file itself. Linked directories are left out."""
    if _scheme(path) == "file":
        at = _local(path)
        if os.path.isfile(at):
            s = os.stat(at)
            return [(os.path.basename(at), "file:" + at, False, s.st_size, s.st_mtime_ns // 1_000_000)]
        out = []
        with os.scandir(at) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        out.append((e.name, "file:" + e.path, True, 0, 0))
                    elif e.is_file():
                        s = e.stat()
                        out.append((e.name, "file:" + e.path, False, s.st_size, s.st_mtime_ns // 1_000_000))
                except FileNotFoundError:  # gone meanwhile
                    continue
        return out
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    base = path[: len(path.rstrip("/")) - len(at.rstrip("/"))]
    info = system.get_file_info(at)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=False))
    return [(x.base_name, base + x.path, not x.is_file, x.size or 0, (x.mtime_ns or 0) // 1_000_000) for x in found]


def _visit(todo: list[tuple[int, str]], rules: dict[int, Rules], entries=_entries, most: int = PER_TASK) -> Iterator[tuple]:
    """Rows (entry, path, kind, time in ms, length, problem): files, directories left for the next round, and what could not be listed."""
    opened = 0
    while todo:
        entry, at = todo.pop()
        if opened >= most:
            yield entry, at, "dir", None, None, None
            continue
        opened += 1
        try:
            found = entries(at)
        except Exception as e:  # one directory's failure is its own
            yield entry, at, "problem", None, None, f"{type(e).__name__}: {e}"[:200]
            continue
        for name, path, is_dir, length, time in found:
            if is_dir:
                if rules[entry].enters(name):
                    todo.append((entry, path))
            elif rules[entry].lists(name):
                yield entry, path, "file", time, length, None


_ROUND = pa.schema([("entry", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("time", pa.int64()), ("length", pa.int64()), ("problem", pa.string())])
_ROUND_DDL = "entry int, path string, kind string, time long, length long, problem string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROUND, strict=True)], schema=_ROUND)


def listing(spark: SparkSession, roots: list[tuple[int, str]], rules: dict[int, Rules], run: Scratch) -> DataFrame:
    """LISTING rows of all files below the roots (a number and a path each); rules by number.

    problem is null for files; a row with a problem is a directory (or root) that could not be listed.
    """
    ship(spark)
    near = [(i, absolute(p)) for i, p in roots if is_reachable(p)]
    far = [(i, p) for i, p in roots if not is_reachable(p)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in _visit(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), rules):
                held.append(row)
                if len(held) >= 10_000:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    parts: list[DataFrame] = []
    frontier = spark.createDataFrame(near, "entry int, path string") if near else None
    tasks = spark.sparkContext.defaultParallelism
    while frontier is not None:
        done = run.keep(frontier.repartition(tasks).mapInArrow(step, _ROUND_DDL), "walk")
        parts.append(done.where("kind <> 'dir'"))
        left = done.where("kind = 'dir'").select("entry", "path")
        frontier = None if left.isEmpty() else left
    if far:
        parts.append(spark.createDataFrame(list(_visit(far, rules, _hadoop_entries(spark), 1 << 62)), _ROUND_DDL))
    out = spark.createDataFrame([], _ROUND_DDL)
    for part in parts:
        out = out.union(part)
    return out.select("entry", "path", F.timestamp_millis("time").alias("modified"), "length", "problem")


def _hadoop_entries(spark: SparkSession):
    def entries(path: str) -> list[tuple[str, str, bool, int, int]]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        return [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in found]

    return entries


def _opened(path: str) -> bytes:
    if _scheme(path) == "file":
        with open(_local(path), "rb") as f:
            return f.read()
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


def read_texts(listed: DataFrame) -> DataFrame:
    """Adds text and error to rows with path and length. Only these files are opened.

    Bytes that are no UTF-8 become the replacement sign. A file that cannot be read, or is longer
    than a row may be, has an error and no text; others are not affected.
    """
    ship(listed)
    schemes = [r[0] for r in listed.select(F.when(F.col("path").rlike("^[a-z][a-z0-9+.-]+:"), F.substring_index("path", ":", 1)).otherwise("file")).distinct().limit(50).collect()]
    unreachable = [s for s in schemes if not is_reachable(f"{s}://x/x")]
    if unreachable:  # Spark's reader takes the paths from the driver
        paths = [r["path"] for r in listed.select("path").distinct().collect()]
        raw = listed.sparkSession.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths) if paths else None
        if raw is None:
            return listed.withColumn("text", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
        own = raw.select(F.col("path").alias("r_path"), F.expr("decode(content, 'UTF-8')").alias("text"))
        both = listed.join(own, F.regexp_replace("path", "/+", "/") == F.regexp_replace("r_path", "/+", "/"), "left").drop("r_path")
        return both.withColumn("error", F.when(F.col("text").isNull(), F.lit("the file is gone")))
    columns, at, size = listed.columns, listed.columns.index("path"), listed.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, held, texts, errors = 0, 0, [], []

            def out(end: int) -> pa.RecordBatch:
                own = b.slice(start, end - start)
                return pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*columns, "text", "error"])

            for i, (path, length) in enumerate(zip(b.column(at).to_pylist(), b.column(size).to_pylist(), strict=True)):
                text = error = None
                try:
                    if (length or 0) > LONGEST:
                        raise ValueError(f"longer than {LONGEST} bytes")
                    text = _opened(path).decode("utf-8", "replace")
                except Exception as e:  # one file's failure is its own
                    error = f"{type(e).__name__}: {e}"[:200]
                texts.append(text)
                errors.append(error)
                held += len(text or "")
                if held > HELD:
                    yield out(i + 1)
                    start, held, texts, errors = i + 1, 0, [], []
            if texts:
                yield out(b.num_rows)

    # a task's share follows from what there is to read
    total = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(total["n"], listed.sparkSession.sparkContext.defaultParallelism), total["n"] // 5_000, total["bytes"] // (64 << 20))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields) + ", text string, error string"
    return listed.repartition(int(tasks)).mapInArrow(run, schema)

