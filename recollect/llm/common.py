"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.workers import ship

#: The six characters that separate words, as the contracts define them.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of Arrow data that become Python objects at once (one row at least).
SLICE = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent and all executors are threads of this process (tests on one
    machine), a folder of this process takes its place and the setting is filled in; on a cluster
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="recollect-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return it as read from there.

    This cuts lineage in a way that survives the loss of executors: the table is in
    shared storage, so no later stage depends on an executor's local files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollect/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._recollect_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by stored(), once nothing reads it any more."""
    path = getattr(df, "_recollect_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators have left in the shared folder; results that read them are lost."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/recollect")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch, in slices of some `SLICE` bytes; no shuffle, memory bounded by one slice's objects."""

    ship(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have yet (compared without case)."""
    names = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in names:
        n += 1
        name = f"{base}_{n}"
    return name


class WordBytes(dict):
    """Word -> fixed bytes, computed on first sight, bounded.

    Beyond `limit` words a new generation begins; the last one is kept, and what is still used
    moves over, so frequent words are not computed again.
    """

    def __init__(self, make: Callable[[bytes], bytes], limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        out = self.before.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out


_held: dict[str, object] = {}


def worker_state(name: str, make: Callable[[], object]):
    """What this worker process keeps under `name` for all its tasks; what it kept under another name goes.

    A worker outlives stages and operators, so otherwise their caches would add up.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def word_hashes() -> WordBytes:
    """A cache of 64-bit word hashes as bytes; joined and read by numpy they give an array at once."""
    return worker_state("word_hashes", lambda: WordBytes(xxhash.xxh64_digest, 120_000))
