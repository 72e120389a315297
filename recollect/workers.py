"""Makes this package importable in Python workers, wherever the driver found it, and bounds what they hold."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes and rows of Arrow data that a worker turns into objects or arrays at once (one row at least).
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that a worker's memory follows from a part and not from the rows that Spark sends at once."""
    rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def ship(source: SparkSession | DataFrame) -> None:
    """Give the package's source to the workers of this application, once; Spark hands it out to executors."""
    spark = source.sparkSession if isinstance(source, DataFrame) else source
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="recollect-"), "recollect.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("recollect", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
