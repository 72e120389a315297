"""Tables of one run in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset and all executors are threads of this process (tests on one machine), a
    folder of this process takes its place and the setting is filled in; on a cluster that is an error.
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


class Scratch:
    """What one run writes once and reads again; close() deletes it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/recollect/run-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, seen: Observation | None = None, **metrics) -> DataFrame:
        """Write a frame and return it as read from there; metrics are observed by the action that writes."""
        path = f"{self.at}/{name}-{uuid.uuid4().hex[:8]}"
        (df.observe(seen, *(c.alias(k) for k, c in metrics.items())) if seen else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
