"""Folders for intermediate tables and files: in the shared folder that the cluster names, deleted when the driver ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of its own. ``save`` writes a table there and reads it back, which cuts its lineage and survives executors.

    ``spark.checkpoint.dir`` names the shared folder. Without it a folder of this machine serves in local mode, and
    anywhere else an error says what is missing.
    """

    _open: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            root = tempfile.gettempdir()
        self.spark, self.path, self.count = spark, f"{root}/tideline-{name}-{uuid.uuid4().hex[:12]}", 0
        if not Workspace._open:
            atexit.register(Workspace._close_all)
        Workspace._open.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @classmethod
    def _close_all(cls) -> None:
        for w in cls._open:
            try:
                w.delete()
            except Exception:  # noqa: BLE001  the JVM may be gone already
                return
