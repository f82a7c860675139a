"""Intermediate tables as Parquet folders in the folder that driver and executors share.

They cut lineage, so a lost executor costs the tasks of one stage only. They stay until the owner calls ``drop()`` or the driver
ends, because the frames that read them are lazy.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from .io import shared_folder

#: Makes Spark delete the shuffle files of a write when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_open: set[Scratch] = set()


class Scratch:
    """A folder of intermediate tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/veracity-{uuid.uuid4().hex}"
        # these outlive the session, so the folder can still be dropped after it has stopped
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._names: set[str] = set()
        _open.add(self)

    def names(self) -> set[str]:
        """The tables that are there."""
        return set(self._names)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads it. The shuffle files of the write go as soon as it has ended."""
        at = f"{self.path}/{name}"
        self._names.add(name)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str | None = None) -> None:
        """Deletes a table, or the whole folder."""
        path = self._fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self._conf).delete(path, True)
        if name:
            self._names.discard(name)
        else:
            self._names.clear()
            _open.discard(self)


@atexit.register
def _drop_all() -> None:
    for x in list(_open):
        try:
            x.drop()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass
