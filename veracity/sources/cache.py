"""The key-value cache of audits: a Parquet table with one live row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import upsert
from .io import CACHE, exists


class AuditCache:
    """Versions are folders; the newest complete one counts, so readers never see a half-written table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(conf)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(CACHE).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], CACHE)

    def put(self, changes: DataFrame) -> None:
        """Upserts (key, value, created_at); the latest row of a key wins."""
        found = self._versions()
        upsert(self.read(), changes.select("key", "value", F.col("created_at").cast("double")), "key", "created_at").write.mode("overwrite").parquet(f"{self.path}/v{(found[-1] if found else 0) + 1}")

    def get(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.read().select("key", "value"), "key", "left")
