"""Versioned tables: a version is staged, audited, and only then published.

``<path>/data/<n>`` holds the rows of version n, ``<path>/published/<n>`` is an
empty file that makes it visible.  A reader sees published versions only, so a
job that dies, or an audit that fails, leaves what was visible before as it is.
Nothing is renamed, so this also holds on object stores.  All paths go through
Spark's file systems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class AuditFailed(ValueError):
    """A staged version broke a rule; nothing was published."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, *parts):
        path = self._hadoop.Path("/".join([self.path, *map(str, parts)]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _data(self, number: int) -> str:
        return f"{self.path}/data/{number}"

    def published(self) -> list[int]:
        """Numbers of the visible versions, oldest first."""
        fs, path = self._at("published")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def latest(self) -> int | None:
        return max(self.published(), default=None)

    def read(self, *numbers: int) -> DataFrame:
        """The rows of these versions together."""
        return self.spark.read.parquet(*[self._data(n) for n in numbers])

    def publish(self, df: DataFrame, number: int, audit: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Write ``df`` as version ``number`` and make it visible if ``audit`` raises nothing.

        A number that is visible already is left as it is, so a retried job
        changes nothing; what an unpublished attempt left is overwritten.  The
        audit sees the rows as written, which are those readers would see.
        """
        if number not in self.published():
            df.write.mode("overwrite").parquet(self._data(number))
            if audit is not None:
                try:
                    audit(self.read(number))
                except Exception:
                    self._drop_data(number)
                    raise
            fs, marker = self._at("published", number)
            fs.create(marker, True).close()
        return self.read(number)

    def _drop_data(self, number: int) -> None:
        fs, path = self._at("data", number)
        fs.delete(path, True)

    def drop_before(self, number: int) -> None:
        """Delete versions older than ``number`` (readers of those are done)."""
        for old in self.published():
            if old < number:
                fs, marker = self._at("published", old)
                fs.delete(marker, False)
                self._drop_data(old)
