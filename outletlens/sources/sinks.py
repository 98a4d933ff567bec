"""Sinks: snapshot writes that never overwrite what they read.

Token issuance/rotation and order messages are written as new snapshots.
``write_snapshot`` refuses a target that contains any file the DataFrame reads
(overwriting the input of a lazy plan would destroy it mid-job), then writes
and reads the snapshot back with its schema, so random values (``uuid()``) are
fixed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import drop, materialize


def _norm(p: str) -> str:
    for prefix in ("file://", "file:"):
        if p.startswith(prefix):
            p = p[len(prefix):]
    return p.rstrip("/")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   mode: str = "overwrite", audit: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Write ``df`` as parquet to ``path`` (a new snapshot) and return it re-read.

    With ``audit`` the rows are staged first, and ``path`` is written from the
    staged rows only if the audit raises nothing.
    """
    target = _norm(path)
    clash = [f for f in df.inputFiles() if _norm(f) == target or _norm(f).startswith(target + "/")]
    if clash:
        raise ValueError(f"refusing to overwrite {path}: the plan reads {clash[0]}")
    staged = None
    if audit is not None:
        staged = df = materialize(df, "staged")
        audit(staged)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    if staged is not None:
        drop(df.sparkSession, staged)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_order_messages(messages: DataFrame, path: str) -> DataFrame:
    """C20 sink: the bulk message table, one row per outlet order."""
    return write_snapshot(messages.select("outlet_id", "line_count", "needs_price_count", "total",
                                          "message", "message_url"), path)
