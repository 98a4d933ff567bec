"""Shared helpers of the text operators: table reads and Arrow column access."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on; memory per task is a small multiple of it.
BLOCK_BYTES = 1 << 21

#: Groups that are broadcast: one is heavy from 1 / HEAVY of all rows, so there are at most HEAVY.
HEAVY = 4096


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """Left join of rows with their groups, each of ``size`` rows out of ``total``.

    The at most ``heavy`` groups of ``total / heavy`` rows or more are
    broadcast, so their rows do not meet in one task; the others are shuffled.
    Rows with a null in ``on`` match nothing and skip the shuffle.
    """
    least = max(2, -(-total // heavy))
    key = F.lit(True)
    for c in on:
        key = key & F.col(c).isNotNull()
    first = rows.join(F.broadcast(groups.filter(F.col(size) >= least)), on, "left")
    done = F.col(size).isNotNull() | ~key
    added = [c for c in groups.columns if c not in on]
    rest = first.filter(~done).drop(*added).join(groups.filter(F.col(size) < least), on, "left")
    return first.filter(done).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have: longer than all of its own."""
    longest = max(map(len, df.columns), default=0)
    return ["_" * (longest + 1 + k) for k in range(n)]


class Shared:
    """A broadcast object whose class travels with it, so executors need no package."""

    def __init__(self, spark: SparkSession, value: Any):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self) -> Any:
        return pickle.loads(self._bytes.value)

    def forget(self) -> None:
        """Frees the executors' copies; a task that needs it again fetches it again."""
        self._bytes.unpersist()


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.  No copy unless nulls are present."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold at most ``limit`` bytes (or one row)."""
    _, offs = utf8_column(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


#: Rows of ``summed``: an array of numbers, cut into numbered chunks, from one part of the work.
PARCELS = "part int, chunk int, sums binary"


def parcels(part: int, chunks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(chunks), pa.int32()), pa.array(list(chunks), pa.int32()),
                                       pa.array([x.tobytes() for x in chunks.values()], pa.binary())], ["part", "chunk", "sums"])


def summed(rows: DataFrame, dtype: type, fan_in: int = 64) -> dict[int, np.ndarray]:
    """Sums of the parts' arrays by chunk.

    A task holds running sums only.  Each round sums up to ``fan_in`` parts of
    a chunk, so none reads what all tasks sent; the last one's result has the
    size of one array, whatever the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, chunk, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, key = np.frombuffer(x, dtype), (part // fan_in, chunk)
                sums[key] = sums[key] + x if key in sums else x
        for (part, chunk), x in sums.items():
            yield parcels(part, {chunk: x})

    for _ in range(2):
        rows = rows.repartition(F.col("chunk"), F.floor(F.col("part") / fan_in)).mapInArrow(run, PARCELS)
    out: dict[int, np.ndarray] = {}
    for row in rows.toLocalIterator():
        x = np.frombuffer(row["sums"], dtype)
        out[row["chunk"]] = out[row["chunk"]] + x if row["chunk"] in out else x
    return out
