"""Token counts by a separator scan of flat token files.

A token file is one long run of ids in which an end-of-document id follows each
document; nothing says where documents begin.  ``token_files`` writes such
files, one per input partition, as rows of fixed-size blocks; ``flat_blocks``
reads plain binary files into the same form, each in byte ranges of ``RANGE``
that any task may read, so a file's size does not matter.

The scan searches each block for the separator with numpy, whatever block it
is, and keeps only the positions.  A document may begin any number of blocks
before the one that ends it, so block summaries (last separator, number of
separators) are prefix-scanned: first over runs of ``RUN`` blocks, then inside
each run.  A block's first document begins after the last separator before it.

Defined cases: null and empty texts are documents of 0 tokens; a null
``doc_id`` stays null; what follows a file's last separator, if anything, is an
open document with ``closed`` false and no id; separators in a row are empty
documents; extra columns are not read; an empty table gives no rows.  A text
that spells the end-of-document token holds ordinary characters, not the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, strings, table
from .tokens import byte_bpe_path, encoder

#: Id that ends a document: the vocabulary's own end-of-text id, which no text yields.
END_ID = 50256
#: Ids of a block.
BLOCK = 1 << 16
#: Blocks of a run in the prefix scan.
RUN = 4096
#: Bytes of a plain file that one row of work reads.
RANGE = 64 << 20
#: Partitions that the ranges are dealt to at most; beyond, a task reads several.
TASKS = 1 << 16

_BLOCKS = "file string, block bigint, width int, ids binary, doc_ids array<bigint>"


def token_files(docs: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """The blocks of one token file per input partition, and the ids of the documents that end in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, number = encoder(path, special_as_text=True), f"part-{TaskContext.get().partitionId():06d}", 0
        end, size, pending, ended, at = np.array([end_id], encode.dtype).tobytes(), block * encode.dtype.itemsize, bytearray(), [], 0

        def parcel(ids: bytes, doc_ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([encode.dtype.itemsize], pa.int32()),
                                               pa.array([ids], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64()))], ["file", "block", "width", "ids", "doc_ids"])

        for batch in batches:
            for rows in slices(batch, "text"):
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), strings(rows.column("text"))):
                    pending += encode(text) + end
                    ended.append((at + len(pending), doc_id))
                    while len(pending) >= size:
                        here = [d for e, d in ended if e <= at + size]
                        yield parcel(bytes(pending[:size]), here)
                        del pending[:size]
                        ended, at, number = ended[len(here):], at + size, number + 1
        if pending:
            yield parcel(bytes(pending), [d for _, d in ended])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


def _open(path: str):
    """A seekable file: ``file:`` paths, and what pyarrow opens by address (HDFS, S3, GCS)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:"):].lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def flat_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK, size: int = RANGE, opener: Callable[[str], Any] = _open) -> DataFrame:
    """Blocks of plain binary files of little-endian ids.

    Spark lists the files (their content is not read for that) and deals out
    byte ranges of about ``size``, whole blocks each; a task seeks to its range
    and holds one block at a time.  The blocks of a file are numbered from its
    beginning, so the scan stitches ranges as it stitches blocks.  ``opener``
    opens other file systems.  A file that ends inside an id is an error.
    """
    step = block * width
    span = max(1, size // step) * step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, first in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "first"))):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are no whole number of ids of {width} bytes")
                with opener(file) as source:
                    source.seek(first)
                    for at in range(first, min(first + span, length), step):
                        ids = source.read(min(step, length - at))
                        if len(ids) < min(step, length - at):
                            raise ValueError(f"{file}: shorter than the {length} bytes listed")
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // step], pa.int64()), pa.array([width], pa.int32()), pa.array([ids], pa.binary()),
                                                          pa.array([[]], pa.list_(pa.int64()))], ["file", "block", "width", "ids", "doc_ids"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(span).cast("bigint"))).alias("first"))
    # A stated number of partitions, as the few bytes of a range's row would be merged into one task.
    return ranges.repartition(max(1, min(ranges.count(), TASKS))).mapInArrow(run, _BLOCKS)


def separators(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """file, block, n ids, positions of the separators in the block, doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for ids, width in zip(batch.column("ids"), batch.column("width").to_pylist()):
                x = np.frombuffer(ids.as_buffer(), f"<u{width}")
                n.append(len(x))
                found.append(np.flatnonzero(x == end_id))
            offsets = np.cumsum([0, *map(len, found)])
            positions = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), positions, batch.column("doc_ids")],
                                             ["file", "block", "n", "seps", "doc_ids"])

    return blocks.mapInArrow(run, "file string, block bigint, n bigint, seps array<bigint>, doc_ids array<bigint>")


def documents(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens, closed of every document, from the blocks' separators."""
    found = found.withColumns({"_run": F.floor(F.col("block") / RUN), "_last": F.when(F.size("seps") > 0, F.col("block") * block + F.element_at("seps", -1)), "_count": F.size("seps").cast("bigint")})
    runs = found.groupBy("file", "_run").agg(F.max("_last").alias("_last"), F.sum("_count").alias("_count"))
    earlier = Window.partitionBy("file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "_run", F.coalesce(F.max("_last").over(earlier), F.lit(-1)).alias("_last0"), F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count0"))
    inside = Window.partitionBy("file", "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"_last1": F.max("_last").over(inside), "_count1": F.coalesce(F.sum("_count").over(inside), F.lit(0))}).join(runs, ["file", "_run"])
    # Ends of documents: the separator before the block, then those in it.
    ends = F.concat(F.array(F.coalesce("_last1", "_last0")), F.transform("seps", lambda p: F.col("block") * block + p))
    closed = found.select("file", (F.col("_count0") + F.col("_count1")).alias("_first"), ends.alias("_ends"), "doc_ids", F.posexplode("seps").alias("_k", "_sep"))
    start = F.element_at("_ends", F.col("_k") + 1) + 1
    closed = closed.select(F.get("doc_ids", F.col("_k")).alias("doc_id"), "file", (F.col("_first") + F.col("_k")).alias("ordinal"), start.alias("start"),
                           (F.element_at("_ends", F.col("_k") + 2) - start).alias("n_tokens"), F.lit(True).alias("closed"))
    files = found.groupBy("file").agg(F.max(F.col("block") * block + F.col("n")).alias("_size"), F.coalesce(F.max("_last"), F.lit(-1)).alias("_last"), F.sum("_count").alias("_count"))
    tail = files.filter("_size > _last + 1").select(F.lit(None).cast("bigint").alias("doc_id"), "file", F.col("_count").alias("ordinal"), (F.col("_last") + 1).alias("start"),
                                                    (F.col("_size") - F.col("_last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def count_tokens(blocks: DataFrame, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    return documents(materialize(separators(blocks, end_id), "separators"), block)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, read back from the token files alone."""
    files = materialize(token_files(table(spark, sf_dir, "documents"), byte_bpe_path()), "token_files")
    return count_tokens(files)
