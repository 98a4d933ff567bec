"""Packing: concatenate and cut.

Pass 1 tokenises every document once and writes, per input partition, the ids
with each document's offset inside its partition.  The partitions' token totals
(one number each) are summed up to global offsets.  Pass 2 reads the ids back
and cuts the endless stream at every multiple of the window: a piece is what
one document has in one window, and the pieces are the boundary records.  No
document is moved, so nothing is shuffled and a hot source is no matter.

Only the last window can be short: it is the only one with padding.  Documents
are cut freely, every id lies in exactly one piece.

Defined cases: a null or empty text is the end token alone; a null ``doc_id``
or a repeated row is packed like any other; extra columns are not read; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, strings, table
from .tokens import byte_bpe_path, encoder

#: Tokens of a sequence.
WINDOW = 2048
#: Id that ends each document (fixed by the contract).
END_ID = 1

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """part, part_offset, doc_id, n_tokens, width and ids of every document, end token included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encode_text.dtype).tobytes()
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = [encode_text(x) + end for x in strings(rows.column("text"))]
                n = np.array([len(x) // encode_text.dtype.itemsize for x in ids], np.int64)
                offsets = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part), pa.int32()), pa.array(offsets), rows.column("doc_id").cast(pa.int64()), pa.array(n),
                     pa.array(np.full(len(ids), encode_text.dtype.itemsize), pa.int32()), pa.array(ids, pa.binary())],
                    ["part", "part_offset", "doc_id", "n_tokens", "width", "ids"])

    schema = "part int, part_offset bigint, doc_id bigint, n_tokens bigint, width int, ids binary"
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """First global offset of each partition: prefix sums over one total per partition."""
    totals = sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    sums = np.cumsum([0, *(r["n"] for r in totals)])
    return {r["part"]: int(s) for r, s in zip(totals, sums)}


def cut(tokens: DataFrame, first: dict[int, int], window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The pieces of every document, with their ids (little-endian, 4 bytes each) if asked for."""
    schema = _PIECES + ", ids binary" * with_ids
    shared = tokens.sparkSession.sparkContext.broadcast(first)  # one number per input partition

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (rows for whole in batches for rows in slices(whole, "ids")):
            part, offset, n = (batch.column(c).to_numpy() for c in ("part", "part_offset", "n_tokens"))
            at = offset + np.array([shared.value[int(p)] for p in part], np.int64).reshape(len(part))
            count = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(at)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo = np.maximum(at[row], (at[row] // window + k) * window)
            hi = np.minimum(at[row] + n[row], (at[row] // window + k + 1) * window)
            ids, width = batch.column("ids"), batch.column("width")
            out = []
            for r, a, b in zip(row, lo - at[row], hi - at[row]):
                wide = np.frombuffer(ids[int(r)].as_buffer(), f"<u{width[int(r)].as_py()}")[a:b].astype("<u4")
                out.append(wide.tobytes())
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(lo - at[row]), pa.array(hi - lo), pa.array([zlib.crc32(x) for x in out], pa.int64()),
                       pa.array(n[row]), pa.array(lo // window), pa.array(lo % window)]
            if with_ids:
                columns.append(pa.array(out, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return tokens.mapInArrow(pieces, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Boundary records: one row per document and window that it touches."""
    tokens = materialize(token_table(docs, path, end_id), "tokens")
    return cut(tokens, part_offsets(tokens), window, with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe_path(), with_ids=False)
