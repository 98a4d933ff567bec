"""Repeated strings: hash grouping at the samples of a difference cover (no suffix is sorted).

A byte is removed when it lies in a ``LENGTH``-byte string that also starts
anywhere else in the corpus.  Two equal strings at p and q share a cover
sample: with a difference cover D modulo ``PERIOD``, there is a shift d below
PERIOD for which p + d and q + d are both sample positions (D modulo PERIOD,
counted from the document's start).  So only one position in eleven is a sample.

1. Documents are packed into chunks of about ``CHUNK`` bytes, written once.
2. Samples are grouped: by the hash of the class of the LENGTH - PERIOD + 1 bytes that follow
   (which any two strings that meet in this sample share) and, within a class, by
   the whole context that such strings can touch.  Samples are dealt to buckets
   by class, and tasks sort one bucket at a time.  Ties in the whole context,
   however long the repeat goes on, are settled here: the strings around all
   tied samples are repeated.  They are the bulk, and take no more sorting.
3. What is left are strings whose sample shares a class with other contexts:
   ends of repeats.  They are grouped bucket by bucket by the hash of all LENGTH bytes, with
   one representative of each tied context.

Chunks hand equal samples and equal strings on once, so a passage that a third
of all documents share is one entry per chunk, whatever stands around it; that a
chunk holds a string several times is settled in the chunk.  Bucket counts follow the corpus's bytes, so a
bucket's size does not.  Strings, and the contexts within a class, are compared
by 64-bit hashes.

Defined cases: null and empty texts have 0 bytes and the hash of nothing; texts
shorter than LENGTH lose nothing; equal rows are different places, so equal
texts of LENGTH bytes or more go whole; a null ``doc_id`` stays null; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, materialize
from . import words as W
from .common import slices, table, utf8_column

#: Bytes of a repeated string (fixed by the contract).
LENGTH = 200
#: A perfect difference set: every shift below PERIOD but 0 is one difference of two members; fixed values.
PERIOD = 133
COVER = [1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121]
#: Bytes of a chunk of documents.
CHUNK = 2 << 20
#: Samples or strings that a bucket holds on average.
BUCKET = 1 << 20

_SHARED = LENGTH - PERIOD + 1
_NO_ANSWER = 0xFFFFFFFF


def _packed(rows: list[pa.RecordBatch]) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, bytes, offsets) of some batches."""
    parts = [utf8_column(r.column("text")) for r in rows]
    sizes = np.concatenate([np.diff(offs) for _, offs in parts])
    return [d for r in rows for d in r.column("doc_id").to_pylist()], np.concatenate([b for b, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, doc_ids, ends and the compressed bytes of consecutive documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        number, held, length = 0, [], 0

        def parcel() -> pa.RecordBatch:
            ids, buf, offs = _packed(held)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([offs[1:]], pa.list_(pa.int64())),
                                               pa.array([pack.compress(buf.tobytes())], pa.binary())], ["chunk", "doc_ids", "ends", "bytes"])

        for batch in batches:
            for rows in slices(batch, "text", size // 8):
                held.append(rows)
                length += len(utf8_column(rows.column("text"))[0])
                if length >= size:
                    yield parcel()
                    number, held, length = number + 1, [], 0
        if held:
            yield parcel()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "chunk bigint, doc_ids array<bigint>, ends array<bigint>, bytes binary")


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    ends = batch.column("ends")[row].values.to_numpy()
    offs = np.concatenate([[0], ends]).astype(np.int64)
    if not offs[-1]:
        return np.empty(0, np.uint8), offs
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("bytes")[row].as_py()), np.uint8), offs


class Samples:
    """The cover samples of a chunk, and its distinct (class, context) entries by bucket."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, buckets: int):
        n = np.diff(offs)
        long = np.flatnonzero(n >= LENGTH)
        periods = (n[long] - _SHARED) // PERIOD + 1
        doc = np.repeat(long, periods * len(COVER))
        first = np.repeat(np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods), len(COVER)) * PERIOD
        at = first + np.tile(np.array(COVER), int(periods.sum()))
        fits = at <= n[doc] - _SHARED
        doc, at = doc[fits], at[fits]
        self.start = offs[doc] + at
        #: Strings around the sample: first and last start.
        self.low = np.maximum(self.start - PERIOD + 1, offs[doc])
        self.high = np.minimum(self.start, offs[doc + 1] - LENGTH)
        right = np.minimum(self.start + LENGTH, offs[doc + 1])
        kind = W.hashes(buf, self.start, self.start + _SHARED, lower=False)
        context = W.hashes(buf, self.low, right, lower=False) + (self.start - self.low).astype(np.uint64)
        self.bucket = (kind % np.uint64(buckets)).astype(np.int64)
        kind, context = (kind >> np.uint64(32)).astype(np.uint32), W.mix(context)
        order = np.lexsort((context, kind, self.bucket))
        same = np.zeros(len(order), bool)
        b, k, c = self.bucket[order], kind[order], context[order]
        same[1:] = (b[1:] == b[:-1]) & (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        #: Entry of each sample; first sample of each entry; whether the chunk has several.
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(~same) - 1
        heads = np.flatnonzero(~same)
        self.kind, self.context, self.of_bucket = k[heads], c[heads], b[heads]
        self.several = np.diff(np.append(heads, len(order))) > 1
        self.one = order[heads]


_ENTRIES = "bucket bigint, chunk bigint, kinds binary, contexts binary, several binary"


def sample_entries(packed: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk in enumerate(batch.column("chunk").to_pylist()):
                s = Samples(*_unpacked(batch, row), buckets)
                own = np.unique(s.of_bucket)
                cuts = [slice(a, b) for a, b in zip(np.searchsorted(s.of_bucket, own), np.searchsorted(s.of_bucket, own, "right"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(np.full(len(own), chunk), pa.int64()), pa.array([s.kind[c].tobytes() for c in cuts], pa.binary()),
                     pa.array([s.context[c].tobytes() for c in cuts], pa.binary()), pa.array([np.packbits(s.several[c]).tobytes() for c in cuts], pa.binary())],
                    [c.split()[0] for c in _ENTRIES.split(", ")])

    return packed.mapInArrow(run, _ENTRIES)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other; the input is sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def rank_samples(entries: DataFrame) -> DataFrame:
    """For each chunk and bucket: which entries are tied with another, and which stand for a context of a mixed class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            sizes = [len(r["kinds"]) // 4 for r in rows]
            kind = np.frombuffer(b"".join(r["kinds"] for r in rows), np.uint32)
            context = np.frombuffer(b"".join(r["contexts"] for r in rows), np.uint64)
            several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n) for r, n in zip(rows, sizes)]).astype(bool)
            order = np.lexsort((context, kind))  # stable: entries of a context keep the order of their chunks
            k, c = kind[order], context[order]
            new_kind = np.r_[True, k[1:] != k[:-1]]
            new = new_kind | np.r_[True, c[1:] != c[:-1]]
            group, kinds = np.cumsum(new) - 1, np.cumsum(new_kind) - 1
            tied = (np.bincount(group) > 1) | (np.bincount(group, weights=several[order]) > 0)
            mixed = np.bincount(kinds[new]) > 1
            out = np.zeros((2, len(order)), bool)
            out[0, order], out[1, order] = tied[group], new & mixed[kinds]
            for r, end, n in zip(rows, np.cumsum(sizes), sizes):
                part = out[:, end - n: end]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([r["bucket"]], pa.int64()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["chunk", "bucket", "marks"])

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "chunk bigint, bucket bigint, marks binary")


def _spread(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """True from each low to its high, both included."""
    edge = np.bincount(low, minlength=n + 1).astype(np.int32)
    edge[: n + 1] -= np.bincount(high + 1, minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(edge)[:n] > 0


def _result(buf: np.ndarray, starts: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """(bytes, removed, spans, hash of the rest, the rest) of a document whose strings at ``starts`` are repeated."""
    gone = _spread(starts, starts + LENGTH - 1, len(buf)) if len(starts) else np.zeros(len(buf), bool)
    rest = buf[~gone].tobytes()
    spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(buf), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest


class Judged:
    """A chunk with its samples' marks: what is known to be repeated, and which strings are still to be sorted."""

    def __init__(self, batch: pa.RecordBatch, row: int, buckets: int):
        self.buf, self.offs = _unpacked(batch, row)
        s = Samples(self.buf, self.offs, buckets)
        tied, stands = np.zeros((2, len(s.kind)), bool)
        for mark in batch.column("found")[row].as_py() or ():
            part = slice(*np.searchsorted(s.of_bucket, [mark["bucket"], mark["bucket"] + 1]))
            n = part.stop - part.start
            tied[part], stands[part] = np.unpackbits(np.frombuffer(mark["marks"], np.uint8), count=2 * n).reshape(2, n).astype(bool)
        known, one = tied[s.entry], s.one[stands]
        #: By start of a string.
        self.repeated = _spread(s.low[known], s.high[known], len(self.buf))
        self.open = _spread(s.low[one], s.high[one], len(self.buf))


_STRINGS = "bucket bigint, chunk bigint, hashes binary, starts binary"


def open_strings(marked: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket: hashes of the distinct strings to sort, and their starts if they need an answer."""
    names = [c.split()[0] for c in _STRINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk in enumerate(batch.column("chunk").to_pylist()):
                judged = Judged(batch, row, buckets)
                start = np.flatnonzero(judged.open)
                h = W.hashes(judged.buf, start, start + LENGTH, lower=False)
                asked = ~judged.repeated[start]
                # One entry a distinct string: those that the chunk holds several times are answered here.
                h, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                several = count > 1
                here = start[asked & several[inverse]].astype(np.uint32)
                start = np.where(several | ~asked[first], _NO_ANSWER, start[first]).astype(np.uint32)
                to = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                h, start, to = h[order], start[order], to[order]
                own = np.unique(to)
                cuts = [slice(x, y) for x, y in zip(np.searchsorted(to, own), np.searchsorted(to, own, "right"))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(len(own), chunk), pa.int64()), pa.array([h[c].tobytes() for c in cuts], pa.binary()),
                                                  pa.array([start[c].tobytes() for c in cuts], pa.binary())], names)
                if len(here):  # no hashes: nothing to compare
                    yield pa.RecordBatch.from_arrays([pa.array([chunk % buckets], pa.int64()), pa.array([chunk], pa.int64()), pa.array([b""], pa.binary()), pa.array([here.tobytes()], pa.binary())], names)

    return marked.mapInArrow(run, _STRINGS)


def sort_strings(strings: DataFrame) -> DataFrame:
    """(chunk, starts): the asked strings that another one equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            for r in rows:
                if not r["hashes"]:
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([r["starts"]], pa.binary())], ["chunk", "more"])
            rows = [r for r in rows if r["hashes"]]
            sizes = np.array([len(r["hashes"]) // 8 for r in rows], np.int64)
            h = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
            start = np.frombuffer(b"".join(r["starts"] for r in rows), np.uint32)
            order = np.argsort(h, kind="stable")
            x = h[order]
            equal = np.zeros(len(x), bool)
            equal[1:] = x[1:] == x[:-1]
            equal[:-1] |= x[1:] == x[:-1]
            hit = np.zeros(len(x), bool)
            hit[order] = equal
            hit &= start != _NO_ANSWER
            for r, end, n in zip(rows, np.cumsum(sizes), sizes):
                if hit[end - n: end].any():
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([start[end - n: end][hit[end - n: end]].tobytes()], pa.binary())], ["chunk", "more"])

    dealt = strings.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "chunk bigint, more binary")


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def settle(marked: DataFrame, buckets: int, with_bytes: bool) -> DataFrame:
    """The documents of the chunks without what is repeated."""
    schema = _OUT + ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                judged = Judged(batch, row, buckets)
                for more in batch.column("answers")[row].as_py() or ():
                    judged.repeated[np.frombuffer(more, np.uint32)] = True
                starts, offs = np.flatnonzero(judged.repeated), judged.offs
                cuts = np.searchsorted(starts, offs)
                rows = [(doc_id, *_result(judged.buf[a:b], starts[x:y] - a)[: 5 if with_bytes else 4])
                        for doc_id, a, b, x, y in zip(batch.column("doc_ids")[row].as_py(), offs, offs[1:], cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string(), pa.binary()][: 1 + with_bytes])], [c.split()[0] for c in schema.split(", ")])

    return marked.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, with_bytes: bool = True, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total * len(COVER) / PERIOD / bucket))
    packed = materialize(chunks(docs, chunk), "chunks")
    marks = materialize(rank_samples(sample_entries(packed, buckets)), "sample_ranks")
    drop(spark)
    marked = packed.join(marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "marks")).alias("found")), "chunk", "left")
    answers = materialize(sort_strings(open_strings(marked, buckets)), "string_ranks")
    drop(spark)
    return settle(marked.join(answers.groupBy("chunk").agg(F.collect_list("more").alias("answers")), "chunk", "left"), buckets, with_bytes)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
