"""SimHash near-dedup by meet-in-the-middle ball hashing.

1. A document's fingerprint: the XXH64 (seed 42) of every three-word shingle,
   repeats included, votes on 64 bits.  Equal fingerprints are one *class*,
   represented by its smallest doc_id; a group of copies, however large, is one
   row from here on.
2. Two fingerprints within the radius have a point between them that is within
   half the radius of the one and the other half of the other.  So every class
   emits all fingerprints (variants) within half the radius of its own: 65 for
   radius 2.  Rows are shuffled on the variants.
3. Fingerprints that emitted the same variant are within the radius of each
   other, so a variant's bucket is a clique.  The smallest fingerprint of the
   bucket stands for it and is linked with the others: as many links as rows,
   never all pairs.  (An odd radius takes the larger half for one end: then the
   smallest fingerprint among those within the smaller half is the hub.)
   A bucket holds at most as many rows as there are variants, whatever the data.
4. Equal links become one, and each is verified by the bits that differ.
   Components of the links give the groups.

Nothing is sampled, capped or approximated: the links found connect exactly
those fingerprints that all links connect.

Defined cases: null, empty and white-space texts have fingerprint zero, which
is linked like any other.  A text of fewer than three words is one shingle.
Every row is judged by its own text: rows with equal doc_id and different texts
may lie in different components.  A null doc_id is no smallest doc_id; a
component without any other has component_id null.  Other columns, whatever
their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .common import free_names, join_groups, slices, table, utf8_column
from .components import components

WORDS = 3
RADIUS = 2
SEED = 42
#: Shingles of more bytes are hashed one by one.
LONG = 256

# Fixed values of XXH64.
PRIME_1 = 11400714785074694791
PRIME_2 = 14029467366897019727
PRIME_3 = 1609587929392839161
PRIME_4 = 9650029242287828579
PRIME_5 = 2870177450012600261
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (PRIME_1, PRIME_2, PRIME_3, PRIME_4, PRIME_5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _fixed_length(buf: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the ``n`` bytes from each position ``at``."""
    def load(offset: int, dtype: str) -> np.ndarray:
        size = np.dtype(dtype).itemsize  # one number from every byte position on
        return np.ndarray(len(buf) - size + 1, dtype, buf, 0, (1,))[at + offset].astype(np.uint64)

    def word(x: np.ndarray) -> np.ndarray:
        return _turn(x * _P2, 31) * _P1

    mod = (1 << 64) - 1
    done = n // 32 * 32
    if done:
        lanes = [np.full(len(at), v & mod, np.uint64) for v in (seed + PRIME_1 + PRIME_2, seed + PRIME_2, seed, seed - PRIME_1)]
        for stripe in range(0, done, 32):
            lanes = [_turn(v + load(stripe + 8 * i, "<u8") * _P2, 31) * _P1 for i, v in enumerate(lanes)]
        h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for v in lanes:
            h = (h ^ word(v)) * _P1 + _P4
    else:
        h = np.full(len(at), (seed + PRIME_5) & mod, np.uint64)
    h = h + np.uint64(n)
    while done + 8 <= n:
        h, done = _turn(h ^ word(load(done, "<u8")), 27) * _P1 + _P4, done + 8
    if done + 4 <= n:
        h, done = _turn(h ^ (load(done, "<u4") * _P1), 23) * _P2 + _P3, done + 4
    while done < n:
        h, done = _turn(h ^ (load(done, "u1") * _P5), 11) * _P1, done + 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the spans of ``buf``; spans of one length are hashed together."""
    out, n = np.empty(len(start), np.uint64), end - start
    order = np.argsort(n, kind="stable")
    cut = np.flatnonzero(np.diff(n[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        rows = order[a:b]
        if (size := int(n[rows[0]])) <= LONG:
            out[rows] = _fixed_length(buf, start[rows], size, seed)
        else:
            out[rows] = [xxhash.xxh64_intdigest(buf[start[r]: end[r]].tobytes(), seed) for r in rows.tolist()]
    return out


def shingle_spans(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, lower-cased and space-joined; start, end and document of each shingle)."""
    start, end, doc = W.spans(buf, offs, W.NOT_SPACE)
    size = end - start
    inside = W.NOT_SPACE[buf]
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    letters = buf[inside]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters)
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    first = np.cumsum(size + 1) - size - 1
    count = np.bincount(doc, minlength=len(offs) - 1)
    width = np.minimum(np.maximum(count, 1), words)[doc]
    at = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    head = np.flatnonzero(at + width <= count[doc])
    last = head + width[head] - 1
    return joined, first[head], first[last] + size[last], doc[head]


def majority(h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Per document the 64 bits set in more than half of its hashes (ordered by document)."""
    out = np.zeros(rows, np.uint64)
    if not len(h):
        return out
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    n = np.diff(np.append(new, len(h)))
    # Each byte of a sum counts one bit; pieces of at most 255 hashes cannot overflow it.
    pieces = -(-n // 255)
    base = np.cumsum(pieces) - pieces
    cut = np.repeat(new, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(base, pieces))
    ones = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((h >> np.uint64(shift)) & ones, cut).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), base, axis=0)
        for byte in range(8):
            out[doc[new]] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = utf8_column(part.column("text"))
                joined, start, end, doc = shingle_spans(buf, offs, words)
                fp = majority(xxh64(joined, start, end, seed), doc, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def flip_masks(most: int) -> list[int]:
    """All 64-bit numbers (signed) with at most so many bits set."""
    masks = [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all those within the radius."""
    half = radius // 2
    masks = F.explode(F.lit(flip_masks(radius - half)).cast("array<bigint>"))
    variants = prints.select("fp", masks.alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", (F.bit_count("mask") <= half).alias("near"))
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("variant"))
    colliding = variants.withColumn("hub", hub).filter(F.col("hub") != F.col("fp"))
    return colliding.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_near_dedup(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")), "classes")
    total = prints.count()
    links = materialize(ball_links(classes, radius), "links")
    found = components(links).select(F.col("id").alias("fp"), "component")

    # Only classes with copies or links differ from "on its own".
    placed = classes.join(found, "fp", "left").filter("size > 1 OR component IS NOT NULL")
    placed = materialize(placed.select("fp", "size", "first", F.coalesce("component", "fp").alias("component")), "placed")
    groups = materialize(placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")), "groups")
    labels = join_groups(placed, groups, ["component"], "members", total).select("fp", "size", "component_id")
    judged = join_groups(prints, materialize(labels, "labels"), ["fp"], "size", total)
    return judged.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_each(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The smallest doc_id's rows of each component, with all columns of ``docs``; rows of a null doc_id stay."""
    judged = materialize(simhash_near_dedup(docs, radius, words), "simhash")
    key, = free_names(docs, 1)
    gone = judged.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    gone = gone.join(judged.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[key], "left_anti")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
