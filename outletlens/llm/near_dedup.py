"""MinHash near-dedup by a Chosen Path set similarity join.

1. A document's set holds the hashes of its distinct two-word shingles.  Equal
   sets are one *class* with a number of its own; a group of copies, however
   large, is one row from here on.
2. Every class has ``POSITIONS`` minwise tokens.  In each of several independent
   trees, a node sends a class to one child, and with probability 1/t - 1 to a
   second one, for similarity threshold t.  The node picks a position, and the
   class's minwise token there names the child.  So a pair at the threshold
   keeps one common node in expectation at every level.  Depth grows with the
   logarithm of the number of classes, so that unlike documents part; the
   number of trees follows from depth and ``RECALL`` (the chance that a pair at
   the threshold meets in some node of the last level).
3. Nodes with one class are dropped.  In every other node the smallest class is
   compared with all others on full sets, and the links give first components.
   Nodes that lie within one component need no more comparisons.  In the rest,
   every class outside the node's largest component is compared with every
   class of the node that is not in its own component: by minwise tokens first
   (within ``SPREAD`` standard errors of the threshold, which a pair that belongs
   together misses once in a thousand million times), then on full sets.  The first
   rounds verify only the best partner of each class outside its component, one
   pair a class and block, which connects almost all; the last round verifies
   every pair that is left, inside the tasks, and returns no more links than
   connect the classes.  Large nodes are cut into a grid of blocks of at most
   about ``LEAF`` classes by ``LEAF``, so no task holds a node, none is capped,
   and no list of pairs is written.
4. Components of all verified links.  Only links inside an already connected
   component are left out, so components are those of all links found.

Every link is verified on full sets of 64-bit shingle hashes.

Defined cases: null and empty texts have no shingles and stand alone; a text of
one word has that word as its only shingle; rows with a null ``doc_id`` stand
alone (component null, kept); rows with equal doc_id and text are one vertex,
rows with equal doc_id and different texts are one each, judged by their own
text; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .common import free_names, join_groups, slices, table, utf8_column
from .components import components

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
WORDS = 2
POSITIONS = 128
#: Chance that a pair at the threshold meets in at least one node.
RECALL = 0.9999
#: Standard errors that minwise tokens may fall short of the threshold.
SPREAD = 6
#: Similarity of unlike documents that the depth is laid out for.
UNLIKE = 0.05
#: Classes on either side of one exhaustive comparison.
LEAF = 512
#: Rounds in which each class is compared with its likeliest partners only, before the exhaustive one.
BEST_ROUNDS = 2


def plan_trees(classes: int, percent: int = PERCENT) -> tuple[int, int]:
    """(depth, trees) for so many classes.

    All trees draw from the same positions, in which a pair at the threshold
    agrees more or less often by chance: the chance to miss it in every tree is
    taken over all numbers of agreeing positions.
    """
    t = percent / 100
    depth = max(2, math.ceil(math.log(max(classes, 2)) / math.log(1 / UNLIKE)))
    agree = np.arange(POSITIONS + 1)
    weigh = np.array([math.comb(POSITIONS, k) * t**k * (1 - t) ** (POSITIONS - k) for k in agree.tolist()])
    share, two = agree / POSITIONS, 1 / t - 1  # chance of a second child
    lost = np.zeros(POSITIONS + 1)  # chance that one tree has no common node
    for _ in range(depth):
        one = 1 - share + share * lost
        lost = (1 - two) * one + two * one * one
    trees = 1
    while (weigh * lost**trees).sum() > 1 - RECALL:
        trees += 1
    return depth, trees


def shingle_sets(rows: pa.RecordBatch, text: str, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, offsets by row)."""
    buf, offs = utf8_column(rows.column(text))
    start, end, doc = W.spans(buf, offs, W.NOT_SPACE)
    h = W.hashes(buf, start, end)
    count = np.bincount(doc, minlength=rows.num_rows)
    # A text of fewer than n words is one shingle: the shorter sequence.
    size = np.minimum(np.maximum(count, 1), n)
    shingle, row, at = [], [], np.arange(len(h)) - (np.cumsum(count) - count)[doc]
    for k in range(1, n + 1):
        first = np.flatnonzero((size[doc] == k) & (at + k <= count[doc]))
        s = W.mix(h[first] + np.uint64(k))
        for j in range(1, k):
            s = W.mix(s * np.uint64(0xFF51AFD7ED558CCD) + h[first + j])
        shingle.append(s)
        row.append(doc[first])
    s, r = np.concatenate(shingle), np.concatenate(row)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return s, np.searchsorted(r, np.arange(rows.num_rows + 1))


def minwise(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """rows x POSITIONS minwise tokens (32 bits) of non-empty sets."""
    out = np.empty((len(offs) - 1, POSITIONS), np.uint32)
    factors = W.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(POSITIONS):
        out[:, k] = np.minimum.reduceat((s * factors[k]) >> np.uint64(32), offs[:-1])
    return out


def path_keys(tokens: np.ndarray, depth: int, trees: int, two: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node key) of the last level's nodes of all trees."""
    rows, keys = [], []
    for tree in range(trees):
        row, key = np.arange(len(tokens)), np.full(len(tokens), W.mix(np.array([tree + 1], np.uint64))[0])
        for _ in range(depth):
            second = W.mix(key + np.uint64(1)) < np.uint64(int(two * 2.0**64))
            next_row, next_key = [], []
            for child, (r, k) in enumerate(((row, key), (row[second], key[second]))):
                position = W.mix(key[second] + np.uint64(3) if child else key + np.uint64(2)) % np.uint64(POSITIONS)
                position = position.astype(np.int64)
                next_row.append(r)
                next_key.append(W.mix(k * np.uint64(0xFF51AFD7ED558CCD) + W.mix(tokens[r, position].astype(np.uint64) * np.uint64(POSITIONS) + position.astype(np.uint64))))
            row, key = np.concatenate(next_row), np.concatenate(next_key)
        rows.append(row)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def _list_column(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), pa.array(values[order]))


def sketches(docs: DataFrame, depth: int, trees: int, percent: int, words: int) -> DataFrame:
    """doc_id, hash of the text, set size, 128-bit set hash, low bytes of the minwise tokens, node keys."""
    two = 100 / percent - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, offs = shingle_sets(part, "text", words)
                n = np.diff(offs)
                full = np.flatnonzero(n)
                bounds = np.append(offs[full], len(s))
                if len(full):
                    tokens = minwise(s, bounds)
                    f1, f2 = set_hashes(s, bounds)
                    row, key = path_keys(tokens, depth, trees, two)
                else:
                    tokens, f1, f2, row, key = np.empty((0, POSITIONS), np.uint32), *(np.empty(0, np.int64),) * 2, np.empty(0, np.int64), np.empty(0, np.uint64)
                every = part.num_rows
                place = np.full(every, -1)
                place[full] = np.arange(len(full))
                low = (tokens & np.uint32(255)).astype(np.uint8)
                g1, g2 = np.zeros((2, every), np.int64)
                g1[full], g2[full] = f1, f2
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(g1), pa.array(g2),
                     pa.array([low[p].tobytes() if p >= 0 else None for p in place], pa.binary()), _list_column(full[row], key.view(np.int64), every)],
                    ["doc_id", "text_hash", "n_shingles", "f1", "f2", "tokens", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, tokens binary, keys array<bigint>")


def set_hashes(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each non-empty set."""
    return tuple(np.add.reduceat(W.mix(x), bounds[:-1]).view(np.int64) for x in (s, s ^ np.uint64(0x5851F42D4C957F2D)))


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, set) of ``classes`` (id, doc_id, f1, f2), from a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, offs = shingle_sets(part, "text", words)
                f = np.zeros((2, part.num_rows), np.int64)
                if len(full := np.flatnonzero(np.diff(offs))):
                    f[:, full] = set_hashes(s, np.append(offs[full], len(s)))
                # Rows that share a doc_id with the class's document, and not its text, hold another set.
                same = (f[0] == part.column("f1").to_numpy()) & (f[1] == part.column("f2").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s[a:b].tobytes() for a, b in zip(offs, offs[1:])], pa.binary())], ["id", "set"]).filter(pa.array(same))

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(classes.select("id", "doc_id", "f1", "f2"), "doc_id")
    return wanted.select("id", "f1", "f2", "text").mapInArrow(run, "id bigint, set binary").dropDuplicates(["id"])


def _similar(x, y, percent: int) -> bool:
    """Whether two non-empty full sets are similar enough."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    same = int((q[at] == p).sum())
    return 100 * same >= percent * (len(p) + len(q) - same)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                ok[i] = _similar(x[i].as_buffer(), y[i].as_buffer(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _blocks(members: DataFrame, found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Comparisons left to make: node, i, j, side (0: to be compared, 1: with these), id, component, tokens.

    Nodes within one component have none.  In the others, block (i, j) holds the
    i-th part of the classes outside the node's largest component, and the j-th
    part of all its classes.
    """
    placed = members.join(found, "id", "left").select("node", "n", "id", F.coalesce("component", "id").alias("component"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("node", "component").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    parts = parts.groupBy("node").agg(F.max(F.struct("k", "component")).alias("main"), F.max("n").alias("n")).filter("main.k < n")
    parts = parts.select("node", F.col("main.component").alias("main"), F.ceil(F.col("n") / LEAF).cast("int").alias("blocks"),
                         F.ceil((F.col("n") - F.col("main.k")) / LEAF).cast("int").alias("odd_blocks"))
    open_ = placed.join(parts, "node").join(tokens, "id")
    draw = F.xxhash64("id")
    odd = open_.filter("component <> main").withColumn("i", F.pmod(draw, "odd_blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = open_.withColumn("j", F.pmod(draw, "blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)))
    columns = ["node", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")]
    return odd.select(*columns, F.lit(0).alias("side"), "id", "component", "tokens").union(each.select(*columns, F.lit(1).alias("side"), "id", "component", "tokens"))


def _compared(blocks: DataFrame, percent: int, exhaustive: bool) -> DataFrame:
    """Pairs (a, b) of different components in a block whose minwise tokens agree well enough.

    Not exhaustive: each class's best partner outside its component, still to be
    verified.  Exhaustive (``blocks`` with full sets): all pairs are verified
    here, best first; what is returned are links, without those between classes
    that the block's links so far connect.
    """
    t = percent / 100
    least = POSITIONS * (t - SPREAD * math.sqrt(t * (1 - t) / POSITIONS))

    def pairs(left: list, right: list) -> Iterator[tuple[int, int]]:
        (li, lc, lt), (ri, rc, rt) = ((np.array([r[0] for r in side]), np.array([r[1] for r in side]),
                                       np.frombuffer(b"".join(r[2] for r in side), np.uint8).reshape(len(side), -1)) for side in (left, right))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        for i in range(len(li)):
            agree = (rt == lt[i]).sum(axis=1)
            hit = np.flatnonzero((agree >= least) & (rc != lc[i]))
            if exhaustive:
                for j in hit[np.argsort(-agree[hit], kind="stable")].tolist():
                    x, y = root(int(lc[i])), root(int(rc[j]))
                    if x != y and _similar(left[i][3], right[j][3], percent):
                        parent[max(x, y)] = min(x, y)
                        yield int(li[i]), int(ri[j])
            elif len(hit):
                yield int(li[i]), int(ri[hit[np.argmax(agree[hit])]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "i", "j", "side", "id", "component", "tokens"] + ["set"] * exhaustive
        block, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if got := list(pairs(*sides)) if all(sides) else []:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in got], pa.int64()), pa.array([max(x) for x in got], pa.int64())], ["a", "b"])

        for batch in batches:
            for node, i, j, side, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                if (node, i, j) != block:
                    yield from done()
                    block, sides = (node, i, j), ([], [])
                sides[side].append(row)
        yield from done()

    return blocks.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def _join_up(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of all links, with the components so far standing for theirs."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def _judged(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, component_id, kept for every row of ``docs``."""
    total = docs.count()
    depth, trees = plan_trees(total, percent)
    sketch = materialize(sketches(docs, depth, trees, percent, words), "sketches")
    linkable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "tokens", "keys")).alias("c"), F.count(F.lit(1)).alias("size"))
    # Numbered once, as two classes may have the same smallest doc_id.
    classes = materialize(classes.select("f1", "f2", "size", F.monotonically_increasing_id().alias("id"), "c.doc_id", "c.tokens", "c.keys"), "classes")

    inside = classes.select("id", F.explode("keys").alias("node")).distinct()
    nodes = inside.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(inside.join(nodes, "node"), "nodes")
    pairs = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    sets = materialize(full_sets(docs, classes.join(members.select("id").distinct(), "id", "left_semi"), words), "sets")
    links = materialize(verified(pairs, sets, percent), "links")

    found = components(links)
    tokens = classes.select("id", "tokens")
    for _ in range(BEST_ROUNDS):
        best = materialize(_compared(_blocks(members, found, tokens), percent, exhaustive=False), "pairs")
        found = _join_up(found, materialize(verified(best, sets, percent), "links"))
    last = _blocks(members, found, tokens).join(sets, "id")
    found = _join_up(found, materialize(_compared(last, percent, exhaustive=True), "links"))

    # Only classes with copies or links differ from "on its own".  A component is named by its smallest doc_id.
    placed = classes.join(found, "id", "left").filter("size > 1 OR component IS NOT NULL")
    placed = materialize(placed.select("f1", "f2", "size", "doc_id", F.coalesce("component", "id").alias("component")), "placed")
    names = materialize(placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    linked = materialize(join_groups(placed.drop("doc_id"), names, ["component"], "members", total).select("f1", "f2", "size", "component_id"), "linked")
    rows = sketch.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("f1")).alias("f1"), "f2")
    judged = join_groups(rows, linked, ["f1", "f2"], "size", total)
    component = F.when(F.col("f1").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return judged.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return _judged(docs, percent, words).drop("text_hash")


def one_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One document of each component (the smallest doc_id), with all columns of ``docs``, whatever their names."""
    gone_id, gone_hash = free_names(docs, 2)
    gone = materialize(_judged(docs, percent, words), "near_dedup").filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("bigint") == gone[gone_id]) & (F.xxhash64(docs["text"]) == gone[gone_hash]), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
