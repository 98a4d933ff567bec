"""Conversation prefix trie from padded turn-id matrices.

1. A turn's identity is a 128-bit digest of its role and text; texts move no
   further.  A conversation is one row: its turns' digests in order (16 bytes a
   turn) and their word counts.
2. Rows are range-partitioned by their digest sequence, then conv_id, so equal
   prefixes lie side by side and a hot conversation, first turn or group of
   copies is spread over as many shards as it needs.
3. In a shard, digests get dense ids, and the sequences form a padded matrix,
   which ``numpy.lexsort`` orders.  Changes between neighbouring rows, OR-ed from
   column to column, mark where nodes start; ``reduceat`` over the marks gives
   members, children, leaves and savings at every depth, deepest first.  Columns
   are taken ``COLUMNS`` at a time, each time only for the rows that go on, so a
   very long conversation does not widen the others' rows.
4. A node is complete in its shard unless the shard's first or last row starts
   with it.  These boundary nodes, at most two paths a shard, are handed on as
   shares with all that belongs to them but to no deeper boundary node; equal
   ones are merged and summed up their paths.

The digest of a boundary node's ending conversations runs over sorted runs of
ids, one run a shard, in order and with bounded memory.  (SHA-256 is sequential:
one task reads the runs of a node.)

Defined cases: null role or text counts as empty; a null turn comes first, and
turns that tie follow in the order of their digests.  Rows of a null conv_id
belong to no conversation and to no node.  The remainder of a negative conv_id
is that of SQL (-3 % 20 is -3).  Repeated rows are turns of their own.
Other columns, whatever their names, are not read.  Without conversations there
is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import table

#: Bytes of a turn's digest.
DIGEST = 16
#: Conversations with ids in one run of so many share the run's first as the source of their first turns.
RUN = 20
#: Turns of one shard: with the matrix, some 50 MB.
SHARD_TURNS = 1 << 17
#: Depths of one matrix.
COLUMNS = 32
#: Ids in one row of a boundary node's endings.
RUN_IDS = 1 << 16

NODE, SHARE, ENDS = 0, 1, 2
SHARD_ROWS = ("kind int, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
              " saved_tokens bigint, ends_sha256 string, words bigint, deeper boolean, ids binary")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def sequences(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its ordered turns (digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)), 1, DIGEST)
    each = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", digest.alias("d"), words_in(text).alias("w")).alias("t"))
    each = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # nulls come first
    return each.select("conv_id", F.transform("t", lambda t: F.struct(t.d.alias("d"), t.w.alias("w"))).alias("turns"))


def shared_heads(convs: DataFrame, run: int = RUN) -> DataFrame:
    """Every conversation rebuilt: the first turns are those of the run's first conversation.

    For conversation c, crc32(c) mod 4 turns are replaced.  A run's first turns
    (at most three) meet at most ``run`` conversations, so no key is hot.
    """
    heads = convs.select(F.col("conv_id").alias("first"), F.slice("turns", 1, 3).alias("head"))
    own = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % run).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int"))
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class Shard:
    """The nodes of some conversations: ids (int64), path bytes and word counts of each."""

    def __init__(self, conv: np.ndarray, size: np.ndarray, digests: np.ndarray, words: np.ndarray, columns: int):
        self.conv, self.size, self.words, self.columns = conv, size, words, columns
        self.offs = np.cumsum(size) - size
        self.digests = digests  # turns x 16
        high, low = digests.view(">u8").reshape(-1, 2).T.astype(np.uint64)
        by = np.lexsort((low, high))
        new = np.zeros(len(by), np.int64)
        new[1:] = (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])
        self.turn_ids = np.empty(len(by), np.int64)
        self.turn_ids[by] = np.cumsum(new)
        self.levels = self._levels()

    def _levels(self) -> list[dict]:
        """Per depth the nodes' row order, where each starts, and what needs no deeper nodes."""
        m, out = len(self.conv), []
        active, group, depth = np.arange(m), np.zeros(m, np.int64), 0
        above = np.full(m, self.conv.min())  # smallest member of the node above, by row
        on_first = on_last = True  # whether the shard's first and last row by whole sequences are at the ends of this matrix
        while len(active):
            n = min(self.columns, int(self.size[active].max()) - depth)
            if not n:  # depth 0 only: no conversation has a turn
                break
            left = np.clip(self.size[active] - depth, 0, n)
            matrix = np.full((len(active), n), -1, np.int64)
            row = np.repeat(np.arange(len(active)), left)
            column = np.arange(len(row)) - np.repeat(np.cumsum(left) - left, left)
            matrix[row, column] = self.turn_ids[self.offs[active][row] + depth + column]
            longer = self.size[active] > depth + n
            order = np.lexsort((self.conv[active], longer, *matrix.T[::-1], group))
            active, group, matrix, longer = active[order], group[order], matrix[order], longer[order]
            self.first = active[0] if on_first else self.first
            self.last = active[-1] if on_last else self.last
            change = np.ones(len(active), bool)
            change[1:] = group[1:] != group[:-1]
            for j in range(n):
                change[1:] |= matrix[1:, j] != matrix[:-1, j]
                cuts = np.flatnonzero(change)
                real = matrix[cuts, j] >= 0
                depth += 1
                size = np.diff(np.append(cuts, len(active)))
                least = np.minimum.reduceat(self.conv[active], cuts)
                head = active[cuts]
                level = {"depth": depth, "rows": active, "cuts": cuts, "real": real, "size": size, "least": least, "above": above[head],
                         "deeper": np.maximum.reduceat(self.size[active], cuts) > depth, "ends": np.add.reduceat((self.size[active] == depth).astype(np.int64), cuts)}
                level["open"] = np.zeros(len(cuts), bool)
                if on_first:
                    level["open"][0] = real[0]
                if on_last:
                    level["open"][-1] = real[-1]
                level["words"] = np.where(real, self.words[np.minimum(self.offs[head] + depth - 1, max(len(self.words) - 1, 0))], 0)
                out.append(level)
                above = above.copy()
                above[active] = np.repeat(least, size)
            on_first, on_last = on_first and longer[0], on_last and longer[-1]
            group = np.cumsum(change)[longer]
            active = active[longer]
        if not out:
            by = np.argsort(self.conv, kind="stable")
            self.first, self.last = by[0], by[-1]
        return out

    def _paths(self) -> dict[tuple[int, int], bytes]:
        """(row, depth) -> name of that boundary node; a name is a digest of the path."""
        names = {}
        for row in {int(self.first), int(self.last)}:
            h = hashlib.sha256()
            names[row, 0] = h.digest()[:DIGEST]
            for d in range(int(self.size[row])):
                h.update(self.digests[self.offs[row] + d].tobytes())
                names[row, d + 1] = h.copy().digest()[:DIGEST]
        return names

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = self._paths()
        m = len(self.conv)
        saved, leaves = np.zeros(m, np.int64), np.zeros(m, np.int64)
        below = np.zeros(m, np.int64)  # complete nodes one level deeper, at their first rows
        root = {"depth": 0, "rows": np.argsort(self.conv, kind="stable"), "cuts": np.zeros(1, np.int64), "real": np.ones(1, bool), "open": np.ones(1, bool), "size": np.array([m]),
                "least": np.array([self.conv.min()]), "deeper": np.array([bool((self.size > 0).any())]), "words": np.zeros(1, np.int64), "above": np.zeros(1, np.int64)}
        for level, parent in zip([*self.levels[::-1], root], [*self.levels[-2::-1], root, None]):
            rows, cuts, d = level["rows"], level["cuts"], level["depth"]
            done = level["real"] & ~level["open"]
            head = rows[cuts]
            saved[head[done]] += ((level["size"] - 1) * level["words"])[done]
            leaves[head[done]] += ~level["deeper"][done]
            totals = [np.add.reduceat(x[rows], cuts) for x in (below, leaves, saved)]
            below = np.zeros(m, np.int64)
            below[head[done]] = 1
            for k in np.flatnonzero(level["open"]).tolist():  # at most two
                a, b = cuts[k], cuts[k] + level["size"][k]
                saved[rows[a:b]] = leaves[rows[a:b]] = 0  # counted here, and in no node above
                key = self.first if self.first in rows[a:b] else self.last
                ending = rows[a:b][self.size[rows[a:b]] == d]
                ids = np.sort(self.conv[ending])
                name, up = names[int(key), d], names[int(key), d - 1] if d else None
                yield self._batch(1, kind=SHARE, node=[name], parent=[up], conv_id=level["least"][[k]], depth=d, n_convs=level["size"][[k]], n_children=totals[0][[k]],
                                  n_leaves=totals[1][[k]], saved_tokens=totals[2][[k]], words=level["words"][[k]], deeper=level["deeper"][[k]])
                for i in range(0, len(ids), RUN_IDS):
                    yield self._batch(1, kind=ENDS, node=[name], conv_id=ids[[i]], ids=[ids[i: i + RUN_IDS].tobytes()])
            if not done.any():
                continue
            at = np.flatnonzero(done)
            sha = [EMPTY_SHA if not e else hashlib.sha256(",".join(map(str, self.conv[rows[c: c + e]].tolist())).encode()).hexdigest()
                   for c, e in zip(cuts[at].tolist(), level["ends"][at].tolist())]
            # The node above may be a boundary node, whose smallest member is known only when all shards are.
            ups: list = [None] * len(at)
            if parent is not None:
                starts, spread = parent["cuts"], np.empty(m, np.int64)
                spread[parent["rows"]] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(parent["rows"]))))
                over = spread[head[at]]
                for k in np.flatnonzero(parent["open"]).tolist():
                    a, b = starts[k], starts[k] + parent["size"][k]
                    key = self.first if self.first in parent["rows"][a:b] else self.last
                    for i in np.flatnonzero(over == k).tolist():
                        ups[i] = names[int(key), d - 1]
            yield self._batch(len(at), kind=NODE, parent=ups, conv_id=level["least"][at], depth=d, parent_conv_id=level["above"][at], n_convs=level["size"][at], n_children=totals[0][at],
                              n_leaves=totals[1][at], saved_tokens=totals[2][at], ends_sha256=sha, words=level["words"][at], deeper=level["deeper"][at])

    @staticmethod
    def _batch(n: int, **columns) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        fields = [f.split() for f in SHARD_ROWS.split(", ")]
        values = [columns.get(name) for name, _ in fields]
        return pa.RecordBatch.from_arrays([pa.array([v] * n if v is None or np.isscalar(v) else v, kinds[kind]) for v, (_, kind) in zip(values, fields)], [name for name, _ in fields])


def shard_rows(rebuilt: DataFrame, shards: int, columns: int = COLUMNS) -> DataFrame:
    """The nodes complete in each shard, the shares of boundary nodes, and the ids that end at these."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.d)), ""))
    flat = rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.w).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"conv_id": [], "path": [], "words": []})])
        if rows.num_rows:
            conv = rows.column("conv_id").to_numpy()
            words = np.concatenate([c.flatten().to_numpy() for c in rows.column("words").chunks])
            digests = np.concatenate([_bytes(c) for c in rows.column("path").chunks]).reshape(-1, DIGEST)
            size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows.column("words").chunks]).astype(np.int64)
            yield from Shard(conv, size, np.ascontiguousarray(digests), words.astype(np.int64), columns).rows()

    return flat.repartitionByRange(shards, "path", "conv_id").mapInArrow(run, SHARD_ROWS)


def _bytes(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None else np.empty(0, np.uint8)


def recombined(shares: DataFrame) -> DataFrame:
    """The boundary nodes.  There are at most two paths a shard, so one task sums them up their paths."""
    merged = shares.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                                        F.max("words").alias("words"), F.max("deeper").alias("deeper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {r["node"]: r for batch in batches for r in batch.to_pylist()}
        for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            r["n_leaves"] += not r["deeper"]
            if up := nodes.get(r["parent"]):
                up["n_children"] += 1
                up["n_leaves"] += r["n_leaves"]
                up["saved_tokens"] += r["saved_tokens"]
        columns = ["node", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        above = [nodes[r["parent"]]["conv_id"] if r["parent"] is not None else None for r in nodes.values()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in nodes.values()], pa.binary() if c == "node" else pa.int64()) for c in columns] + [pa.array(above, pa.int64())], [*columns, "parent_conv_id"])

    return merged.repartition(1).mapInArrow(run, "node binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, parent_conv_id bigint")


def ending_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the boundary nodes, from runs of ids that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, begun = None, hashlib.sha256(), False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])
        for batch in batches:
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if node is not None:
                        yield done()
                    node, h, begun = name, hashlib.sha256(), False
                h.update(("," if begun else "").encode() + ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode())
                begun = True
        if node is not None:
            yield done()

    runs = ends.select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id")
    return runs.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, shard_turns: int = SHARD_TURNS, columns: int = COLUMNS) -> DataFrame:
    """The nodes of all prefixes of ``rebuilt`` (conv_id, turns); conv_id is unique."""
    rebuilt = materialize(rebuilt, "rebuilt")
    turns = rebuilt.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    parts = materialize(shard_rows(rebuilt, max(1, -(-turns // shard_turns)), columns), "trie_shards")
    edges = materialize(recombined(parts.filter(F.col("kind") == SHARE)), "trie_edges")
    shas = ending_digests(parts.filter(F.col("kind") == ENDS))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ = edges.join(shas, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    # The boundary nodes' table is as small as the number of shards: two paths each.
    above = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = parts.filter(F.col("kind") == NODE).join(F.broadcast(above), "parent", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return inner.select(*result).unionByName(open_.select(*result))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(sequences(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH RECURSIVE
crc_table(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_table WHERE k < 8),
crc(conv_id, i, c) AS (
  SELECT DISTINCT conv_id, 0, 4294967295::bigint FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, i + 1, xor(c >> 8, v)
  FROM crc JOIN crc_table ON k = 8 AND b = (xor(c, ascii(substr(conv_id::varchar, (i + 1)::bigint, 1))::bigint) & 255)
  WHERE i < length(conv_id::varchar)),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h FROM crc WHERE i = length(conv_id::varchar)),
turns AS (
  SELECT conv_id, sha, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
               left(sha256(concat(length(coalesce(role, ''))::varchar, ':', coalesce(role, ''), coalesce(text, ''))), 32) AS sha
        FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT c.conv_id, sha, words, pos FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL
  SELECT c.conv_id, sha, words, pos + 3 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
paths AS (SELECT c.conv_id, coalesce(p.path, []) AS path, coalesce(p.words, []) AS words
          FROM convs c LEFT JOIN (SELECT conv_id, list(sha ORDER BY pos) AS path, list(words ORDER BY pos) AS words FROM rebuilt GROUP BY conv_id) p USING (conv_id)),
prefixes AS (SELECT conv_id, d AS depth, path[1:d] AS path, d = len(path) AS ended, coalesce(words[d], 0) AS words
             FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth),
children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
trees AS (
  SELECT path[1:d] AS path, d AS depth, cast(sum((n_children = 0)::bigint) AS bigint) AS n_leaves, cast(sum((n_convs - 1) * words) AS bigint) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM own) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM own n JOIN trees t ON t.depth = n.depth AND t.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
