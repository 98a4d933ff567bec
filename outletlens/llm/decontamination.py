"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts and items are lower-cased (A-Z) and cut into words.  All items form one
suffix automaton over word numbers.  A document's words are streamed through
it; the automaton holds the longest match that ends at each word, and so tells
which windows (``window`` consecutive item words, or a whole shorter item) end
there.  Words between matches cannot move the automaton far: a match of m words
needs m - 1 neighbouring word pairs of the items, so runs of known pairs are
found first, for whole blocks of text in numpy, and only runs that are long
enough for the shortest window are streamed.  That skips no match.

Distinct items are split by hash over shards of about ``SHARD_BYTES`` of item
text.  Spark tasks build one automaton a shard and write it to the checkpoint
folder.  A pass reads one of them back, sends it to the tasks, and writes the
documents with what was found so far before the next pass begins, so driver and
tasks hold one automaton whatever the benchmark's size.  An item is never split:
an item longer than a shard makes a shard of its length.  Documents are never
shuffled.

``judge`` reports; ``clean`` drops contaminated documents; ``remove_spans`` cuts
the hit spans out of the texts, those over a length limit and, in documents over
the coverage limit, all of them.

Defined cases: null or empty texts have no words, no hits and are clean; an
item without words is in no document; a null ``item_id`` adds hits but no id;
item rows with the same id are one item; repeated documents are each judged;
``clean`` and ``remove_spans`` keep all columns, whatever their names; the latter
leaves a null text null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, materialize
from . import words as W
from .common import Shared, slices, table, utf8_column

#: Words of a window.
WINDOW = 13
#: A document is contaminated if it has hits and SHARE * n_hit >= n_words.
SHARE = 20
#: Item text of one automaton.
SHARD_BYTES = 1 << 19
_BITS = 20


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        column = pa.array([x for _, x in items], pa.string())
        buf, offs = utf8_column(column)
        start, end, doc = W.spans(buf, offs, W.ALNUM)
        h = W.hashes(buf, start, end)
        self.known, numbers = np.unique(h, return_inverse=True)
        self.next, self.link, self.length = [{}], [-1], [0]
        sequences = [numbers[a:b].tolist() for a, b in zip(np.searchsorted(doc, np.arange(len(items))), np.searchsorted(doc, np.arange(len(items)), "right"))]
        for sequence in sequences:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        # ends[state]: {window length: item ids}; a window belongs to the state that holds it.
        self.ends: dict[int, dict[int, set]] = {}
        self.shortest = window
        for (item, _), sequence in zip(items, sequences):
            if not sequence:
                continue
            size = min(window, len(sequence))
            self.shortest = min(self.shortest, size)
            for state, i in self._states(sequence, size):
                self.ends.setdefault(state, {}).setdefault(size, set()).update([] if item is None else [item])
        pair, _ = W.pairs(h, doc)
        self.pairs = np.unique(pair)
        self.marks = np.zeros(1 << _BITS, bool)
        self.marks[(self.pairs & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the string is there already, from an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _states(self, sequence: list[int], size: int) -> Iterator[tuple[int, int]]:
        """The state that holds each window of ``size`` words of ``sequence``."""
        state = at = 0
        for i, c in enumerate(sequence):
            state, at = self.step(state, at, c)
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            at = min(at, self.length[state])
            if i >= size - 1:
                yield state, i

    def step(self, state: int, at: int, c: int) -> tuple[int, int]:
        """State and length of the longest match that ends with word ``c``."""
        while c not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            at = self.length[state]
        return self.next[state][c], at + 1

    def runs(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal word ranges that can hold a window: (first, beyond the last)."""
        good = np.zeros(len(h) + 1, bool)
        if self.shortest == 1:
            good[:-1] = np.isin(h, self.known)
            first = np.flatnonzero(good[:-1] & ~np.r_[False, good[:-2] & (doc[1:] == doc[:-1])])
            last = np.flatnonzero(good[:-1] & ~np.r_[good[1:-1] & (doc[1:] == doc[:-1]), False]) + 1
            return first, last
        pair, at = W.pairs(h, doc)
        maybe = np.flatnonzero(self.marks[(pair & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        maybe = maybe[np.isin(pair[maybe], self.pairs)]
        good[at[maybe]] = True
        edge = np.diff(np.r_[False, good].astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        enough = last - first >= self.shortest
        return first[enough], last[enough]

    def matches(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, beyond the last word, items) of windows found in the words."""
        first, last = self.runs(h, doc)
        for a, b in zip(first.tolist(), last.tolist()):
            state = at = 0
            for i, c in enumerate(np.searchsorted(self.known, h[a:b]).tolist(), a):
                state, at = self.step(state, at, c)
                if at < self.shortest:
                    continue
                s, n = state, at
                while s > 0:
                    for size, items in self.ends.get(s, {}).items():
                        if size <= n:
                            yield i + 1 - size, i + 1, items
                    s = self.link[s]
                    n = self.length[s]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_STATE = ["__hits", "__items", "__n_words", "__n_hit"]
_STATE_TYPES = "__hits array<bigint>, __items array<string>, __n_words bigint, __n_hit bigint"


def _pass(docs: DataFrame, shared: Shared, text: str, keep: list[str]) -> DataFrame:
    """Adds to the state columns what one automaton finds; other columns in ``keep`` go through."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep]
    keep = [f.name for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.load()
        for batch in batches:
            for rows in slices(batch, text):
                buf, offs = utf8_column(rows.column(text))
                start, end, doc = W.spans(buf, offs, W.ALNUM)
                h = W.hashes(buf, start, end)
                n = np.bincount(doc, minlength=rows.num_rows)
                zero = np.cumsum(n) - n
                spans, items = {}, {}
                for r, found in enumerate(rows.column("__hits").to_pylist()):
                    if found:
                        spans[r] = list(zip(found[::2], found[1::2]))
                for r, found in enumerate(rows.column("__items").to_pylist()):
                    items[r] = set(found or ())
                for a, b, ids in automaton.matches(h, doc):
                    r = int(doc[a])
                    spans.setdefault(r, []).append((a - int(zero[r]), b - int(zero[r])))
                    items[r] |= ids
                spans = {r: _merge(x) for r, x in spans.items()}
                every = range(rows.num_rows)
                state = [pa.array([[y for x in spans.get(r, ()) for y in x] for r in every], pa.list_(pa.int64())),
                         pa.array([sorted(items[r]) for r in every], pa.list_(pa.string())), pa.array(n, pa.int64()),
                         pa.array([sum(b - a for a, b in spans.get(r, ())) for r in every], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *state], [*keep, *_STATE])

    return docs.mapInArrow(run, ", ".join([*fields, _STATE_TYPES]))


def automata(benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, automaton): the pickled automaton of each shard of items, built in tasks and written once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def build(rows: pa.Table) -> pa.Table:
        automaton = Automaton(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())), window)
        return pa.table({"shard": rows.column("shard")[:1], "automaton": pa.array([pickle.dumps(vars(automaton))], pa.binary())})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    return materialize(dealt.groupBy("shard").applyInArrow(build, "shard bigint, automaton binary"), "automata")


def _load(built: DataFrame, shard: int) -> Automaton:
    automaton = object.__new__(Automaton)
    vars(automaton).update(pickle.loads(built.filter(F.col("shard") == shard).first()["automaton"]))
    return automaton


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` with hit word ranges, found items, words and hit words."""
    spark = docs.sparkSession
    out = docs.withColumns({"__hits": F.lit(None).cast("array<bigint>"), "__items": F.lit(None).cast("array<string>"),
                            "__n_words": F.lit(0).cast("bigint"), "__n_hit": F.lit(0).cast("bigint")})
    built = automata(benchmark, window, shard_bytes)
    shards = sorted(r["shard"] for r in built.select("shard").collect())  # one number per shard_bytes of items
    if not shards:
        return _pass(out, Shared(spark, Automaton([], window)), text, keep)
    for k in shards[:-1]:
        shared, before = Shared(spark, _load(built, k)), out
        out = materialize(_pass(before, shared, text, list(dict.fromkeys([*keep, text]))), "decontamination_pass")
        shared.forget()
        if hasattr(before, "scratch_path"):
            drop(spark, before)
    return _pass(out, Shared(spark, _load(built, shards[-1])), text, list(dict.fromkeys(keep)))


def contaminated():
    return (F.col("__n_hit") > 0) & (SHARE * F.col("__n_hit") >= F.col("__n_words"))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The contract's columns and ``hits``: first and beyond-last word of each removable span, flat."""
    found = scan(docs.select("doc_id", "text"), benchmark, ["doc_id"], window=window, shard_bytes=shard_bytes)
    ids = F.array_join(F.array_sort("__items"), ",")
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("bigint").alias("n_items"),
                        F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.col("__hits").alias("hits"))


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The documents with columns c0, c1, ...; the name of the text among them."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered, numbered.columns[docs.columns.index(text)]


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names."""
    numbered, column = _numbered(docs, text)
    kept = scan(numbered, benchmark, numbered.columns, column, window).filter(~contaminated())
    return kept.select(*[F.col(c).alias(name) for c, name in zip(numbered.columns, docs.columns)])


def _cut(found: DataFrame, text: str, longest: int, share: int) -> DataFrame:
    """``found`` without the state columns, its texts without the spans over a limit."""
    fields = [f for f in found.schema.fields if f.name not in _STATE]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                column = rows.column(text)
                texts: list[bytes | None] = column.cast(pa.binary()).to_pylist()
                buf, offs = utf8_column(column)
                start, end, doc = W.spans(buf, offs, W.ALNUM)
                zero = np.searchsorted(doc, np.arange(rows.num_rows))
                state = zip(*(rows.column(c).to_pylist() for c in ("__hits", "__n_words", "__n_hit")))
                for r, (hits, n_words, n_hit) in enumerate(state):
                    spans = list(zip(hits[::2], hits[1::2]))
                    if not share * n_hit >= n_words:
                        spans = [(a, b) for a, b in spans if b - a > longest]
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(texts[r][at: int(start[zero[r] + a] - offs[r])])
                        at = int(end[zero[r] + b - 1] - offs[r])
                    if spans:
                        texts[r] = b"".join([*kept, texts[r][at:]])
                cut = pa.array(texts, pa.binary()).cast(column.type)
                yield pa.RecordBatch.from_arrays([cut if c == text else rows.column(c) for c in names], names)

    return found.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, longest: int = WINDOW, share: int = SHARE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All documents with all their columns, hit spans cut out of the texts.

    A span is a maximal run of hit words, from its first word's first byte to
    its last word's last byte; what stands around it stays as it is.  Spans of
    more than ``longest`` words go.  Where hit words are at least 1 / ``share``
    of all words, the document is over the coverage limit and every span goes.
    """
    numbered, column = _numbered(docs, text)
    found = scan(numbered, benchmark, numbered.columns, column, window, shard_bytes)
    return _cut(found, column, longest, share).toDF(*docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win USING (k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
