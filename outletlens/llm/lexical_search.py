"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

1. One pass over the whole texts writes, per document, its number of terms and
   the frequencies of those terms that some item asks for.  N, L and the
   document frequencies are sums over that table.
2. The documents are searched in blocks of at most ``BLOCK_POSTINGS`` list
   entries, in tasks, without a shuffle.  In a block every asked term has a list
   of (document, impact), sorted by descending impact.  An item reads its
   terms' lists in turn, a piece at a time.  What was read of a document gives
   the lower bound of its score; the upper bound adds, for every list in which
   it was not met yet, the impact that this list has come to.
3. Documents whose upper bound cannot reach the ten best lower bounds (equal
   scores are settled by doc_id) are out.  An item reads on until the ten best
   are known, and their order and scores are exact: every bound of theirs has
   closed.  Ten documents of one block set the bar for the task's next one.
4. The blocks' best ten of each item are merged: the best ten of all are among
   them, so a task sends ten rows an item at most.

Items are searched in rounds of at most ``ROUND_BYTES`` of item text, so what is
sent to the tasks is bounded whatever the number of items.  All scores are exact
64-bit integers.  Terms are compared by 64-bit hashes.

Defined cases: null texts and texts without terms count in no statistic and are
never found; items without terms, or whose terms occur nowhere, give no rows.  A
document row is a document: repeated rows are ranked each, equal scores and ids
in any order.  A null doc_id comes after all others of equal score.  Each row of
``items`` is an item, also with a repeated or null item_id.  Other columns,
whatever their names, are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .common import Shared, slices, table, utf8_column

TOP = 10
#: Postings that one block holds: with all that NRA keeps for them, some 100 MB.
BLOCK_POSTINGS = 1 << 20
#: Documents of one block.
BLOCK_DOCS = 1 << 14
#: Entries that one list gives in the first step of an item; each later step reads twice as many.
FIRST_STEP = 64
#: Item text whose terms go to the tasks at once.
ROUND_BYTES = 1 << 24
#: A doc_id column's null, after every id.
NO_ID = np.iinfo(np.int64).max


def term_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every term, repeats included, in text order."""
    start, end, doc = W.spans(buf, offs, W.ALNUM)
    return W.hashes(buf, start, end), doc


@dataclass
class Items:
    """Items of one round: per item (by number) the positions of its terms in ``terms`` and their repeats."""
    ids: list
    terms: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]


def read_items(rows: list) -> Items:
    column = pa.array([r["text"] for r in rows], pa.string())
    h, doc = term_hashes(*utf8_column(column))
    terms, at = np.unique(h, return_inverse=True)
    asked = [np.unique(at[doc == i], return_counts=True) for i in range(len(rows))]
    return Items([r["item_id"] for r in rows], terms, asked)


def item_rounds(items: DataFrame, most: int = ROUND_BYTES) -> Iterator[Items]:
    """The items in rounds of at most so many bytes of text (or one item)."""
    rows, size = [], 0
    for row in items.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        n = len(row["text"].encode())
        if rows and size + n > most:
            yield read_items(rows)
            rows, size = [], 0
        rows.append(row)
        size += n
    if rows:
        yield read_items(rows)


def postings(docs: DataFrame, terms: Shared) -> DataFrame:
    """Per document with terms: doc_id, its number of terms, and the asked terms (by position) with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = terms.load()
        for batch in batches:
            for part in slices(batch, "text"):
                h, doc = term_hashes(*utf8_column(part.column("text")))
                count = np.bincount(doc, minlength=part.num_rows)
                at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                hit = asked[at] == h
                key, tf = np.unique(doc[hit] * np.int64(len(asked)) + at[hit], return_counts=True)
                bounds = np.searchsorted(key, np.arange(part.num_rows + 1) * np.int64(len(asked))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((key % len(asked)).astype(np.int32), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(count > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def statistics(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequencies of the asked terms."""
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(terms, np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]
    return size["n"], size["l"] or 0, df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """The impact-sorted lists of some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, length: int):
        self.order = np.argsort(ids, kind="stable")  # documents are numbered by doc_id, so ties go by number
        self.ids = ids[self.order]
        number = np.empty(len(ids), np.int64)
        number[self.order] = np.arange(len(ids))
        # Python's integers, as 75 * n * N may pass 64 bits before the division.
        m = np.array([25 + (75 * x * total) // length for x in n.tolist()], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        by = np.lexsort((number[doc], -impact, term))
        self.doc, self.impact, term = number[doc][by], impact[by], term[by]
        self.terms, first = np.unique(term, return_index=True)
        self.bounds = np.append(first, len(term))

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, weighted impacts) of those terms that occur here and weigh something."""
        out = []
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            for i in np.flatnonzero((self.terms[at] == terms) & (weights > 0)).tolist():
                a, b = self.bounds[at[i]], self.bounds[at[i] + 1]
                out.append((self.doc[a:b], self.impact[a:b] * weights[i]))
        return out


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, bar: int = 0, top: int = TOP, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, exact scores, entries read): the ``top`` best with a score of ``bar`` or more, and above 0.

    ``lists`` are sorted by descending value; a document is in a list once.
    Equal scores go by document number.
    """
    lower = np.zeros(docs, np.int64)
    met = np.zeros((len(lists), docs), bool)
    alive = np.ones(docs, bool)
    read, entries = [0] * len(lists), 0
    bar = max(bar, 1)
    while True:
        for k, (doc, value) in enumerate(lists):
            if (a := read[k]) < len(doc):
                b = min(len(doc), a + step)
                lower[doc[a:b]] += value[a:b]
                met[k, doc[a:b]] = True
                read[k], entries = b, entries + b - a
        step *= 2
        # What a document not met yet can still get from each list.
        rest = np.array([value[read[k] - 1] if read[k] < len(doc) else 0 for k, (doc, value) in enumerate(lists)], np.int64)
        at = np.flatnonzero(alive)
        gap = rest.sum() - rest @ met[:, at].astype(np.int64)
        low = lower[at]
        high = low + gap
        if len(at) > top:
            bar = max(bar, int(np.partition(low, len(low) - top)[len(low) - top]))
        stay = high >= bar
        alive[at[~stay]] = False
        at, low, high = at[stay], low[stay], high[stay]
        if not len(at) or (high == low).all():
            best = at[np.lexsort((at, -low))][:top]
            return best, lower[best], entries
        # Settled early: the first ``top`` are exact, and nothing else reaches the last of them (a tie goes to the lower number).
        order = np.lexsort((at, -low))[:top]
        if len(order) == top and (high[order] == low[order]).all():
            last = order[-1]
            others = np.ones(len(at), bool)
            others[order] = False
            if not (others & ((high > low[last]) | ((high == low[last]) & (at < at[last])))).any():
                return at[order], low[order], entries


def best_of_blocks(index: DataFrame, items: Items, total: int, length: int, df: np.ndarray, top: int = TOP) -> DataFrame:
    """(item number, doc_id, score): each task's ``top`` best documents of each item."""
    weights = np.array([weight(total, int(x)) if x else 0 for x in df], np.int64)
    shared = Shared(index.sparkSession, [(terms, repeats * weights[terms]) for terms, repeats in items.asked])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held: list[tuple] = []
        size = rows = 0

        def block() -> Block:
            ids, n, sizes, term, tf = (np.concatenate(x) for x in zip(*held))
            return Block(ids, n, np.repeat(np.arange(len(ids)), sizes), term, tf, total, length)

        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            bounds = terms.offsets.to_numpy()
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(bounds, bounds[a] + BLOCK_POSTINGS - size, side="right")) - 1
                b = min(max(b, a + (not held)), a + BLOCK_DOCS - rows, batch.num_rows)
                if b > a:
                    ids = batch.column("doc_id").slice(a, b - a).fill_null(NO_ID).to_numpy()
                    span = slice(bounds[a], bounds[b])
                    held.append((ids, batch.column("n").slice(a, b - a).to_numpy(), np.diff(bounds[a: b + 1]), terms.values.to_numpy()[span], tfs.values.to_numpy()[span]))
                    size, rows, a = size + int(bounds[b] - bounds[a]), rows + b - a, b
                if a < batch.num_rows:
                    yield block()
                    held, size, rows = [], 0, 0
        if held:
            yield block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.load()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked]
        for block in blocks(batches):
            for i, (terms, weights_) in enumerate(asked):
                if lists := block.lists(terms, weights_):
                    ids, scores = best[i]
                    doc, score, _ = nra(lists, len(block.ids), int(scores[-1]) if len(scores) == top else 0, top)
                    ids, scores = np.append(ids, block.ids[doc]), np.append(scores, score)
                    order = np.lexsort((ids, -scores))[:top]
                    best[i] = ids[order], scores[order]
        number = np.repeat(np.arange(len(best)), [len(s) for _, s in best])
        ids = np.concatenate([b[0] for b in best]) if best else np.empty(0, np.int64)
        scores = np.concatenate([b[1] for b in best]) if best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    spark, found = docs.sparkSession, []
    kind = items.schema["item_id"].dataType
    for asked in item_rounds(items):
        if not len(asked.terms):
            continue
        index = materialize(postings(docs, Shared(spark, asked.terms)), "postings")
        total, length, df = statistics(index, len(asked.terms))
        rows = best_of_blocks(index, asked, total, length, df, top)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(asked.ids)), f"item bigint, item_id {kind.simpleString()}")
        found.append(materialize(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    for rows in found:
        out = out.union(rows)
    return out


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, * FROM documents)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, count(*) AS n FROM terms GROUP BY row),
totals AS (SELECT count(*) AS n_docs, cast(sum(n) AS bigint) AS n_terms FROM sizes),
weights AS (SELECT term, cast(floor(1000 * ln((2 * max(n_docs) + 2)::double / (2 * count(*) + 1))) AS bigint) AS w FROM tf, totals GROUP BY term),
asked AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
scores AS (
  SELECT item, item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS bigint) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (row), totals
  GROUP BY ALL),
ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS int) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
