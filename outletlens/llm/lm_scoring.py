"""LM scoring by masked pseudo-likelihood.

A small network, written in numpy, predicts every token of a text from the
``REACH`` tokens on either side; a document's score is the sum of the logarithms
of these conditional probabilities.

1. Token counts of the whole corpus give the vocabulary: the most frequent
   tokens have their own numbers, all others share a quarter of the numbers by
   hash.  There are ``SIZE`` numbers at least, and more as the corpus's distinct
   tokens grow (``side_for``).  Counts are summed per task before the shuffle.
2. The network sums one embedding per place around the gap, takes tanh, and
   predicts the number in two steps: its class, then its place in the class.
   It starts from the corpus counts.  Every task trains on all tokens of its
   documents, and the tasks' weights are averaged by token count; weights are
   summed in two shuffled rounds, piece by piece.  So the network, and the scores
   within its accuracy, depend on how the documents are dealt to tasks.
3. Every document is scored with the averaged network.  A token that shares its
   number has the number's probability times the token's share of the number's
   occurrences: count / (count of the number + ``UNSEEN``).  Tokens that the
   corpus lacks share ``UNSEEN`` occurrences of each number.  The ``LISTED`` most
   frequent tokens' counts are broadcast, the rest is joined by hash, once for
   each document and token.

Defined cases: null and empty texts have 0 tokens, log_prob 0 and a null mean;
repeated documents get the same score; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .common import PARCELS, Shared, parcels, slices, summed, table, utf8_column

#: Numbers of frequent and of all other tokens in a small corpus; together SIDE * SIDE.
TOP, RARE, SIDE = 768, 256, 32
SIZE = TOP + RARE
#: Tokens on either side.
REACH = 2
DIMENSIONS = 16
BATCH, RATE = 4096, 5e-3
#: Weights that one task sums; a network has as many such pieces as its size takes.
CHUNK = 1 << 14
#: Distinct tokens that a task counts before it hands them on.
_HELD = 1 << 20
#: Tokens whose counts are broadcast (12 bytes each); a joined token occurs in less than 1 / LISTED of all places.
LISTED = 1 << 19
#: Occurrences that each shared number keeps for tokens that the corpus lacks.
UNSEEN = 0.5
#: Logarithms are summed as whole multiples of 1 / _STEPS, so the order of a sum is no matter.
_STEPS = 1 << 30

_SPACE = ~W.NOT_SPACE
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_OTHER = ~(_LETTER | _SPACE)


def token_hashes(rows: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of letters or of other characters, lower-cased."""
    buf, offs = utf8_column(rows.column(text))
    parts = [W.spans(buf, offs, kind) for kind in (_LETTER, _OTHER)]
    start = np.concatenate([p[0] for p in parts])
    order = np.argsort(start, kind="stable")
    start, end, doc = (np.concatenate([p[i] for p in parts])[order] for i in range(3))
    return W.hashes(buf, start, end), doc


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): how often each token occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for rows in slices(batch, text):
                held.append(np.unique(token_hashes(rows, text)[0], return_counts=True))
                if sum(len(h) for h, _ in held) > 2 * _HELD:
                    held = [merged()]
                    if len(held[0][0]) > _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["h", "n"])
                        held = []
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select(text).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def side_for(distinct: int) -> int:
    """Root of the number of token numbers, which grows with the root of the distinct tokens."""
    side = SIDE
    while side**4 < 4 * distinct:
        side *= 2
    return side


class Network:
    """Two-sided window network over token numbers; ``size`` stands for what lies outside a document."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, seed: int = 11):
        """``top``: hashes of the frequent tokens, most frequent first; ``counts``: by token number."""
        self.size, self.side = len(counts), math.isqrt(len(counts))
        self.counts, self.shared = counts, self.size // 4
        order = np.argsort(top)
        self.top, self.rank = top[order], order.astype(np.int32)
        rng = np.random.default_rng(seed)
        share = (counts + 0.5).reshape(self.side, self.side).T  # row: class (number % side); column: place in it
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = [normal(2 * REACH, self.size + 1, DIMENSIONS, scale=0.1), normal(DIMENSIONS, self.side, scale=0.25), np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
                        normal(DIMENSIONS, self.side, scale=0.25), np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = (h % np.uint64(self.shared)).astype(np.int32) + (self.size - self.shared)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
            known = self.top[at] == h
            out[known] = self.rank[at[known]]
        return out

    @staticmethod
    def around(number: np.ndarray, doc: np.ndarray, outside: int = SIZE) -> np.ndarray:
        """The numbers REACH places to either side of every token."""
        out = np.full((2 * REACH, len(number)), outside, np.int32)
        for row, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
            a, b = (slice(0, len(number) - abs(d)), slice(abs(d), len(number)))[:: -1 if d < 0 else 1]
            if len(number) > abs(d):
                same = doc[a] == doc[b]
                out[row, a] = np.where(same, number[b], outside)
        return out

    def _forward(self, around: np.ndarray, number: np.ndarray):
        """hidden, class and place of the tokens; per step (log-probability, exponentials of all logits, their sum)."""
        e, a, a0, b, b0 = self.weights
        hidden = e[0].take(around[0], axis=0)
        for k in range(1, len(around)):
            hidden += e[k].take(around[k], axis=0)
        np.tanh(hidden, out=hidden)
        kind, place = number % self.side, number // self.side
        row, steps = np.arange(len(number)), []
        for w, bias, of_row, target in ((a, a0, a0, kind), (b, b0, b0.take(kind, axis=0), place)):
            logits = hidden @ w
            logits += of_row
            # |hidden| < 1 bounds the logits; only where their exponentials could overflow is the largest taken off.
            if np.abs(w).sum(axis=0).max() + np.abs(bias).max() > 80:
                logits -= logits.max(axis=1, keepdims=True)
            wanted = logits[row, target]
            total = np.exp(logits, out=logits).sum(axis=1)
            steps.append((wanted - np.log(total), logits, total))
        return hidden, kind, place, steps

    def log_probabilities(self, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out, around = np.empty(len(number)), self.around(number, doc, self.size)
        for at in range(0, len(number), BATCH):
            part = slice(at, at + BATCH)
            _, _, _, ((first, _, _), (second, _, _)) = self._forward(around[:, part], number[part])
            out[part] = first + second
        return out

    def train(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> int:
        """One pass with Adam over blocks of (token numbers, documents); the number of tokens."""
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = tokens = 0
        for number, doc in blocks:
            tokens += len(number)
            around = self.around(number, doc, self.size)
            for at in range(0, len(number), BATCH):
                step += 1
                rate = np.float32(RATE / (1 - 0.9**step))
                least = np.float32(1 - 0.99**step)
                embedded, dense = self._gradients(around[:, at: at + BATCH], number[at: at + BATCH])
                # Of an embedding only the rows that the batch met move, so a step's cost does not grow with the vocabulary.
                for k, (rows, g) in enumerate(embedded):
                    m, v = (x[k].take(rows, axis=0) for x in moments[0])
                    self.weights[0][k][rows] -= self._adam(m, v, g, rate, least)
                    moments[0][0][k][rows], moments[0][1][k][rows] = m, v
                for w, (m, v), g in zip(self.weights[1:], moments[1:], dense):
                    w -= self._adam(m, v, g, rate, least)
        return tokens

    @staticmethod
    def _adam(m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: np.float32, least: np.float32) -> np.ndarray:
        """Moves the moments ``m`` and ``v``, and returns the step."""
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        return rate * m / (np.sqrt(v / least) + np.float32(1e-6))

    def _gradients(self, around: np.ndarray, number: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """Per place around the gap (embedding rows met, their gradients); the gradients of the other weights."""
        e, a, _, b, _ = self.weights
        hidden, kind, place, steps = self._forward(around, number)
        row, n = np.arange(len(number)), np.float32(len(number))
        p, q = (np.multiply(x, (1 / (total * n))[:, None], out=x) for _, x, total in steps)
        p[row, kind] -= 1 / n
        q[row, place] -= 1 / n
        back = (p @ a.T + q @ b.T) * (1 - hidden * hidden)

        def by_row(x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The distinct numbers of ``x`` and the sums of their rows of ``g``; small numbers are sorted by radix."""
            order = np.argsort(x.astype(np.uint16) if self.size < 1 << 16 else x, kind="stable")
            sorted_x = x.take(order)
            cuts = np.flatnonzero(np.diff(sorted_x, prepend=-1))
            return sorted_x[cuts], np.add.reduceat(g.take(order, axis=0), cuts, axis=0)

        biases = np.zeros((self.side, self.side), np.float32)
        kinds, sums = by_row(kind, q)
        biases[kinds] = sums
        return [by_row(x, back) for x in around], [hidden.T @ p, p.sum(axis=0), hidden.T @ q, biases]


def start_network(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> Network:
    """The vocabulary and a network that knows only how frequent each number is; ``counts`` as of ``token_counts``."""
    counts = materialize(token_counts(docs, text), "token_counts") if counts is None else counts
    size = side_for(counts.count()) ** 2
    shared = size // 4
    top = [(r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(size - shared).collect()]
    hashes = np.array([h for h, _ in top], np.int64).view(np.uint64)
    by_number = np.zeros(size)
    by_number[: len(top)] = [n for _, n in top]
    number = F.pmod(F.col("h"), F.lit(shared))  # shared divides 2**64, so the sign is no matter
    for r in counts.groupBy(number.alias("k")).agg(F.sum("n").alias("n")).collect():
        by_number[size - shared + r["k"]] = r["n"]
    # The frequent tokens have numbers of their own.
    np.subtract.at(by_number, size - shared + (hashes % np.uint64(shared)).astype(np.int64), by_number[: len(top)].copy())
    return Network(hashes, by_number)


class Shares:
    """The broadcast counts of the most frequent tokens, for the shares of tokens in their numbers."""

    def __init__(self, h: np.ndarray, n: np.ndarray, whole: bool):
        """``whole``: there are no other tokens in the corpus."""
        order = np.argsort(h)
        self.h, self.log, self.whole = h[order], np.log(n[order]).astype(np.float32), whole

    def logs(self, network: Network, h: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each token's share of its number; without its own count where ``True``."""
        out, left = np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.flatnonzero(number >= network.size - network.shared)
        listed = np.zeros(len(at), bool)
        count = np.full(len(at), math.log(UNSEEN) if self.whole else 0.0)
        if len(self.h):
            place = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            listed = self.h[place] == h[at]
            count[listed] = self.log[place[listed]]
        out[at] = count - np.log(network.counts[number[at]] + UNSEEN)
        left[at] = ~listed & (not self.whole)
        return out, left


def listed_shares(counts: DataFrame) -> tuple[Shares, DataFrame]:
    """The shares of at most ``LISTED`` tokens, and the counts of the rest."""
    total, least = 0, None
    # There are fewer different counts than the root of twice the corpus's tokens.
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).collect():
        if total + r["count"] > LISTED:
            break
        total, least = total + r["count"], r["n"]
    else:
        least = 0
    listed = counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)
    rest = counts.filter(F.col("n") < least) if least is not None else counts
    columns = listed.select("h", "n").toArrow()
    h, n = (columns.column(c).to_numpy() for c in ("h", "n"))
    return Shares(h.astype(np.int64).view(np.uint64), n.astype(np.float64), least == 0), rest


def train(docs: DataFrame, start: Network, text: str = "text") -> Network:
    """The average of the networks that the tasks train, each on all tokens of its documents."""
    shared = Shared(docs.sparkSession, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.load()

        def blocks():
            for batch in batches:
                for rows in slices(batch, text):
                    h, doc = token_hashes(rows, text)
                    yield network.numbers(h), doc

        if n := network.train(blocks()):
            flat = np.concatenate([w.ravel() for w in network.weights])
            yield parcels(TaskContext.get().partitionId(), {k: np.append(flat[at: at + CHUNK].astype(np.float64) * n, n) for k, at in enumerate(range(0, len(flat), CHUNK))})

    sums = summed(docs.select(text).mapInArrow(run, PARCELS), np.float64)
    if sums:
        flat, at = np.concatenate([sums[k][:-1] / sums[k][-1] for k in range(len(sums))]).astype(np.float32), 0
        for k, w in enumerate(start.weights):
            start.weights[k], at = flat[at: at + w.size].reshape(w.shape), at + w.size
    return start


_SCORES = "n_tokens bigint, log_prob double, mean_log_prob double"


def score(docs: DataFrame, network: Network, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every document.

    With the corpus's ``counts`` (as of ``token_counts``; read several times)
    the score is that of the tokens, without them that of their numbers.
    """
    shares, rest = listed_shares(counts) if counts is not None else (None, None)
    shared = Shared(docs.sparkSession, (network, shares))
    joined = shares is not None and not shares.whole
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {_SCORES}" + ", row bigint, h array<bigint>, times array<int>" * joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = shared.load()
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch, text):
                h, doc = token_hashes(rows, text)
                number, size = model.numbers(h), rows.num_rows
                logs = model.log_probabilities(number, doc)
                if shares is not None:
                    share, left = shares.logs(model, h, number)
                    logs = logs + share
                n = np.bincount(doc, minlength=size)
                total = np.bincount(doc, weights=logs, minlength=size)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                out = [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64()), mean]
                if joined:
                    out += [pa.array(np.arange(first, first + size)), *_by_document(h[left], doc[left], size)]
                    first += size
                yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.split(", ")])

    scores = docs.select("doc_id", text).mapInArrow(run, schema)
    if not joined:
        return scores
    scores = materialize(scores, "scores")  # rows keep their numbers
    asked = scores.select("row", F.explode(F.arrays_zip("h", "times")).alias("e")).select("row", "e.h", "e.times")
    log = F.round(F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN))) * _STEPS).cast("bigint")
    more = asked.join(rest, "h", "left").groupBy("row").agg((F.sum(F.col("times") * log) / _STEPS).alias("more"))
    scores = scores.drop("h", "times").join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return scores.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def _by_document(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
    """Per document: its distinct tokens, and how often it has each."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)])
    offsets = pa.array(np.searchsorted(doc[heads], np.arange(size + 1)), pa.int32())
    times = np.diff(np.append(heads, len(h))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(h[heads].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = materialize(token_counts(docs), "token_counts")
    return score(docs, train(docs, start_network(docs, counts=counts)), counts=counts)
