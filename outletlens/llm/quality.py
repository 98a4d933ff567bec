"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Every token (a run of letters, of digits or of other characters) falls into
   one of ``BUCKETS`` buckets by its hash.  A bucket's index vector is sparse
   and ternary, drawn by hash.  Over the *whole* corpus a bucket's context
   vector sums the index vectors of the two neighbours on either side.  Sums
   are integers, so they do not depend on the order of tasks.
2. A bucket's word vector is its centred, scaled context vector beside its
   index vector.  A document is the mean and the spread of its tokens' vectors
   and the logarithm of its token count.
3. A two-layer network learns ``quality`` from at most ``TRAIN_ROWS`` labelled
   rows (those with the smallest hash of doc_id; the bound is a parameter).  A
   fifth of them only fits the temperature of the final probabilities.

The tasks hold one integer matrix of fixed size each; the matrices are summed
in two shuffled rounds, so no task reads one from every other.

Defined cases: null and empty texts have zero vectors and still get a score;
labels with a null ``doc_id`` or ``quality`` are not used; several labels of a
document count as their mean; without any label of one class, the score is the
mean label (0.5 without labels); repeated documents get the same score; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import PARCELS, Shared, free_names, parcels, slices, summed, table, utf8_column

BUCKETS = 1 << 13
#: Dimensions of the index vectors, and how many of them are not zero.
DIMENSIONS, NONZERO = 32, 6
#: Neighbours on either side.
REACH = 2
#: Labelled rows that the network may learn from.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 128, 4e-3
#: Scores from here on predict label 1 (fixed by the contract).
THRESHOLD = 0.7
_CHUNKS = 16
#: Tokens whose vectors are summed in one step.
_STEP = 1 << 16

_SPACE = ~W.NOT_SPACE
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, one per bucket, drawn from the bucket's number."""
    out = np.zeros((BUCKETS, DIMENSIONS), np.int32)
    rows = np.arange(BUCKETS)
    for k in range(NONZERO):
        draw = W.mix(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(2 * NONZERO + 1) + np.uint64(k + 1))
        out[rows, (draw % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(draw >> np.uint64(63), 1, -1)
    return out


def tokens(rows: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every token."""
    buf, offs = utf8_column(rows.column(text))
    parts = [W.spans(buf, offs, kind) for kind in (_LETTER, _DIGIT, ~(_LETTER | _DIGIT | _SPACE))]
    start = np.concatenate([p[0] for p in parts])
    order = np.argsort(start, kind="stable")
    start, end, doc = (np.concatenate([p[i] for p in parts])[order] for i in range(3))
    return (W.hashes(buf, start, end, lower=False) % np.uint64(BUCKETS)).astype(np.int64), doc


def _contexts(docs: DataFrame, text: str) -> DataFrame:
    """Per task and chunk of buckets: the summed context vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for batch in batches:
            for rows in slices(batch, text):
                bucket, doc = tokens(rows, text)
                for at in range(0, len(bucket), _STEP):
                    own = np.arange(at, min(at + _STEP, len(bucket)))
                    near = np.zeros((len(own), DIMENSIONS), np.int32)
                    for d in [*range(-REACH, 0), *range(1, REACH + 1)]:
                        other = np.clip(own + d, 0, len(bucket) - 1)
                        same = (other == own + d) & (doc[other] == doc[own])
                        near += index[bucket[other]] * same[:, None]
                    order = np.argsort(bucket[own], kind="stable")
                    sorted_ = bucket[own][order]
                    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                    sums[sorted_[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
        yield parcels(TaskContext.get().partitionId(), {c: x for c, x in enumerate(np.split(sums, _CHUNKS)) if x.any()})

    return docs.select(text).mapInArrow(run, PARCELS)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Word vector of each bucket: scaled context vector, index vector."""
    sums = np.zeros((_CHUNKS, BUCKETS // _CHUNKS * DIMENSIONS), np.int64)
    for chunk, x in summed(_contexts(docs, text), np.int64).items():
        sums[chunk] = x
    context = sums.reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    seen = norm[:, 0] > 0
    context -= context[seen].mean(axis=0) if seen.any() else 0
    return np.hstack([context * np.sqrt(DIMENSIONS), index_vectors()]).astype(np.float32)


def pooled(rows: pa.RecordBatch, text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each document's word vectors, and log of its token count."""
    bucket, doc = tokens(rows, text)
    n = np.bincount(doc, minlength=rows.num_rows).astype(np.float64)
    total, squares = np.zeros((2, rows.num_rows, vectors.shape[1]))
    for at in range(0, len(bucket), _STEP):
        d, x = doc[at: at + _STEP], vectors[bucket[at: at + _STEP]]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        total[d[first]] += np.add.reduceat(x, first, axis=0, dtype=np.float64)
        squares[d[first]] += np.add.reduceat(x * x, first, axis=0, dtype=np.float64)
    mean = total / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1)[:, None] - mean * mean, 0))
    return np.hstack([mean, spread, np.log1p(n)[:, None]])


class Network:
    """Two layers, trained with Adam; probabilities are divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.constant = len(y) < 10 or y.min() == y.max()
        if self.constant:
            return
        rng = np.random.default_rng(seed)
        hold = rng.permutation(len(y)) % 5 == 0
        if len(np.unique(y[hold])) < 2 or len(np.unique(y[~hold])) < 2:
            hold[:] = False
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        self._train(z[~hold], y[~hold], rng)
        fit_z, fit_y = (z[hold], y[hold]) if hold.any() else (z, y)
        logits = self._logits(fit_z)
        # Targets short of 0 and 1, so that separable rows do not ask for certainty.
        fit_y = np.where(fit_y > 0, (fit_y.sum() + 1) / (fit_y.sum() + 2), 1 / ((1 - fit_y).sum() + 2))
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, logits / t) - fit_y * logits / t) for t in grid])])

    def _train(self, z: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        p = self.p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                i = order[at: at + BATCH]
                h = np.maximum(z[i] @ p[0] + p[1], 0)
                error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(error, p[2]) * (h > 0)
                grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: Shared, rows: int = TRAIN_ROWS, label: str = "quality") -> Network:
    """The network fitted on at most ``rows`` labelled documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `rows` labels

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_vectors = vectors.load()
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled(part, "text", known_vectors).astype("<f8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    got = sorted(picked.mapInArrow(features, f"doc_id {dict(docs.dtypes)['doc_id']}, label double, x binary").dropDuplicates(["doc_id"]).collect())
    x = np.stack([np.frombuffer(r["x"], "<f8") for r in got]) if got else np.zeros((0, 1))
    return Network(x, np.array([float(r["label"] >= 0.5) for r in got]))


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1."""
    spark = docs.sparkSession
    vectors = Shared(spark, word_vectors(docs))  # BUCKETS x 2 * DIMENSIONS floats
    network = Shared(spark, train(docs, labels, vectors, rows, label))
    # Columns are numbered on the way, so their names do not matter.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = numbered.columns[docs.columns.index("text")]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_vectors, score_of = vectors.load(), network.load()
        for batch in batches:
            for part in slices(batch, text):
                score = score_of(pooled(part, text, known_vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])

    return numbered.mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*docs.columns, name)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to be of quality, with all their columns, whatever their names."""
    score, = free_names(docs, 1)
    return scored(docs, labels, name=score).filter(F.col(score) >= THRESHOLD).drop(score)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
