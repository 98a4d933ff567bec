import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outletlens.llm import lm_scoring as L
from outletlens.llm import quality as Q
from outletlens.llm.common import table

from ..conftest import SF001
from .helpers import docs, rows, sentence

LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_on_held_out_rows(spark):
    out = Q.op6_quality_classifier(spark, SF001)
    known = out.join(table(spark, SF001, "labels"), "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert out.count() == table(spark, SF001, "documents").count() and len(known) > 60
    right = sum(r["predicted"] == r["quality"] for r in known)
    assert right / len(known) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= Q.THRESHOLD) for r in known)
    assert 0 < -np.mean([np.log(r["score"] if r["quality"] else 1 - r["score"]) for r in known]) < 0.25


def test_quality_edge_cases(spark):
    rng = random.Random(4)
    texts = [sentence(rng, 40) if k % 2 else " | ".join(sentence(rng, 30).split(" ")) for k in range(120)] + [None, "", " ", "x" * 300_000, "9"]
    df = docs(spark, texts).withColumns({"label": F.lit("clash"), "score": F.lit("clash"), "x": F.lit(1)})
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(None, 1, 0), (3, None, 0), (5, 1, 0), (10**6, 0, 1)], LABELS)
    got = rows(Q.scored(df.select("doc_id", "text"), labels))
    held = [k for k in range(120) if __import__("zlib").crc32(str(k).encode()) % 4 == 2]
    assert len(got) == 125 and all((got[k]["score"] >= 0.5) == k % 2 for k in held)
    assert got[120]["score"] == got[121]["score"] == got[122]["score"]
    assert Q.good(df, labels).columns == df.columns
    assert {r["score"] for r in Q.scored(df.select("doc_id", "text"), labels.limit(0)).collect()} == {0.5}
    assert Q.scored(docs(spark, []), labels).count() == 0


def test_quality_scores_do_not_see_held_out_labels(spark):
    df = table(spark, SF001, "documents").limit(300)
    labels = table(spark, SF001, "labels")
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (rows(Q.scored(df.select("doc_id", "text"), x)) for x in (labels, turned))
    assert all(abs(a[k]["score"] - b[k]["score"]) < 1e-9 for k in a)


def test_network_gives_probabilities():
    rng = np.random.default_rng(2)
    net = L.Network(np.arange(1, 40, dtype=np.uint64), rng.integers(0, 50, L.SIZE).astype(float))
    number, doc = rng.integers(0, L.SIZE, 50), np.repeat([0, 1], 25)
    net.train(iter([(number, doc)]))
    around = net.around(number[:1], doc[:1])
    every = sum(np.exp(first[0] + second[0]) for k in range(L.SIZE)
                for *_, ((first, *_), (second, *_)) in [net._forward(around, np.array([k]))])
    assert abs(every - 1) < 1e-4


def test_around_stays_inside_documents():
    number, doc = np.array([1, 2, 3, 4, 5]), np.array([0, 0, 0, 1, 1])
    s = L.SIZE
    assert L.Network.around(number, doc).T.tolist() == [[s, s, 2, 3], [s, 1, 3, s], [1, 2, s, s], [s, s, 5, s], [s, 4, s, s]]
    assert L.Network.around(number[:1], doc[:1]).T.tolist() == [[s] * 4]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = L.Network(np.arange(1, 40, dtype=np.uint64), np.ones(L.SIZE))
    net.weights = [w.astype(np.float64) for w in net.weights]
    number, doc = rng.integers(0, L.SIZE, 30), np.repeat([0, 1, 2], 10)
    around = net.around(number, doc)
    embedded, dense = net._gradients(around, number)
    grads = [np.zeros_like(net.weights[0]), *dense]
    for k, (rows, g) in enumerate(embedded):
        assert len(set(rows.tolist())) == len(rows)
        grads[0][k][rows] = g
    for k, w in enumerate(net.weights):
        used = np.argwhere(np.abs(grads[k]) > 1e-6)
        for at in map(tuple, used[rng.integers(0, len(used), 5)]):
            old, loss = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                loss.append(-net.log_probabilities(number, doc).mean())
            w[at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - grads[k][at]) < 1e-5


def test_lm_scores(spark):
    df = table(spark, SF001, "documents")
    start = L.start_network(df)
    before = L.score(df, start).agg(F.sum("log_prob")).first()[0]
    trained = L.train(df, start)
    got = L.score(df, trained)
    total = got.agg(F.sum("log_prob").alias("p"), F.sum("n_tokens").alias("n")).first()
    assert total["p"] > before + 0.05 * total["n"]
    # Brute force: token by token.
    for r in df.filter("length(text) < 400").limit(3).collect():
        import pyarrow as pa

        h, doc = L.token_hashes(pa.RecordBatch.from_arrays([pa.array([r["text"]])], ["text"]), "text")
        number = trained.numbers(h)
        padded = [L.SIZE] * L.REACH + number.tolist() + [L.SIZE] * L.REACH
        e, a, a0, b, b0 = trained.weights
        plain = 0.0
        for i, x in enumerate(number):
            near = padded[i: i + L.REACH] + padded[i + L.REACH + 1: i + 2 * L.REACH + 1]
            hidden = np.tanh(sum(e[k][w] for k, w in enumerate(near)))
            for logits, target in ((hidden @ a + a0, x % L.SIDE), (hidden @ b + b0[x % L.SIDE], x // L.SIDE)):
                plain += logits[target] - np.log(np.exp(logits).sum())
        assert abs(plain - got.filter(F.col("doc_id") == r["doc_id"]).first()["log_prob"]) < 1e-2


def test_lm_counts_and_edge_cases(spark):
    counts = {r["n"] for r in L.token_counts(docs(spark, ["a b a", None, "", "A, b"])).collect()}
    assert counts == {3, 2, 1}
    df = docs(spark, [None, "", "word", "a b c " * 50_000]).withColumn("n_tokens", F.lit("clash"))
    got = rows(L.score(df, L.train(df, L.start_network(df))))
    assert [(got[k]["n_tokens"], got[k]["log_prob"], got[k]["mean_log_prob"]) for k in (0, 1)] == [(0, 0.0, None)] * 2
    assert got[2]["n_tokens"] == 1 and got[3]["n_tokens"] == 150_000 and got[3]["log_prob"] < 0
    empty = docs(spark, [])
    assert L.score(empty, L.train(empty, L.start_network(empty))).count() == 0


@pytest.mark.parametrize("listed", [L.LISTED, 5, 0])
def test_lm_scores_are_those_of_tokens_not_of_their_numbers(spark, listed, monkeypatch):
    """1 500 tokens share numbers; each has its own share of its number, and unseen ones share half an occurrence."""
    monkeypatch.setattr(L, "LISTED", listed)
    words = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(2000)]
    corpus = docs(spark, [" ".join(w for w in words[:1500 + k % 500] for _ in range(1 + (len(w) > 3 and w[-1] < "d"))) for k in range(4)])
    counts = L.token_counts(corpus)
    net = L.start_network(corpus, counts=counts)
    n = {r["h"] % 2**64: r["n"] for r in counts.collect()}
    texts = [words[1999], "unseenword", f"{words[1500]} {words[3]} unseenword {words[1500]}", None, words[1999]]
    new = docs(spark, texts)
    plain, got = rows(L.score(new, net)), rows(L.score(new, net, counts=counts))
    for k, t in enumerate(texts):
        h, _ = L.token_hashes(pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"]), "text")
        share = sum(np.log(n.get(int(x), 0.5) / (net.counts[i] + 0.5)) for x, i in zip(h, net.numbers(h)) if i >= L.TOP)
        assert abs(got[k]["log_prob"] - plain[k]["log_prob"] - share) < 1e-4
        assert got[k]["n_tokens"] == plain[k]["n_tokens"] and (t is None or abs(got[k]["mean_log_prob"] * len(h) - got[k]["log_prob"]) < 1e-9)
    assert got[1]["log_prob"] < plain[1]["log_prob"] - 1 and got[3]["mean_log_prob"] is None and got[0][2:] == got[4][2:]
    # All tokens of a number and the unseen ones have the whole of it.
    of = {}
    for x, i in zip(n, net.numbers(np.array(list(n), np.uint64))):
        of[i] = of.get(i, 0) + n[x]
    assert all(net.counts[i] == c for i, c in of.items())


def test_lm_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    assert [L.side_for(d) for d in (0, 262_144, 262_145, 5_000_000)] == [32, 32, 64, 128]
    monkeypatch.setattr(L, "side_for", lambda distinct: 64)
    df = docs(spark, ["".join(chr(97 + int(c)) for c in str(k)) + " and more" for k in range(5000)])
    net = L.start_network(df)
    assert len(net.top) == 3072 and net.counts.sum() == 15_000
    got = L.score(df, L.train(df, net)).agg(F.sum("n_tokens"), F.sum("log_prob")).first()
    assert got[0] == 15_000 and got[1] < 0
