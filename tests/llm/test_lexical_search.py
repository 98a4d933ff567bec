"""Ranked lexical search: equal to scoring every document, and less read where the best stand out."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from outletlens.llm import lexical_search as S

from . import helpers as H


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(H.LOWER))


def expected(docs, items, top=10):
    """[(item_id, rank, doc_id, score)] of (id, text) rows."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 75 + (75 * c.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, H.DOCS).repartition(3) if docs else spark.createDataFrame([], H.DOCS),
            spark.createDataFrame(items, "item_id bigint, text string"))


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    draw = lambda k: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(k))
    docs = [(i, draw(rng.randrange(1, 120))) for i in range(n)]
    items = [(i, draw(rng.randrange(1, 40))) for i in range(30)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    docs += [(900, None), (901, ""), (902, "... !?"), (903, "É Ünï w1 W1, w1;w2"), (904, docs[0][1]), (905, docs[0][1]), (906, H.sentence(random.Random(2), 40000, 300))]
    items += [(77, None), (78, "!"), (79, "nowhere"), (80, "É w1 é Ünï ünï"), (81, "W1 w1 w1 w2")]
    assert got(S.lexical_search(*frames(spark, docs, items))) == expected(docs, items)


def test_small_blocks_and_rounds(spark, monkeypatch):
    """Many blocks a task and one item a round give the same rows."""
    docs, items = corpus(6, 150)
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 64)
    monkeypatch.setattr(S, "BLOCK_DOCS", 7)
    want = expected(docs, items[:8])
    assert got(S.lexical_search(*frames(spark, docs, items[:8]))) == want
    assert [len(r.ids) for r in S.item_rounds(frames(spark, docs, items[:8])[1], 1)] == [1] * 8


def test_ties_repeats_nulls_and_clashing_columns(spark):
    docs = [(i, "same words here") for i in (9, 4, 4, 30, 2, 17, 5, 6, 7, 8, 11, 12)] + [(None, "same words here"), (1, "other")]
    items = [(1, "same"), (1, "words"), (None, "here same"), (2, "other")]
    d, i = frames(spark, docs, items)
    clash = ["n", "terms", "tfs", "item", "score", "rank", "a.b"]
    d, i = (x.select("*", *[F.lit(0).alias(c) for c in clash + extra]) for x, extra in ((d, ["item_id"]), (i, ["doc_id"])))
    assert got(S.lexical_search(d, i)) == expected(docs, items)
    docs = docs[-3:]
    assert got(S.lexical_search(*frames(spark, docs, items))) == expected(docs, items)


def test_a_term_in_a_third_of_all_documents(spark):
    docs = [(i, "common " * (1 + i % 5) + f"t{i}" if i % 3 == 0 else f"t{i} u{i % 7}") for i in range(3000)]
    items = [(1, "common"), (2, "common t2999 u3"), (3, "t0 t1 t2")]
    assert got(S.lexical_search(*frames(spark, docs, items))) == expected(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(7, 5)
    assert S.lexical_search(*frames(spark, [], items)).count() == 0
    assert S.lexical_search(frames(spark, docs, items)[0], spark.createDataFrame([], "item_id string, text string")).count() == 0


def nra_case(rng, docs, lists):
    out = []
    for _ in range(lists):
        at = rng.permutation(docs)[: rng.integers(1, docs)]
        value = np.sort(rng.integers(1, rng.integers(2, 1000), len(at)))[::-1]
        at = at[np.lexsort((at, -value))]
        out.append((at, value))
    return out


def test_nra_equals_full_scores():
    rng = np.random.default_rng(4)
    for _ in range(200):
        docs = int(rng.integers(1, 400))
        lists = nra_case(rng, docs, int(rng.integers(1, 9))) if docs > 1 else [(np.array([0]), np.array([5]))]
        scores = np.zeros(docs, np.int64)
        for at, value in lists:
            scores[at] += value
        want = [d for d in np.lexsort((np.arange(docs), -scores))[:10] if scores[d] > 0]
        doc, score, _ = S.nra(lists, docs, step=int(rng.integers(1, 9)))
        assert doc.tolist() == want and score.tolist() == scores[want].tolist()
        bar = int(scores.max()) // 2
        doc, score, _ = S.nra(lists, docs, bar)
        assert doc.tolist() == [d for d in want if scores[d] >= max(bar, 1)]


def test_nra_stops_early_where_the_best_stand_out():
    docs, n = 100_000, 4
    at = np.arange(docs)
    value = np.maximum(1, 10**6 // (at + 1))
    doc, _, read = S.nra([(at, value)] * n, docs)
    assert doc.tolist() == list(range(10)) and read < docs * n / 100
