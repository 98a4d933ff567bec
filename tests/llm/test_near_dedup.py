import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletlens.llm import near_dedup as N
from outletlens.llm.components import components

from .helpers import docs, sentence, words


def shingles(text, n=2):
    w = words(text)
    return frozenset(tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain(texts, percent=80, n=2):
    sets, parent = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def got(spark, texts, **kwargs):
    df = docs(spark, texts, 4).withColumns({"n_shingles": F.lit("clash"), "id": F.lit(0)})
    return sorted(tuple(r) for r in N.near_dedup(df, **kwargs).select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\tWORDS", "aa aa aa aa", "aa aa"]
    for _ in range(25):
        base = sentence(rng, rng.randrange(20, 120))
        texts += [base] + [edited(rng, base, rng.randrange(0, 9)) for _ in range(rng.randrange(4))]
    hot = sentence(rng, 60)
    texts += [hot] * 30 + [edited(rng, hot, rng.randrange(1, 5)) for _ in range(60)]
    chain = sentence(rng, 60)
    for _ in range(12):  # neighbours are linked, the ends are not
        texts.append(chain)
        chain = edited(rng, chain, 2)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,leaf", [(1, N.LEAF), (2, 3)])
def test_equals_brute_force(spark, seed, leaf, monkeypatch):
    monkeypatch.setattr(N, "LEAF", leaf)
    texts = corpus(seed)
    assert got(spark, texts) == plain(texts)


def test_five_word_shingles_and_other_thresholds(spark):
    texts = corpus(3)[:90]
    assert got(spark, texts, percent=60, words=5) == plain(texts, 60, 5)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (9, "a b  c D"), (None, "a b c d"), (2, "x")], "doc_id bigint, text string").withColumn("__x", F.lit(1))
    assert sorted(map(str, N.near_dedup(df).collect())) == sorted(map(str, spark.createDataFrame(
        [(4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (None, 3, None, True), (2, 1, 2, True)], "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean").collect()))
    stay = N.one_each(df)
    assert stay.columns == ["doc_id", "text", "__x"] and sorted(str(r["doc_id"]) for r in stay.collect()) == ["2", "4", "4", "None"]
    assert N.near_dedup(docs(spark, [])).count() == 0


def test_planned_trees_reach_the_recall():
    for n in (1, 1000, 10**9):
        depth, trees = N.plan_trees(n)
        rng, met = np.random.default_rng(5), 0
        for _ in range(20000):  # the branching process of a pair at the threshold
            alive = 1
            for _ in range(depth):
                alive = rng.binomial(alive + rng.binomial(alive, 0.25), 0.8)
            met += alive > 0
        assert 1 - (1 - met / 20000) ** trees > 0.9995


def test_path_keys_agree_for_equal_tokens_only():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2**32, (3, N.POSITIONS), dtype=np.uint32)
    t[1] = t[0]
    row, key = N.path_keys(t, 4, 11, 0.25)
    a, b, c = (set(key[row == k].tolist()) for k in range(3))
    assert a == b and a and not a & c


def test_components_of_a_star_a_path_and_a_ring(spark):
    links = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000 + k, 2000 + (k + 1) % 9) for k in range(9)] + [(5000, 5000), (3, 1)]
    got_ = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got_ == {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1061)} | {k: 2000 for k in range(2000, 2009)}


def star(rng, n, distance=3):
    """Near copies of one text that are no near copies of each other: each has edits of its own."""
    base = sentence(rng, 30)
    return [base] + [edited(rng, base, distance) for _ in range(n)]


def test_a_large_node_of_unconnected_near_copies(spark, monkeypatch):
    """Texts that share most words in one heavy node: links and groups are those of all pairs."""
    monkeypatch.setattr(N, "LEAF", 16)
    rng = random.Random(11)
    texts = star(rng, 150) + star(rng, 40, 1)
    rng.shuffle(texts)
    assert got(spark, texts) == plain(texts)


def test_candidate_lists_are_linear(spark):
    """A node whose classes are all alike by their tokens, and none connected: one pair a class at most."""
    tokens = bytes(range(128))
    rows = [(7, 0, 0, side, i, i, tokens) for i in range(200) for side in (0, 1)]
    blocks = spark.createDataFrame(rows, "node bigint, i int, j int, side int, id bigint, component bigint, tokens binary")
    assert N._compared(blocks, 80, exhaustive=False).count() <= 200


def test_repeated_ids_with_different_texts(spark):
    """Each row is judged by its own text; only its own text's group can drop it."""
    rng = random.Random(5)
    a, b, c = (sentence(rng, 50) for _ in range(3))
    rows = [(1, a), (9, edited(rng, a, 1)), (9, b), (9, b), (4, edited(rng, b, 1)), (9, c), (12, None), (12, c)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(df).collect())
    want = [(1, a, 1), (9, rows[1][1], 1), (9, b, 4), (9, b, 4), (4, rows[4][1], 4), (9, c, 9), (12, None, 12), (12, c, 9)]
    assert found == sorted((d, len(shingles(t)), k, d == k) for d, t, k in want)
    kept = sorted((r.doc_id, r.text) for r in N.one_each(df).collect() if r.text is not None)
    assert kept == sorted([(1, a), (4, rows[4][1]), (9, c)])


def test_recall_of_links_for_every_twentieth_id(spark):
    """Of the links that brute force finds for ids divisible by 20, at least 0.999 lie within a component."""
    from ..conftest import SF001
    rows = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    component = {r.doc_id: r.component_id for r in N.op5_minhash_near_dedup(spark, SF001).collect()}
    links = [(q, d) for q in rows if q % 20 == 0 and rows[q] for d in rows if d != q and rows[d] and 100 * len(rows[q] & rows[d]) >= 80 * len(rows[q] | rows[d])]
    assert links and sum(component[a] == component[b] for a, b in links) >= 0.999 * len(links)
