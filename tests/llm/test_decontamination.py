import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from outletlens.llm import decontamination as D

from .helpers import LOWER, alnum_words, docs, sentence

ITEMS = "item_id bigint, text string"


def plain(texts, items, window=13):
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        if w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k: k + n]), set()).update(() if i is None else (str(i),))
    out = []
    for d, t in enumerate(texts):
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k: k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def corpus(seed, short):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randrange(13, 40), 60)) for i in range(30)] + [(100, None), (101, " .,"), (None, sentence(rng, 15, 60)), (7, sentence(rng, 14, 60))]
    items += [(200, items[3][1]), (201, items[4][1].upper() + "!")]
    items += [(300 + n, sentence(rng, n, 60)) for n in short]
    texts = [None, "", "-", items[0][1], "é " + items[1][1].replace(" ", "--").upper()]
    for _ in range(60):
        t = sentence(rng, rng.randrange(150), 60).split(" ")
        for _, x in rng.sample(items, rng.randrange(3)):
            w = (x or "").split(" ")
            a = rng.randrange(len(w))
            t[rng.randrange(len(t) + 1):0] = w[a: a + rng.randrange(10, 30)]
        texts.append(" ".join(t))
    return texts, items


@pytest.mark.parametrize("seed,short,shard_bytes", [(1, [], D.SHARD_BYTES), (2, [3, 5, 12], D.SHARD_BYTES), (3, [1, 2], 900), (4, [4], 400)])
def test_equals_brute_force(spark, seed, short, shard_bytes):
    texts, items = corpus(seed, short)
    df = docs(spark, texts).withColumns({"n_words": F.lit("clash"), "__x": F.lit(1)})
    got = D.judge(df, spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain(texts, items)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    for r in got.collect():
        assert sum(b - a for a, b in zip(r["hits"][::2], r["hits"][1::2])) == r["n_hit"]
    clean = D.clean(df, spark.createDataFrame(items, ITEMS))
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [w[0] for w in want if not w[5]]


def plain_cut(texts, items, longest, share, window=13):
    windows = {tuple(w[k: k + min(window, len(w))]) for _, t in items for w in [alnum_words(t)] for k in range(max(1, len(w) - window + 1)) if w}
    out = []
    for t in texts:
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
        w, hit = [m.group() for m in found], [False] * len(found)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in windows:
                    hit[k: k + n] = [True] * n
        over, left, k = share * sum(hit) >= len(w), t, len(w)
        while k > 0:
            end = k
            while k > 0 and hit[k - 1]:
                k -= 1
            if end > k and (over or end - k > longest):
                left = left[: found[k].start()] + left[found[end - 1].end():]
            k -= k == end
        out.append(left)
    return out


@pytest.mark.parametrize("longest,share,shard_bytes", [(13, 20, D.SHARD_BYTES), (18, 3, 700), (0, 1, D.SHARD_BYTES), (1000, 1, 900)])
def test_removed_spans_equal_brute_force(spark, longest, share, shard_bytes):
    texts, items = corpus(longest + share, [4])
    texts += ["Ünï " + items[2][1].title() + " ...  tail\n" + " ".join(f"z{k}" for k in range(400)), items[2][1] + "; " + items[5][1]]
    df = docs(spark, texts).withColumns({"__hits": F.lit("clash"), "a.b": F.lit(1), "c0": F.lit(2)})
    got = D.remove_spans(df, spark.createDataFrame(items, ITEMS), longest=longest, share=share, shard_bytes=shard_bytes)
    assert got.columns == df.columns
    want = plain_cut(texts, items, longest, share)
    assert {r["doc_id"]: (r["text"], r["__hits"], r["a.b"], r["c0"]) for r in got.collect()} == {d: (t, "clash", 1, 2) for d, t in enumerate(want)}
    assert want != texts or longest == 1000
    assert D.remove_spans(docs(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0


def test_every_shard_holds_its_share_of_the_items(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, 30)) for k in range(300)] * 2
    size = sum(len(t) for _, t in items[:300])
    built = D.automata(spark.createDataFrame(items, ITEMS), shard_bytes=size // 10)
    shards = [D._load(built, r["shard"]) for r in built.select("shard").collect()]
    assert len(shards) >= 10
    held = [len(set().union(*(i for ends in s.ends.values() for i in ends.values()))) for s in shards]
    assert sum(held) == 300 and max(held) < 90


def test_empty_tables_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, sentence(random.Random(1), 20))], ITEMS)
    assert D.judge(docs(spark, []), items).count() == 0
    got = D.judge(docs(spark, ["a b c", None]), items.limit(0)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(0, 3, 0, False), (1, 0, 0, False)]
    twice = spark.createDataFrame([(None, sentence(random.Random(1), 20))] * 2, "doc_id bigint, text string")
    assert [r["contaminated"] for r in D.judge(twice, items).collect()] == [True, True]


def test_automaton_holds_longest_matches():
    rng = random.Random(9)
    items = [(str(k), sentence(rng, rng.randrange(1, 30), 5)) for k in range(40)]
    automaton = D.Automaton(items, 13)
    word = {w: i for i, w in enumerate(sorted({w for _, t in items for w in t.split(" ")}))}
    number = {}
    import numpy as np
    import pyarrow as pa

    from outletlens.llm import words as W
    from outletlens.llm.common import utf8_column
    for w in word:
        buf, offs = utf8_column(pa.array([w]))
        number[w] = int(np.searchsorted(automaton.known, W.hashes(buf, *W.spans(buf, offs, W.ALNUM)[:2])[0]))
    joined = [f" {t} " for _, t in items]
    stream, state, at = sentence(rng, 300, 5).split(" "), 0, 0
    for i, w in enumerate(stream):
        if w not in number:
            state, at = 0, 0
            continue
        state, at = automaton.step(state, at, number[w])
        best = next(n for n in range(min(i + 1, 30), -1, -1) if n == 0 or any(f" {' '.join(stream[i + 1 - n: i + 1])} " in t for t in joined))
        assert at == best
