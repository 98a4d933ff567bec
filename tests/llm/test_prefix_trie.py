"""Conversation prefix trie: equal to brute force over all prefixes, in one shard and in many."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from outletlens.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """conv_id -> [(role, text)] after the run's first turns were shared (turns must not tie)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    return out


def expected(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * words
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()), key=repr)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def trie(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    return T.prefix_trie(T.shared_heads(T.sequences(df)), **how)


def talks(seed=1, n=300, deep=9):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n * 2), n):
        for turn in range(rng.randrange(1, deep)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice([None, "", "a b", "hello  there you", "x", f"only {c}"] if rng.random() < 0.9 else [f"t {c} {turn}"])))
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_turns": 40}, {"shard_turns": 25, "columns": 2}, {"columns": 1}])
def test_equals_brute_force(spark, how):
    rows = talks()
    assert got(trie(spark, rows, **how)) == expected(rows)


def test_hot_conversation_over_many_shards(spark, monkeypatch):
    """A third of all conversations are one: its nodes are boundary nodes of many shards, its ids lie in many runs."""
    monkeypatch.setattr(T, "RUN_IDS", 7)
    rows = [(1000 + 20 * i, t, "user", "the same first words" if t == 0 else f"turn {t}") for i in range(200) for t in range(4)] + talks(2, 250)
    assert got(trie(spark, rows, shard_turns=60, columns=3)) == expected(rows)


def test_long_conversations_do_not_widen_the_others(spark):
    rows = talks(3, 60) + [(c, t, "user", f"long {t if t < 900 or c < 5000 else c}") for c in (4000, 5020, 6040) for t in range(1500 + c % 3000)]
    convs = rebuilt(rows)
    assert max(map(len, convs.values())) > 3000
    out = got(trie(spark, rows, shard_turns=2000))
    assert [r[:7] for r in out] == [r[:7] for r in sampled_expected(rows)]


def sampled_expected(rows):
    """As ``expected``, with paths named by their digests: long paths are too many to keep."""
    convs = rebuilt(rows)
    info, up = {}, {}
    for c, turns in convs.items():
        h = hashlib.sha256()
        name = h.digest()
        for d in range(len(turns) + 1):
            if d:
                h.update(repr(turns[d - 1]).encode())
                up[h.digest()] = name
                name = h.digest()
            node = info.setdefault(name, {"d": d, "m": [], "w": len(re.findall(r"[^\x20\x09-\x0D]+", turns[d - 1][1])) if d else 0, "ends": [], "kids": 0, "leaves": 0, "saved": 0})
            node["m"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    for name in sorted(info, key=lambda n: -info[n]["d"]):
        node = info[name]
        node["leaves"] += not node["kids"]
        node["saved"] += (len(node["m"]) - 1) * node["w"]
        if name in up:
            info[up[name]]["kids"] += 1
            info[up[name]]["leaves"] += node["leaves"]
            info[up[name]]["saved"] += node["saved"]
    return sorted(((min(x["m"]), x["d"], min(info[up[n]]["m"]) if n in up else None, len(x["m"]), x["kids"], x["leaves"], x["saved"],
                    hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()) for n, x in info.items()), key=repr)


def test_nulls_repeats_turnless_and_clashing_columns(spark):
    rows = [(21, None, "user", "first"), (21, 3, None, None), (21, 5, "bot", "z  z"), (20, 0, "user", None), (40, 1, "", ""), (41, -2, "user", "minus"), (41, 7, "user", "seven"),
            (None, 0, "user", "nobody's"), (-20, 0, "a", "b c"), (-3, 1, "a", "b c"), (1, 0, "u", "gone")]
    want = expected(rows)
    assert got(trie(spark, rows)) == want
    assert any(r[1] == 0 and r[7] != T.EMPTY_SHA for r in want) == any(not t for t in rebuilt(rows).values())
    clash = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("?").alias(c) for c in ("turns", "t", "first", "h", "head", "path", "words", "node", "depth", "a.b")])
    assert got(T.prefix_trie(T.shared_heads(T.sequences(clash)))) == want
    # Rows that tie in everything are turns of their own.
    twice = got(trie(spark, [(20, 1, "u", "same"), (20, 1, "u", "same")]))
    assert [(r[1], r[3], r[4], r[5]) for r in twice] == [(0, 1, 1, 1), (1, 1, 1, 1), (2, 1, 0, 1)]


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(20, 0, "ab", "c"), (40, 0, "a", "bc"), (60, 0, "ab", "c")]
    assert got(trie(spark, rows)) == expected(rows)


def test_only_turnless_conversations_and_none(spark):
    lost = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4][:9]
    rows = [(c, 0, "user", "replaced by nothing") for c in lost]
    assert got(trie(spark, rows, shard_turns=3)) == expected(rows)
    assert got(trie(spark, [])) == []
