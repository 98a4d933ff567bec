import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletlens.llm import repeats as R

from .helpers import docs, sentence


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - R.LENGTH + 1):
            s = t[i: i + R.LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - R.LENGTH + 1):
            if seen[t[i: i + R.LENGTH]] > 1:
                gone[i: i + R.LENGTH] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(rest).hexdigest(), rest))
    return out


def got(spark, texts, parts=3, **kwargs):
    out = R.remove_repeats(docs(spark, texts, parts).withColumns({"chunk": F.lit("clash"), "kind": F.lit(1)}), **kwargs).collect()
    return [tuple(x) for x in sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in out)]


def test_the_cover_is_a_difference_set():
    assert {(a - b) % R.PERIOD for a in R.COVER for b in R.COVER} == set(range(R.PERIOD)) and len(R.COVER) * (len(R.COVER) - 1) == R.PERIOD - 1


@pytest.mark.parametrize("seed,chunk,bucket", [(1, R.CHUNK, R.BUCKET), (2, 2000, 50), (3, 300, 7)])
def test_equals_brute_force(spark, seed, chunk, bucket):
    rng = random.Random(seed)
    passages = [sentence(rng, n) for n in (20, 41, 42, 43, 60, 150)]
    texts = []
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(60)) for _ in range(rng.randrange(1, 4))]
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.randrange(0, 40)
            parts.insert(rng.randrange(len(parts) + 1), p[a:] if rng.random() < 0.5 else p)
        texts.append("é ".join(parts))
    base = sentence(rng, 120)
    texts += [base] * 8 + [base.replace(base.split()[k], "edit") for k in (3, 50, 50, 100)]
    texts += ["", None, "a" * 199, "b" * 199, "c" * 200, "c" * 200, "d" * 201, "ef" * 150, "short", "x" * 900 + base[:210]]
    want = plain(texts)
    assert sum(w[1] for w in want) > 5000
    assert got(spark, texts, chunk=chunk, bucket=bucket) == [(i, *w) for i, w in enumerate(want)]


def test_empty_table_and_missing_ids(spark):
    assert got(spark, []) == []
    same = spark.createDataFrame([(None, "q" * 250), (1, "z" * 10)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["n_removed"] for r in R.remove_repeats(same).collect()}
    assert out == {None: 250, 1: 0}


def test_contexts_of_a_class_keep_64_bits():
    """Contexts that agree in all but their last 24 bits are not tied."""
    rng = np.random.default_rng(5)
    buf = rng.integers(0, 256, 40_000).astype(np.uint8)
    s = R.Samples(buf, np.array([0, len(buf)]), 3)
    assert s.context.dtype == np.uint64 and (s.context >> np.uint64(40)).any()
    assert len(np.unique(s.context)) == len(s.context) > 3000


def test_near_equal_contexts_are_not_tied(spark):
    def entry(chunk, context):
        return 0, chunk, np.array([7], np.uint32).tobytes(), np.array([context], np.uint64).tobytes(), b"\0"

    entries = spark.createDataFrame([entry(k, c) for k, c in enumerate((1 << 62, (1 << 62) + 1, (1 << 63) + 1, (1 << 63) + 1))], R._ENTRIES)
    marks = {r["chunk"]: np.unpackbits(np.frombuffer(r["marks"], np.uint8))[:2].tolist() for r in R.rank_samples(entries).collect()}
    assert marks == {0: [0, 1], 1: [0, 1], 2: [1, 1], 3: [1, 0]}


def test_a_hot_passage_is_one_entry_a_chunk(spark, monkeypatch):
    """A passage just over LENGTH bytes, with other text around each copy: its strings are asked, not tied by context."""
    rng = random.Random(8)
    hot = sentence(rng, 80)[:230]
    texts = [sentence(rng, 60) + hot + sentence(rng, 60) if k % 3 == 0 else sentence(rng, 120) for k in range(240)]
    sent, sort = [], R.sort_strings
    monkeypatch.setattr(R, "sort_strings", lambda strings: sent.append(strings) or sort(strings))
    assert got(spark, texts, chunk=8000, bucket=200) == [(i, *w) for i, w in enumerate(plain(texts))]
    rows = [(r["bucket"], r["chunk"], np.frombuffer(r["hashes"], np.uint64)) for r in sent[0].collect()]
    chunks = len({c for _, c, _ in rows})
    entries = [h for _, c, x in rows for h in x.tolist()]
    copies = {h: entries.count(h) for h in set(entries)}
    assert 5 < chunks < 40 and max(copies.values()) <= chunks < 80
    per_chunk = [(c, h) for _, c, x in rows for h in x.tolist()]
    assert len(per_chunk) == len(set(per_chunk))
