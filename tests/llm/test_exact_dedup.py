import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from outletlens.llm import exact_dedup as E
from outletlens.llm.common import join_groups

from .helpers import docs, rows


def plain(pairs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in pairs:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t in pairs:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts,fan_in,heavy", [(1, 16, 4096), (9, 2, 4096), (9, 2, 3)])
def test_equals_brute_force(spark, parts, fan_in, heavy):
    rng = random.Random(parts)
    texts = [None, "", " \t\n", "a", "a ", " a\x0b\x0c\r", "é漢 x", "é漢x", " a", "A"]
    texts += [" ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5))) + " " * rng.randrange(3) for _ in range(150)] + ["hot"] * 120
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    df = docs(spark, texts, parts).withColumns({"_run": F.lit("clash"), "keep_id": F.lit(0)})
    got = [tuple(r) for r in E.exact_dedup(df, fan_in=fan_in, heavy=heavy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got) == plain(pairs)
    assert sorted(r["doc_id"] for r in E.kept_rows(df).collect()) == [r[0] for r in plain(pairs) if r[3]]


def test_repeated_rows_missing_ids_and_columns(spark):
    df = spark.createDataFrame([(5, "a b", 1), (5, "a b", 1), (7, "ab", 2), (None, "a  b", 3), (None, "alone", 4), (5, "other", 5)], "doc_id bigint, text string, _sha int")
    got = sorted(E.exact_dedup(df).collect(), key=str)
    # The longest spelling is kept even without an id.
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["group_size"] > 1} == {(5, None, 4, False), (7, None, 4, False), (None, None, 4, True)}
    kept = E.kept_rows(df.filter("text <> 'a  b'").drop("_sha").withColumn("gone", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "gone"]
    assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == [("a b", 5), ("alone", None), ("other", 5)]


def test_empty_table_and_no_python(spark):
    assert E.exact_dedup(docs(spark, [])).count() == 0 and E.kept_rows(docs(spark, [])).count() == 0
    plan = E.exact_dedup(docs(spark, ["a", "a", "b"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_join_groups_keeps_every_row(spark):
    left = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(200)], "g int, k int")
    groups = left.filter("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"))
    for heavy in (1, 6, 4096):
        out = join_groups(left, groups.filter("n > 1"), ["g"], "n", 200, heavy)
        assert rows(out.withColumnRenamed("k", "doc_id")).keys() == set(range(200))
        assert out.filter("(g IS NULL) <> (n IS NULL)").count() == 0


def test_merge_levels_hold_one_row_per_run_and_digest(spark):
    runs = E.digest_runs(docs(spark, ["same"] * 90 + ["x"], 6))
    one = E.tree_merge(runs, 6, 2).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in one) == [(0, 90), (90, 1)]
