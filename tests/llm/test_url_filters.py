import random

import pytest
from pyspark.sql import functions as F

from outletlens.llm import url_filters as U

SCHEMA = "page_id bigint, url string"


def plain(rows, rules):
    parsed = []
    for page_id, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:cut].translate(str.maketrans(U._UPPER, U._LOWER)), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        best = None
        for verdict, rule in rules:
            at = rule.index("/")
            if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        parsed.append((page_id, host, path, best))
    counts = {}
    for _, host, _, best in parsed:
        n, b = counts.get(host, (0, 0))
        counts[host] = (n + 1, b + bool(best and best[0] == "block"))
    return sorted((p, h, x, best and best[1], best[0] if best else "block" if h and 2 * counts[h][1] > counts[h][0] else "allow") for p, h, x, best in parsed)


def got(df):
    return sorted(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())


@pytest.mark.parametrize("shard_bytes", [U.SHARD_BYTES, 40])
def test_judge_equals_plain_rules(spark, shard_bytes):
    rng = random.Random(3)
    hosts = ["example.org", "A.Example.org", "xexample.org", "org", "b.com", "m.b.com", "c.net", "com", "", "é.com", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123", "/en/2", "/fr/9", "/de/7", "/de", "/x?y=/de/", "?/es/", "#/es/"]
    rows = [(i, rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(paths)) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "no scheme/de/"), (903, "a://b.com/de/://x.org/"), (904, "http://b.com/de/\n7"), (905, "http://b.com/de/1"), (905, "http://b.com/de/1")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_keys", F.lit("clash")).withColumn("host", F.lit("clash"))
    assert got(U.judge(df, U.RULES, shard_bytes)) == plain(rows, U.RULES)


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = keys.filter(F.col("key").endswith("7"))
    for shard_bytes in (U.SHARD_BYTES, 600):
        cascade = U.build(listed, keys, shard_bytes)
        assert len(cascade) > 1 or shard_bytes > 600
        assert any(len(c.levels) > 1 for c in cascade)
        out = U.member(keys.select("key", F.array("key").alias("k")), "k", cascade, "hit").select("key", F.col("hit")[0].alias("hit"))
        assert out.filter("hit <> endswith(key, '7')").count() == 0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(U.judge(empty, U.RULES)) == []
    assert got(U.judge(spark.createDataFrame([(1, "http://a.org/")], SCHEMA), [])) == [(1, "a.org", "/", None, "allow")]
