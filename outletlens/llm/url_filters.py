"""URL filters: allow and block rules looked up in Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe, here
all keys that occur in the corpus.  Level 0 encodes the listed keys; level 1
encodes the other keys that level 0 wrongly passes; level 2 the listed keys
that level 1 wrongly passes, and so on, until a level has nothing to encode.  A
key's answer is the parity of the first level that does not hold it.  Levels
are built by Spark: candidate bits are or-ed per machine word before and after
one shuffle, and only the finished words reach the driver.  A cascade of over
``SHARD_BYTES`` is split by key hash; each shard is sent and asked by itself,
so no broadcast grows with the list.  No key is ever joined to a list.

Rules: a rule is a host and a path prefix.  For a url the keys to ask are, for
each shape (number of host labels, path length) that occurs among the rules,
its host's last labels and its path's first characters; the longest listed key
(by labels, then path) is its rule.  Urls without a rule are judged by host: a
host of which the rules block more than half of the pages is listed, and its
other pages are blocked too.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and the verdict allow; an empty host is never listed; repeated rows are
judged alike; a null ``page_id`` stays null; extra columns are not read; an
empty table gives no rows; a key both allowed and blocked is blocked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .common import Shared, table

#: The contract's rules: (verdict, key); fixed values.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Share of wrongly passed keys of every level but the first.
WRONG = 1 / 16
#: Bytes of one cascade shard.
SHARD_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, count: int) -> Iterator[np.ndarray]:
    """The bits of each key; every level draws its own, or two keys could fall together in all of them."""
    a, b = W.mix(h1 + np.uint64(2 * level + 1)), W.mix(h2 + np.uint64(2 * level + 2)) | np.uint64(1)
    for i in range(count):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


class Cascade:
    """Levels of (bits, hash count, words) for each shard."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]], shard: int, shards: int):
        self.levels, self.shard, self.shards = levels, shard, shards

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key (by two 64-bit hashes) is listed; False for keys of other shards."""
        out = np.zeros(len(h1), bool)
        at = np.flatnonzero(h1 % np.uint64(self.shards) == self.shard)
        for k, (bits, count, words) in enumerate(self.levels):
            passed = np.ones(len(at), bool)
            for p in _places(h1[at], h2[at], k, bits, count):
                passed &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
            at = at[passed]
            out[at] = k % 2 == 0
        return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def _level_size(n: int, wrong: float) -> tuple[int, int]:
    """(bits, hash count) for n keys."""
    return max(64, math.ceil(n * math.log(1 / wrong) / math.log(2) ** 2 / 64) * 64), max(1, round(math.log2(1 / wrong)))


def _words(keys: DataFrame, level: int, bits: int, count: int) -> np.ndarray:
    """The filter of all keys; one partial filter per task goes into the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            for p in _places(h1, h2, level, bits, count):
                np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64))], ["at", "word"])

    got = keys.select("h1", "h2").mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)
    return words


def _passing(keys: DataFrame, cascade: Shared, level: int) -> DataFrame:
    """Keys of the kind that ``level`` must encode: those that all earlier levels hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = cascade.load()
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            # A key that every level so far holds gets the answer of the last of them.
            wrong = built.holds(h1, h2) != np.array(batch.column("listed").to_pylist(), bool)
            yield batch.filter(pa.array(wrong))

    return keys.mapInArrow(run, "h1 bigint, h2 bigint, listed boolean")


def build(listed: DataFrame, universe: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[Cascade]:
    """Cascade shards for the ``key`` column of ``listed``, exact on the keys of ``universe`` and ``listed``."""
    both = listed.select("key", F.lit(True).alias("listed")).union(universe.select("key", F.lit(False)))
    keys = both.filter("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed"))
    keys = materialize(keys.select(*_hashes(F.col("key")), "listed"), "keys")
    size = keys.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("other")).first()
    # Level 0 passes about as many wrong keys as there are listed ones.
    first = min(0.5, max(size["listed"], 1) * math.sqrt(0.5) / max(size["other"], 1))
    shards = max(1, math.ceil(2 * _level_size(size["listed"], first)[0] / 8 / shard_bytes))
    out = []
    for shard in range(shards):
        # h1 counts as an unsigned number, as in Cascade.holds.
        own = keys if shards == 1 else keys.filter(F.pmod(F.pmod(F.col("h1"), F.lit(shards)) + F.when(F.col("h1") < 0, F.lit((1 << 64) % shards)).otherwise(0), F.lit(shards)) == shard)
        cascade, wrong, left = Cascade([], shard, shards), first, own.filter("listed")
        while n := left.count():
            bits, count = _level_size(n, wrong)
            cascade.levels.append((bits, count, _words(left, len(cascade.levels), bits, count)))
            left = materialize(_passing(own, Shared(keys.sparkSession, cascade), len(cascade.levels)), "passing")
            wrong = WRONG
        out.append(cascade)
    return out


def member(rows: DataFrame, key: str, cascade: list[Cascade], name: str) -> DataFrame:
    """Adds ``name``: for each key of the array column ``key``, whether it is listed."""
    spark, out = rows.sparkSession, rows.withColumn(name, F.expr(f"transform({key}, x -> false)"))
    for shard in cascade:
        shared = Shared(spark, shard)
        hashed = out.withColumn("_h1", F.transform(key, lambda x: _hashes(x)[0])).withColumn("_h2", F.transform(key, lambda x: _hashes(x)[1]))
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=tuple(out.columns)) -> Iterator[pa.RecordBatch]:
            built = shared.load()
            for batch in batches:
                h1, h2, known = (batch.column(batch.schema.get_field_index(c)) for c in ("_h1", "_h2", name))
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (h1, h2)]
                hit = built.holds(flat[0].view(np.uint64), flat[1].view(np.uint64)) | known.flatten().to_numpy(zero_copy_only=False).astype(bool)
                offsets = h1.offsets.to_numpy() - h1.offsets[0].as_py()
                marks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hit))
                yield pa.RecordBatch.from_arrays([marks if c == name else batch.column(batch.schema.get_field_index(c)) for c in names], list(names))

        out = hashed.mapInArrow(run, ", ".join(fields))
    return out


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))


def candidates(shapes: list[tuple[int, int]]) -> Column:
    """Keys of a (host, path) to ask, longest first; ``shapes``: (host labels, path length)."""
    labels, keys = F.split("host", r"\.", -1), []
    for n, length in sorted(shapes, reverse=True):
        key = F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, length))
        keys.append(F.when((F.size(labels) >= n) & (F.length("path") >= length), key))
    return F.array_compact(F.array(*keys))


def judge(pages: DataFrame, rules: list[tuple[str, str]], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page (page_id, url)."""
    spark = pages.sparkSession
    shapes = {(r.split("/", 1)[0].count(".") + 1, len(r) - len(r.split("/", 1)[0])) for _, r in rules}
    urls = materialize(parsed(pages).withColumn("_keys", candidates(list(shapes)) if shapes else F.array().cast("array<string>")), "urls")
    asked = urls.select(F.explode("_keys").alias("key"))
    for verdict in ("block", "allow"):
        listed = spark.createDataFrame([(r,) for v, r in rules if v == verdict], "key string")
        urls = member(urls, "_keys", build(listed, asked, shard_bytes), f"_{verdict}")
    first = F.expr("get(filter(arrays_zip(_keys, _block, _allow), x -> x._block OR x._allow), 0)")
    ruled = materialize(urls.select("page_id", "host", "path", first.alias("_rule")), "ruled")
    by_rule = F.when(F.col("_rule._block"), "block").when(F.col("_rule._allow"), "allow")
    ruled = ruled.select("page_id", "host", "path", F.col("_rule._keys").alias("rule"), by_rule.alias("_verdict"), F.array("host").alias("_host"))
    hosts = ruled.filter("host <> ''").groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_verdict") == "block").alias("blocked"))
    hosts = materialize(hosts, "hosts")
    out = member(ruled, "_host", build(hosts.filter("2 * blocked > n"), hosts, shard_bytes), "_listed")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_listed")[0], "block").otherwise("allow")).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) FROM rules r
               WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS r FROM u),
hosts AS (SELECT host FROM fit WHERE host <> '' GROUP BY host HAVING 2 * count(*) FILTER (WHERE r.verdict = 'block') > count(*))
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN host IN (SELECT host FROM hosts) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""
