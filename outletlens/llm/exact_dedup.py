"""Exact dedup: tree-merge of sorted digest runs (DataFrame operations only).

Every input partition is one run: its rows, sorted by the digest of the
normalised text, with one row per digest.  Runs are merged in binomial rounds:
in each round ``fan_in`` neighbouring runs exchange their digest slices, are
merged in sorted order, and keep per digest the best identifier and the number
of copies so far.  After ``log(runs, fan_in)`` rounds one run is left.

A run holds a digest once, whatever the size of its group, so a group with a
third of all rows gives at most ``fan_in`` rows to a merging task.  A digest is
trusted only together with a second hash and the length of the normalised text
(all three are merge keys), so every level verifies what it merges.

Defined cases: a null text counts as empty; all empty texts are one group.  A
null ``doc_id`` loses every tie and is kept only when its whole group has none.
Rows that agree in text and ``doc_id`` get the same answer (``kept_rows`` keeps
one of them).  Other columns, whatever their names, are not read by
``exact_dedup``.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import HEAVY, free_names, join_groups, table

#: Runs that one round merges into one.
FAN_IN = 16
#: Characters that do not count (fixed by the contract): space and U+0009 to U+000D.
IGNORED = " \t\n\x0b\x0c\r"

_KEY = ["_sha", "_check", "_size"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def digest_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: digest of its normalised text, verification, code points, run."""
    norm = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_points"),
                       normalised(F.col(text)).alias("_norm"))
    return norm.select("doc_id", "_points", F.unhex(F.sha2(F.encode("_norm", "UTF-8"), 256)).alias("_sha"), F.xxhash64("_norm").alias("_check"),
                       F.octet_length("_norm").alias("_size"), F.spark_partition_id().alias("_run"))


def _merge(runs: DataFrame) -> DataFrame:
    """Rows of equal run and digest become one: best identifier, number of copies."""
    return runs.groupBy("_run", *_KEY).agg(F.min("_best").alias("_best"), F.sum("_copies").alias("_copies"))


def tree_merge(digests: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Per digest the best (most code points, smallest doc_id) and the group's size."""
    best = F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    level = _merge(digests.select("_run", *_KEY, best.alias("_best"), F.lit(1).cast("long").alias("_copies")))
    for _ in range(math.ceil(math.log(max(runs, 2), fan_in) - 1e-9)):
        level = _merge(level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")))
    return level.select(*_KEY, F.col("_best.d").alias("keep_id"), F.col("_copies").alias("group_size"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN, heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    digests = materialize(digest_runs(docs, doc_id, text), "digests")
    size = digests.agg(F.count(F.lit(1)).alias("rows"), F.max("_run").alias("last")).first()
    merged = tree_merge(digests, (size["last"] or 0) + 1, fan_in).filter("group_size > 1")
    merged = materialize(merged, "digest_groups")
    judged = join_groups(digests, merged, _KEY, "group_size", size["rows"], heavy)
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return judged.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows equal in text and doc_id, one."""
    own_sha, other_id, other_sha = free_names(docs, 3)
    judged = materialize(exact_dedup(docs, doc_id, text), "exact_dedup")
    named = [F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other_sha)]
    same = F.col(doc_id).eqNullSafe(F.col(other_id)) & (F.col(own_sha) == F.col(other_sha))
    gone = judged.filter(~F.col("kept")).select(*named).distinct()
    stay = docs.withColumn(own_sha, F.sha2(F.encode(normalised(F.col(text)), "UTF-8"), 256)).join(gone, same, "left_anti")
    again = judged.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if again.isEmpty():
        return stay.drop(own_sha)
    again = again.select(*named)
    one = stay.join(again, same, "left_semi").dropDuplicates([doc_id, own_sha])
    return stay.join(again, same, "left_anti").unionByName(one).drop(own_sha)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
