"""Hot-key joins: same rows as a plain inner join, with hot keys kept out of shuffles."""

from pyspark.sql import functions as F

from outletlens.plans.hotkeys import split_by_key_join, split_hot_join


def _facts(spark):
    # key 1 holds a third of the rows; keys 0..49 otherwise; key 99 has no dimension row
    return spark.range(3000).select(
        F.col("id").alias("fact_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") == 7, F.lit(99))
        .otherwise(F.col("id") % 50).cast("bigint").alias("k"))


def _dim(spark):
    return spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))


def _rows(df):
    return sorted(tuple(r) for r in df.select("fact_id", "k", "v").collect())


def test_split_hot_join_equals_plain_join(spark):
    facts, dim = _facts(spark), _dim(spark)
    head = dim.filter(F.col("k").isin(1, 2))
    got = split_hot_join(facts, "k", head, dim)
    assert _rows(got) == _rows(facts.join(dim, "k"))


def test_split_hot_join_routes_hot_keys_through_a_broadcast(spark):
    facts, dim = _facts(spark), _dim(spark)
    plan = split_hot_join(facts, "k", dim.filter(F.col("k") == 1), dim)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan


def test_split_by_key_join_equals_plain_join(spark):
    facts, dim = _facts(spark), _dim(spark)
    got = split_by_key_join(facts, "k", dim, F.col("k") <= 3)
    assert _rows(got) == _rows(facts.join(dim, "k"))


def test_dimension_join_both_paths_equal_plain_join(spark):
    from outletlens.plans.hotkeys import dimension_join
    facts, dim = _facts(spark), _dim(spark)
    # key 99 is heavy too but has no dimension row: it must drop out, not shuffle
    facts = facts.unionByName(spark.range(500).select((F.col("id") + 10_000).alias("fact_id"),
                                                      F.lit(99).cast("bigint").alias("k")))
    want = _rows(facts.join(dim, "k"))
    assert _rows(dimension_join(facts, dim, "k", dim_rows=50)) == want             # broadcast whole
    assert _rows(dimension_join(facts, dim, "k", dim_rows=50, broadcast_rows=10, hot_keys=2)) == want


def test_dimension_join_left_keeps_unmatched_and_null_keys(spark):
    from outletlens.plans.hotkeys import dimension_join
    facts, dim = _facts(spark), _dim(spark)
    # a third of the rows have a NULL key, key 99 is heavy and has no dimension row
    facts = facts.withColumn("k", F.when(F.col("fact_id") % 3 == 1, F.lit(None).cast("bigint")).otherwise(F.col("k")))
    facts = facts.unionByName(spark.range(400).select((F.col("id") + 10_000).alias("fact_id"),
                                                      F.lit(99).cast("bigint").alias("k")))
    want = _rows(facts.join(dim, "k", "left"))
    assert len(want) == facts.count()
    assert _rows(dimension_join(facts, dim, "k", dim_rows=50, how="left")) == want
    got = dimension_join(facts, dim, "k", dim_rows=50, broadcast_rows=10, hot_keys=2, write_facts=False, how="left")
    assert _rows(got) == want
