"""Hot keys: one outlet holds a third of all invoices and one product a third of
all item rows.  Registered queries still equal their DuckDB oracles, with the
single-task shortcuts disabled so every distributed path runs."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries

from .conftest import SF0001
from .oracle_compare import compare

SKEWED = ["purchase_history", "suggestions", "history_pages", "product_listing", "landing_summary",
          "category_items", "missing_price_list", "cart_state", "order_message", "resolve_links",
          "search_log", "order_lines", "review_list", "category_picks", "display_rows", "resolve_tokens"]


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for t in ["customer", "part", "region", "nation", "supplier"]:
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(str(out / f"{t}.parquet"))
    orders = spark.read.parquet(f"{SF0001}/orders.parquet")
    orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint"))
                      .otherwise(F.col("o_custkey"))).write.parquet(str(out / "orders.parquet"))
    items = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    items.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 1, F.lit(2).cast("bigint"))
                     .otherwise(F.col("l_partkey"))).write.parquet(str(out / "lineitem.parquet"))
    events = spark.read.parquet(f"{SF0001}/events.parquet")
    events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint"))
                      .otherwise(F.col("user_id"))).write.parquet(str(out / "events.parquet"))
    return str(out)


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_query_matches_oracle(spark, skewed_dir, name, monkeypatch):
    from outletlens.operators import catalog as C
    from outletlens.plans import ranking
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(C, "SLOT_BLOCK", 7)
    from outletlens.plans import hotkeys
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 3)  # both the broadcast head and the shuffled tail run
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    ok, msg = compare(spark, skewed_dir, name, queries()[name], oracle_sql()[name])
    assert ok, msg
