"""C16 by run summaries: equal to a plain replay, hot entries spread, and its merge into snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from outletlens.operators import orders as O
from outletlens.sources.versions import Versions
from outletlens.streaming.cart import current_cart, merge_batch

SCHEMA = "seq bigint, outlet_id bigint, product_id bigint, qty bigint, unit string"
TEXT_SCHEMA = "seq bigint, outlet_id string, product_id string, qty bigint, unit string"


def replay(rows):
    """The client's map, change by change."""
    cart = {}
    for seq, outlet, product, qty, unit in sorted({r[:3]: r for r in rows}.values()):
        if outlet is None or product is None:
            continue
        key = (outlet, product)
        if not qty:
            cart.pop(key, None)
        else:
            cart[key] = (qty, "lusin" if unit == "lusin" else "base", cart[key][2] if key in cart else seq)
    return {(*k, *v) for k, v in cart.items()}


def rows_of(df):
    return {tuple(r) for r in df.select("outlet_id", "product_id", "qty", "unit", "position").collect()}


def log(rng, n, entries=6, spread=40, ids=int):
    seqs = rng.sample(range(-n, n * spread), n)
    return [(s, ids(rng.randrange(3)), ids(rng.randrange(entries)), rng.choice([None, 0, 0, 1, 2, 3, -1]), rng.choice(["base", "lusin", None, "x"])) for s in seqs]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("bits", [0, 3, 8, 16])
def test_equals_replay_whatever_the_block(spark, bits):
    rows = log(random.Random(bits), 900) + [(5, None, 1, 2, "base"), (6, 1, None, 2, "base")]
    assert rows_of(O.cart_state(frame(spark, rows).repartition(5), bits)) == replay(rows)


def test_sequence_numbers_beyond_doubles(spark):
    big = 2**60
    rows = [(big + i, 1, 1, q, "base") for i, q in enumerate([1, 0, 2, 3])]
    assert rows_of(O.cart_state(frame(spark, rows))) == {(1, 1, 3, "base", big + 2)}


def test_empty_log(spark):
    assert O.cart_state(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_log_is_joined_with_nothing(spark):
    plan = O.cart_state(spark.createDataFrame([(1, 1, 1, 1, "base")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_third_of_all_events_on_one_entry_is_spread(spark):
    """Rows that the first fold's shuffle deals out: no partition has far more than the median."""
    hot = F.col("id") % 3 == 0
    ev = spark.range(300_000).select(F.col("id").alias("seq"), F.when(hot, 1).otherwise(F.col("id") % 5000).alias("outlet_id"), F.when(hot, 1).otherwise(F.col("id") % 7).alias("product_id"),
                                     (F.col("id") % 5).alias("qty"), F.lit("base").alias("unit"))
    dealt = O.entry_events(ev, 10).repartition(32, *O.ENTRY, "_block").groupBy(F.spark_partition_id()).count()
    counts = sorted(r["count"] for r in dealt.collect())
    assert len(counts) == 32 and counts[-1] < 2 * counts[16]
    got = {(r.outlet_id, r.product_id): r for r in O.cart_state(ev, 10).collect()}
    # The last change of the hot entry is 299999 - 299999 % 3; deletes are the multiples of 15.
    last = 299_999 - 299_999 % 3
    assert (got[1, 1].qty, got[1, 1].position) == (last % 5, last - last % 15 + 3)


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_equal_batch_for_late_and_replayed_changes(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = log(rng, 400)
    rng.shuffle(rows)  # any order of arrival: most changes are late
    versions, seen = Versions(spark, str(tmp_path / "cart")), []
    for n in range(4):
        batch = rows[n * 100:(n + 1) * 100]
        replayed = rng.sample(seen, len(seen) // 3)
        seen += batch
        merge_batch(versions, frame(spark, batch + replayed), n, seq_bits=5)
        assert rows_of(current_cart(spark, versions.path, 5)) == replay(seen)
    assert versions.published() == [2, 3]  # older ones are gone


def test_retried_batches_change_nothing(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "cart"))
    merge_batch(versions, frame(spark, [(1, 1, 1, 2, "base")]), 0)
    merge_batch(versions, frame(spark, [(2, 1, 1, None, "base")]), 1)  # no quantity deletes
    assert rows_of(current_cart(spark, versions.path)) == set()
    merge_batch(versions, frame(spark, [(9, 9, 9, 9, "base")]), 1)  # published already
    assert rows_of(current_cart(spark, versions.path)) == set()
    # An attempt that died before publishing is overwritten.
    frame(spark, [(7, 7, 7, 7, "base")]).write.parquet(f"{versions.path}/data/2")
    assert versions.published() == [0, 1]
    merge_batch(versions, frame(spark, [(1, 1, 1, 2, "base"), (3, 1, 1, 4, "lusin")]), 2)  # replay of the deleted add
    assert rows_of(current_cart(spark, versions.path)) == {(1, 1, 4, "lusin", 3)}


def test_text_ids(spark, tmp_path):
    rows = log(random.Random(8), 200, ids=lambda i: f"id-{i}")
    versions = Versions(spark, str(tmp_path / "cart"))
    for n in range(2):
        merge_batch(versions, frame(spark, rows[n::2], TEXT_SCHEMA), n)
    assert rows_of(current_cart(spark, versions.path)) == replay(rows)


def test_lateness_bounds_what_an_entry_keeps(spark, tmp_path):
    """Adds in order, never deleted: with a lateness the snapshot keeps a bounded number of them."""
    versions = Versions(spark, str(tmp_path / "cart"))
    rows = [(s, 1, 1, s % 9 + 1, "base") for s in range(1000)] + [(s, 2, s % 3, s % 4, "lusin") for s in range(1000, 2000)]
    rows.sort()
    for n in range(8):
        merge_batch(versions, frame(spark, rows[n * 250:(n + 1) * 250]), n, lateness=20, seq_bits=4)
    assert rows_of(current_cart(spark, versions.path, 4)) == replay(rows)
    assert versions.read(7).filter("outlet_id = 1").count() == 2
    # Later than that is ignored, for an entry known or not.
    merge_batch(versions, frame(spark, [(500, 1, 1, 0, "base"), (10, 5, 5, 1, "base")]), 8, lateness=20, seq_bits=4)
    assert rows_of(current_cart(spark, versions.path, 4)) == replay(rows)
