"""Per-token calls: the batch plans restricted to one outlet, paged and ordered like the reference."""

from pyspark.sql import functions as F

from outletlens import api
from outletlens.operators import catalog as C


def _token(ledger, outlet_id):
    return ledger.customers.filter(F.col("id") == outlet_id).first().catalog_token


def _busiest(ledger):
    h = C.purchase_history(ledger)
    return h.groupBy("outlet_id").count().orderBy(F.col("count").desc(), "outlet_id").first().outlet_id


def test_history_pages_concatenate_to_the_batch_order(ledger_small):
    oid = _busiest(ledger_small)
    tok = _token(ledger_small, oid)
    batch = [tuple(r) for r in C.positioned_history(ledger_small).filter(F.col("outlet_id") == oid)
             .orderBy("pos").select(*api.HISTORY_COLUMNS).collect()]
    assert len(batch) > 6
    pages = []
    for off in range(0, len(batch), 4):
        pages += [tuple(r) for r in api.get_history(ledger_small, tok, limit=4, offset=off).collect()]
    assert pages == batch
    assert [tuple(r) for r in api.get_history_all(ledger_small, tok).collect()] == batch
    assert api.get_history(ledger_small, tok).columns == api.HISTORY_COLUMNS


def test_limit_and_offset_clamps(ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    assert api.get_history(ledger_small, tok, limit=0).count() == 1          # clamped up to 1
    assert api.get_history(ledger_small, tok, limit=None, offset=-5).count() == \
        api.get_history(ledger_small, tok).count()                          # NULL -> 1000, negative -> 0
    assert api.get_suggestions(ledger_small, tok, limit=500).count() == 50  # clamped down to 50
    assert api.get_suggestions(ledger_small, tok).count() == 12
    assert api.get_products(ledger_small, tok, limit=5000).count() == 156   # page cap 1000 > listing


def test_suggestions_follow_the_batch_order(ledger_small):
    oid = _busiest(ledger_small)
    tok = _token(ledger_small, oid)
    batch = [tuple(r) for r in C.suggestions(ledger_small).filter(F.col("outlet_id") == oid)
             .orderBy("pos").select(*api.SUGGESTION_COLUMNS).collect()]
    assert [tuple(r) for r in api.get_suggestions(ledger_small, tok).collect()] == batch


def test_products_pages_and_unknown_token(ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    listing = [tuple(r) for r in api.get_products_all(ledger_small, tok).collect()]
    paged = [tuple(r) for r in api.get_products(ledger_small, tok, limit=100).collect()] + \
        [tuple(r) for r in api.get_products(ledger_small, tok, limit=100, offset=100).collect()]
    assert paged == listing and len(listing) == 156
    for call in (api.get_outlet, api.get_history, api.get_suggestions, api.get_products):
        assert call(ledger_small, "unknown-token-000000000000").count() == 0
        assert call(ledger_small, tok[:12]).count() == 0                     # shorter than 16
    assert api.get_outlet(ledger_small, tok).count() == 1


def test_search_products_gated_by_token(ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    rows = api.search_products(ledger_small, tok, "  RING ").collect()
    assert rows and all("ring" in r.name.lower() or "ring" in (r.sku or "").lower() for r in rows)
    assert [r.pos for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].match_count >= len(rows)
    assert api.search_products(ledger_small, "unknown-token-000000000000", "ring").count() == 0


def test_build_order_for_one_cart(spark, ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    listing = C.product_listing(ledger_small).orderBy("product_id").limit(3).collect()
    cart = spark.createDataFrame(
        [(listing[0].product_id, 2, "base", 1), (listing[1].product_id, 1, "lusin", 2),
         (listing[2].product_id, 0, "base", 3), (999_999, 4, "base", 4)],
        "product_id bigint, qty int, unit string, position bigint")
    lines, message = api.build_order(ledger_small, tok, cart)
    got = lines.collect()
    assert [r.product_id for r in got] == [listing[0].product_id, listing[1].product_id]  # qty 0, unknown drop
    assert all(r.subtotal % 100 == 0 for r in got)
    m = message.collect()
    assert len(m) == 1 and m[0].line_count == 2 and m[0].total == sum(r.subtotal for r in got)
    assert m[0].message.startswith("Pesanan ")
    assert api.build_order(ledger_small, "unknown-token-000000000000", cart)[1].count() == 0


def test_category_browser(spark, ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    listing = C.product_listing(ledger_small).orderBy("product_id").collect()
    cart = spark.createDataFrame([(listing[0].product_id, 3), (listing[0].product_id, 1), (listing[1].product_id, 0)],
                                 "product_id bigint, qty int")
    cats = api.browse_categories(ledger_small, tok, cart).collect()
    assert sum(r.item_count for r in cats) == len(listing)
    assert sum(r.picked for r in cats) == 1
    assert [r.category_name for r in cats] == sorted(r.category_name for r in cats)   # ASCII names
    first = cats[0].category_name
    items = api.category_products(ledger_small, tok, first).collect()
    assert len(items) == cats[0].item_count and [r.pos for r in items] == list(range(1, len(items) + 1))
    assert api.category_products(ledger_small, tok, "no such category").count() == 0
    assert api.browse_categories(ledger_small, "unknown-token-000000000000").count() == 0


def test_landing_for_one_token(ledger_small):
    from outletlens.operators import browse as B
    oid = _busiest(ledger_small)
    tok = _token(ledger_small, oid)
    got = [tuple(r) for r in api.get_landing(ledger_small, tok).collect()]
    want = [tuple(r) for r in B.landing_summary(ledger_small).filter(F.col("outlet_id") == oid).select(
        "history_count", "suggestion_count", "product_count", "landing").collect()]
    assert got == want and got[0][3] == "history"
    assert api.get_landing(ledger_small, "unknown-token-000000000000").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_page_of_one_token_ranks_nothing(ledger_small):
    """A page is cut while the outlet's rows are sorted, and its id filters the invoice scan."""
    oid = _busiest(ledger_small)
    tok = _token(ledger_small, oid)
    plan = _plan(api.get_history(ledger_small, tok, limit=4, offset=2))
    assert "Window" not in plan and "TakeOrderedAndProject" in plan
    assert f"EqualTo(o_custkey,{oid})" in plan
    plan = _plan(api.get_products(ledger_small, tok, limit=4, offset=2))
    assert "Window" not in plan and "TakeOrderedAndProject" in plan
    assert "Window" not in _plan(api.get_history_all(ledger_small, tok))


def _scratch(spark):
    import os
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/tables"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_unknown_token_reads_no_item_row_and_writes_nothing(spark, ledger_small):
    before = _scratch(spark)
    for call in (api.get_outlet, api.get_history, api.get_suggestions, api.get_products, api.get_history_all, api.get_products_all, api.get_landing):
        df = call(ledger_small, "unknown-token-000000000000")
        assert df.count() == 0 and not any(t in _plan(df) for t in ("lineitem", "part.parquet", "orders.parquet")), call
    check = C.negative_token_check(ledger_small, "unknown-token-000000000000")
    assert tuple(check.first()) == (0, 0, 0, 0) and "lineitem" not in _plan(check)
    assert _scratch(spark) == before


def test_one_token_writes_nothing(spark, ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    before = _scratch(spark)
    api.get_suggestions(ledger_small, tok).collect()
    api.get_history(ledger_small, tok).collect()
    assert _scratch(spark) == before
    assert tuple(C.negative_token_check(ledger_small, tok).first())[0] == 1


def test_reads_of_an_unknown_token_have_the_same_columns(ledger_small):
    tok = _token(ledger_small, _busiest(ledger_small))
    for read in (C.purchase_history, C.suggestions, C.product_listing, C.outlet_profile):
        assert [(f.name, f.dataType) for f in read(ledger_small, "unknown-token-000000000000").schema] == [(f.name, f.dataType) for f in read(ledger_small, tok).schema]


def test_suggestions_from_a_measured_head_equal_those_from_all_ranks(spark, ledger_small, monkeypatch):
    """Beyond the broadcast bound only the ranks that some outlet can be shown are sorted."""
    from outletlens.plans import hotkeys, ranking
    want = {tuple(r) for r in C.suggestions(ledger_small).collect()}
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 16)
    pairs = C.owned_pairs(ledger_small)
    most = max(r["count"] for r in pairs.groupBy("customer_id").count().collect())
    assert C.head_size(ledger_small, pairs, 12) == min(ledger_small.product_count, 12 + most)
    assert {tuple(r) for r in C.suggestions(ledger_small).collect()} == want
    # What one task may rank does not decide the result (nor, within the head, the plan).
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 5)
    assert {tuple(r) for r in C.suggestions(ledger_small).collect()} == want


def test_popular_head_is_cut_before_it_is_ranked(ledger_small):
    counts = C.owner_counts(C.owned_pairs(ledger_small))
    assert "TakeOrderedAndProject" in _plan(C.ranked_popularity(ledger_small, C.DEFAULT, counts, 20))


def test_page_positions_count_the_groups_beyond_the_bound(spark, ledger_small, monkeypatch):
    """A product table beyond the bound alone does not force the distributed ranking."""
    from outletlens.plans import ranking
    rows = spark.range(1000).select((F.col("id") % 50).alias("g"), "id")
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 30)
    plan = _plan(ranking.group_position(rows, ["g"], [F.col("id")], group_bound=10**9))
    assert "Window" in plan and "rangepartitioning" not in plan


def test_category_join_is_broadcast_or_split(spark, ledger_small, monkeypatch):
    from outletlens.plans import hotkeys
    want = {tuple(r) for r in C.product_listing(ledger_small).collect()}
    plan = _plan(C.product_listing(ledger_small))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 2)
    assert {tuple(r) for r in C.product_listing(ledger_small).collect()} == want


def test_search_fan_out_follows_the_candidates(spark, ledger_small):
    """One-letter and rare keywords: the same rows whatever a bucket holds."""
    from outletlens.operators import browse as B
    index = B.search_index(C.product_listing(ledger_small))
    keywords = spark.createDataFrame([("a",), ("e",), ("ring",), ("sku-0001",), ("zzzz",), ("  A ",)], "keyword string")
    want = {tuple(r) for r in B.search_table(index, keywords).collect()}
    assert want and {tuple(r) for r in B.search_table(index, keywords, bucket_candidates=7).collect()} == want


def test_index_lists_exercise_the_priority(spark):
    from outletlens.plans.registry import QUERIES
    from .conftest import SF001
    assert {r.source for r in QUERIES["product_index_lists"](spark, SF001).select("source").distinct().collect()} == {0, 1, 2}


def test_missing_prices_no_string_in_the_fact_shuffle(ledger_small):
    """Only ids, dates and counts are exchanged with the items; strings come back per group."""
    import re
    from outletlens.operators import audits as A
    plan = _plan(A.missing_price_list(ledger_small))
    assert not [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if re.search("name|sku|unit|_g#", x)]
