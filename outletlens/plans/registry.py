"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables of ``sf_dir`` through the FIXTURES.md
mapping (``Ledger.from_driver``) and runs over the whole tables.  Parameters
(keywords, page size, tokens) are fixed here and mirrored in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import browse as B
from ..operators import catalog as C
from ..operators import orders as O
from ..operators import tokens as TK
from ..plans.hotkeys import dimension_join
from ..sources.ledger import Ledger, map_link_opens, read_driver_table

# Fixed query parameters (mirrored in the oracle SQL).
STORAGE_BASE_URL = "https://store.example.com"
SEARCH_KEYWORDS = ["ring", "  BLUE ", "SKU-0001", "zzzz", "ring"]  # a repeated keyword counts once
HISTORY_PAGE_SIZE = 5
UNKNOWN_TOKEN = "unknown-token-000000000000"
# Derived search log: each cart event searches a fragment of its product's
# name (1-2 or 3-6 characters) or an upper-cased fragment of its sku.
SEARCH_LOG_KEYWORD = (
    "CASE WHEN seq % 7 = 0 THEN substr(name, 2 + seq % 5, 1 + seq % 2)"
    " WHEN seq % 2 = 0 THEN substr(name, 1 + seq % 3, 3 + seq % 4)"
    " ELSE upper(substr(sku, 4 + seq % 5, 3 + seq % 3)) END")

PROD8 = C.PRODUCT_COLUMNS + C.PHOTO_COLUMNS
NORM = ["product_id", "name", "sku", "price", "unit", "category_name", "photo_thumb_url", "photo_large_url"]


def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return Ledger.from_driver(spark, sf_dir)


def _opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_link_opens(read_driver_table(spark, sf_dir, "events"))


def _index(L: Ledger) -> DataFrame:
    """Product index used by search and orders: the normalised listing.

    Under one visibility setting, history and suggestion rows are subsets of
    the listing, so the first-wins merge (C12) equals the listing itself.
    """
    return B.normalize_products(C.product_listing(L), STORAGE_BASE_URL)


def _lines(L: Ledger) -> DataFrame:
    return O.order_lines(O.cart_state(L.cart_events), _index(L), product_rows=L.product_count)


# --- C1 / C2 / C3 -----------------------------------------------------------
def q_resolve_tokens(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return C.resolve_tokens(L, _opens(spark, sf_dir).select("open_id", "token")).select(
        "open_id", "token", "outlet_id")


def q_resolve_links(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return C.resolve_links(L, _opens(spark, sf_dir).select("open_id", "path")).select(
        "open_id", "path", "token", "outlet_id", "status")


def q_outlet_profile(spark, sf_dir):
    return C.outlet_profile(_ledger(spark, sf_dir))


# --- C4 - C10 ---------------------------------------------------------------
def q_purchase_history(spark, sf_dir):
    return C.purchase_history(_ledger(spark, sf_dir))


def q_purchase_history_all_customers(spark, sf_dir):
    """C4 for every customer, token or not (the admin form; FIXTURES.md's count)."""
    L = _ledger(spark, sf_dir)
    return C.purchase_history(L, outlets=L.customers.select(F.col("id").alias("outlet_id")))


def q_suggestions(spark, sf_dir):
    return C.suggestions(_ledger(spark, sf_dir))


def q_product_listing(spark, sf_dir):
    return C.positioned_listing(_ledger(spark, sf_dir)).select(*PROD8, "pos")


def q_history_pages(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return C.with_page_numbers(C.positioned_history(L), HISTORY_PAGE_SIZE)


def q_history_drain(spark, sf_dir):
    return C.drain(C.positioned_history(_ledger(spark, sf_dir)))


def q_suggestions_priced(spark, sf_dir):
    return C.suggestions(_ledger(spark, sf_dir), vis=C.Visibility(require_price=True))


def q_purchase_history_priced(spark, sf_dir):
    return C.purchase_history(_ledger(spark, sf_dir), vis=C.Visibility(require_price=True))


def q_product_listing_priced(spark, sf_dir):
    return C.product_listing(_ledger(spark, sf_dir), vis=C.Visibility(require_price=True))


def q_listing_any_stock(spark, sf_dir):
    vis = C.Visibility(require_stock=False, include_photos=False)
    return C.product_listing(_ledger(spark, sf_dir), vis=vis)


def q_negative_token_check(spark, sf_dir):
    return C.negative_token_check(_ledger(spark, sf_dir), UNKNOWN_TOKEN)


# --- C11 - C15, C21 ---------------------------------------------------------
def q_normalized_listing(spark, sf_dir):
    return _index(_ledger(spark, sf_dir)).select(*NORM)


def q_product_index(spark, sf_dir):
    return B.catalog_index(_ledger(spark, sf_dir), storage_base_url=STORAGE_BASE_URL)


def q_product_index_lists(spark, sf_dir):
    """C12 where the lists differ: a priced listing without photos, a history that
    also has what is out of stock, suggestions that also have what has no price."""
    return B.catalog_index(_ledger(spark, sf_dir), C.Visibility(require_price=True, include_photos=False), STORAGE_BASE_URL,
                           history_vis=C.Visibility(require_stock=False, require_price=True), suggestion_vis=C.DEFAULT)


def q_search(spark, sf_dir):
    res = B.search(B.search_index(C.product_listing(_ledger(spark, sf_dir)), STORAGE_BASE_URL), SEARCH_KEYWORDS)
    return res.select("keyword", "match_count", "pos", *NORM)


def q_search_log(spark, sf_dir):
    """C13 over a whole search log (one keyword per cart event), as an n-gram equi-join."""
    L = _ledger(spark, sf_dir)
    ev = L.cart_events.filter(F.col("product_id").isNotNull()).select("seq", "outlet_id", "product_id")
    prods = L.products.select(F.col("id").alias("product_id"), "name", "sku")
    log = dimension_join(ev, prods, "product_id", L.product_count).selectExpr(
        "outlet_id", f"{SEARCH_LOG_KEYWORD} AS keyword")
    res = B.search_table(B.search_index(C.product_listing(L), STORAGE_BASE_URL), log, product_rows=L.product_count)
    return res.select("keyword", "match_count", "pos", *NORM)


def q_category_rollup(spark, sf_dir):
    return B.category_rollup(_index(_ledger(spark, sf_dir)))


def q_category_picks(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return B.category_picks(_index(L), O.cart_state(L.cart_events), product_rows=L.product_count)


def q_category_items(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return B.category_items(C.product_listing(L), storage_base_url=STORAGE_BASE_URL,
                            group_bound=L.product_count).select(
        "category_name", "pos", *[c for c in NORM if c != "category_name"])


def q_landing_summary(spark, sf_dir):
    return B.landing_summary(_ledger(spark, sf_dir))


# --- C16 - C20, C22, C36 ----------------------------------------------------
def q_cart_state(spark, sf_dir):
    return O.cart_state(_ledger(spark, sf_dir).cart_events)


def q_clean_quantity(spark, sf_dir):
    from ..functions.pricing import clean_quantity
    ev = read_driver_table(spark, sf_dir, "events")
    raw = F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" pcs"))
    return ev.select(F.col("event_id").alias("seq"), raw.alias("raw_text")).select(
        "seq", "raw_text", clean_quantity("raw_text").alias("qty"))


def q_order_lines(spark, sf_dir):
    return _lines(_ledger(spark, sf_dir))


def q_order_summary(spark, sf_dir):
    return O.order_summary(_lines(_ledger(spark, sf_dir)))


def q_order_message(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return O.order_message(_lines(L), C.outlet_profile(L))


def q_review_list(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    return O.review_list(_lines(L), _index(L), product_rows=L.product_count).select("outlet_id", "position", *NORM)


def q_display_rows(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    cart = O.cart_state(L.cart_events).select("outlet_id", "product_id", "qty", F.col("unit").alias("mode"),
                                               "position")
    rows = dimension_join(cart, _index(L), "product_id", L.product_count)
    return O.display_rows(rows).select("outlet_id", "position", "product_id", "price_tag", "second_line",
                                       "recap", "initial")


def q_history_notes(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    rows = B.normalize_products(C.purchase_history(L), STORAGE_BASE_URL)
    return O.display_rows(rows, qty=None, mode=None).select("outlet_id", "product_id", "note", "price_tag",
                                                           "second_line", "initial")


def q_suggestion_notes(spark, sf_dir):
    rows = B.normalize_products(C.suggestions(_ledger(spark, sf_dir)), STORAGE_BASE_URL)
    return O.display_rows(rows, qty=None, mode=None).select("outlet_id", "pos", "product_id", "note", "price_tag",
                                                           "second_line", "initial")


# --- C23 - C27 --------------------------------------------------------------
def q_issue_tokens(spark, sf_dir):
    customers = _ledger(spark, sf_dir).customers
    snap = TK.with_issued_tokens(customers.withColumn("_before", F.col("catalog_token")))
    return snap.select("id", "token_issued", F.length("catalog_token").cast("bigint").alias("token_length"),
                       F.col("catalog_token").rlike("^[0-9a-f]{32}$").alias("token_is_hex"),
                       F.coalesce(F.col("catalog_token") == F.col("_before"), F.lit(False)).alias("keeps_old_token"))


def q_rotate_tokens(spark, sf_dir):
    """C24 over a data-derived set: outlets whose link was opened through a malformed path."""
    L = _ledger(spark, sf_dir)
    ev = read_driver_table(spark, sf_dir, "events")
    leaked = ev.filter(F.col("event_type") == "error").select(F.col("user_id").alias("outlet_id"))
    snap = TK.with_rotated_tokens(L.customers, leaked)
    return snap.select(
        "id", "token_rotated", F.length("catalog_token").cast("bigint").alias("token_length"),
        F.coalesce(F.col("catalog_token") == F.col("previous_token"), F.lit(False)).alias("keeps_old_token"))


def q_token_uniqueness_check(spark, sf_dir):
    return TK.token_uniqueness_check(_ledger(spark, sf_dir).customers)


def q_token_coverage(spark, sf_dir):
    return TK.token_coverage(_ledger(spark, sf_dir).customers)


def q_link_list(spark, sf_dir):
    return TK.link_list(_ledger(spark, sf_dir))


# --- C28 - C31 --------------------------------------------------------------
def q_missing_price_summary(spark, sf_dir):
    return A.missing_price_summary(_ledger(spark, sf_dir).products)


def q_missing_price_list(spark, sf_dir):
    return A.missing_price_list(_ledger(spark, sf_dir))


def q_stock_split(spark, sf_dir):
    return A.stock_split(_ledger(spark, sf_dir).products)


def q_photo_coverage(spark, sf_dir):
    return A.photo_coverage(_ledger(spark, sf_dir).products)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "resolve_tokens": q_resolve_tokens,            # C1
    "resolve_links": q_resolve_links,              # C2
    "outlet_profile": q_outlet_profile,            # C3
    "purchase_history": q_purchase_history,        # C4
    "purchase_history_all_customers": q_purchase_history_all_customers,  # C4, admin form
    "suggestions": q_suggestions,                  # C5
    "product_listing": q_product_listing,          # C6
    "history_pages": q_history_pages,              # C7
    "history_drain": q_history_drain,              # C8
    "suggestions_priced": q_suggestions_priced,    # C9
    "purchase_history_priced": q_purchase_history_priced,  # C9
    "product_listing_priced": q_product_listing_priced,  # C9
    "listing_any_stock": q_listing_any_stock,      # C10
    "normalized_listing": q_normalized_listing,    # C11
    "product_index": q_product_index,              # C12
    "product_index_lists": q_product_index_lists,  # C12, lists that differ
    "search": q_search,                            # C13
    "search_log": q_search_log,                    # C13, keyword table
    "category_rollup": q_category_rollup,          # C14
    "category_picks": q_category_picks,            # C14
    "category_items": q_category_items,            # C15
    "cart_state": q_cart_state,                    # C16
    "clean_quantity": q_clean_quantity,            # C17
    "order_lines": q_order_lines,                  # C18
    "order_summary": q_order_summary,              # C19
    "order_message": q_order_message,              # C20
    "landing_summary": q_landing_summary,          # C21
    "review_list": q_review_list,                  # C22
    "issue_tokens": q_issue_tokens,                # C23
    "rotate_tokens": q_rotate_tokens,              # C24
    "token_uniqueness_check": q_token_uniqueness_check,  # C25
    "token_coverage": q_token_coverage,            # C26
    "link_list": q_link_list,                      # C27
    "missing_price_summary": q_missing_price_summary,  # C28
    "missing_price_list": q_missing_price_list,    # C29
    "stock_split": q_stock_split,                  # C30
    "photo_coverage": q_photo_coverage,            # C31
    "negative_token_check": q_negative_token_check,  # C34
    "display_rows": q_display_rows,                # C36
    "history_notes": q_history_notes,              # C36
    "suggestion_notes": q_suggestion_notes,        # C36
}
