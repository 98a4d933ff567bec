"""The reference's per-token calls, with its parameters and clamps.

The four reads (outlet, history, suggestions, products) are the reads of
``operators.catalog`` for one token, paged like the reference and ordered by its
sort, with exactly the reference's result columns.  The token is looked up first:
the outlet's id then filters the scans, a page is cut while one outlet's rows are
sorted, and nothing is written.  ``search_products`` and ``build_order`` are the client-side steps
that follow (keyword search over the listing; order lines, totals and message
from a cart).  An unknown or too-short token gives zero rows in every call.
For many outlets at once use the batch operators directly; these calls are for
switching over one outlet at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import browse as B
from .operators import catalog as C
from .operators import orders as O
from .sources.ledger import Ledger

HISTORY_COLUMNS = C.PRODUCT_COLUMNS + C.PHOTO_COLUMNS + ["order_count", "total_qty", "last_ordered"]
SUGGESTION_COLUMNS = C.PRODUCT_COLUMNS + C.PHOTO_COLUMNS + ["outlet_count"]
PRODUCT_COLUMNS = C.PRODUCT_COLUMNS + C.PHOTO_COLUMNS


def _cols(vis: C.Visibility, cols: list[str]) -> list[str]:
    return [c for c in cols if vis.include_photos or c not in C.PHOTO_COLUMNS]


def get_outlet(ledger: Ledger, token: str) -> DataFrame:
    """(store_name, distributor_name, whatsapp_number): one row, or none."""
    return C.outlet_profile(ledger, token).select("store_name", "distributor_name", "whatsapp_number")


def get_history(ledger: Ledger, token: str, limit: int | None = C.DEFAULT_PAGE, offset: int | None = 0,
                vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """One page of the outlet's purchase history (limit clamped 1..1000, offset >= 0)."""
    rows = C.page_of(C.purchase_history(ledger, token, vis), C.history_order(), limit, offset)
    return rows.select(*_cols(vis, HISTORY_COLUMNS))


def get_suggestions(ledger: Ledger, token: str, limit: int | None = C.DEFAULT_SUGGESTIONS,
                    vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """The outlet's top suggestions (limit default 12, clamped 1..50)."""
    return C.suggestions(ledger, token, limit, vis).orderBy("pos").select(*_cols(vis, SUGGESTION_COLUMNS))


def get_products(ledger: Ledger, token: str, limit: int | None = C.DEFAULT_PAGE, offset: int | None = 0,
                 vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """One page of the sellable listing, only when the token resolves."""
    rows = C.page_of(C.product_listing(ledger, token, vis), C.listing_order(), limit, offset)
    return rows.select(*_cols(vis, PRODUCT_COLUMNS))


def get_history_all(ledger: Ledger, token: str, vis: C.Visibility = C.DEFAULT, guard: bool = False) -> DataFrame:
    """The drained history: every page until a short one (with ``guard``, the client's 50 000-row stop)."""
    rows = C.drained(C.purchase_history(ledger, token, vis), C.history_order(), guard)
    return rows.select(*_cols(vis, HISTORY_COLUMNS))


def get_products_all(ledger: Ledger, token: str, vis: C.Visibility = C.DEFAULT, guard: bool = False) -> DataFrame:
    """The drained listing (the client's full-listing fetch)."""
    rows = C.drained(C.product_listing(ledger, token, vis), C.listing_order(), guard)
    return rows.select(*_cols(vis, PRODUCT_COLUMNS))


def get_landing(ledger: Ledger, token: str, vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """The list the client opens first (``history``, else ``new``, else ``all``)
    with the three list sizes; no row for an unknown token."""
    return B.landing_summary(ledger, token, vis).select(
        "history_count", "suggestion_count", "product_count", "landing")


def search_products(ledger: Ledger, token: str, keyword: str, storage_base_url: str | None = None,
                    vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """The client search over the outlet's listing: total ``match_count`` and
    the first 60 matches (``pos``) by name; nothing for an unknown token."""
    listing = B.search_index(C.product_listing(ledger, token, vis), storage_base_url)
    return B.search(listing, [keyword]).orderBy("pos").drop("raw_category")


def browse_categories(ledger: Ledger, token: str, cart: DataFrame | None = None,
                      vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """The category browser: ``category_name``, ``item_count`` and ``picked``
    (distinct cart products with qty > 0; 0 without a cart), in locale order.
    ``cart`` has at least ``product_id`` and ``qty``."""
    listing = B.normalize_products(C.product_listing(ledger, token, vis))
    roll = listing.groupBy("category_name").agg(F.count(F.lit(1)).alias("item_count"))
    if cart is None:
        out = roll.withColumn("picked", F.lit(0).cast("bigint"))
    else:
        chosen = cart.filter(F.col("qty") > 0).select("product_id").distinct()
        picked = chosen.join(listing.select("product_id", "category_name"), "product_id").groupBy(
            "category_name").agg(F.count(F.lit(1)).alias("picked"))
        out = roll.join(picked, "category_name", "left").select(
            "category_name", "item_count", F.coalesce(F.col("picked"), F.lit(0)).cast("bigint").alias("picked"))
    return out.orderBy(F.collate(F.coalesce(F.col("category_name"), F.lit("")), B.SORT_COLLATION))


def category_products(ledger: Ledger, token: str, category: str, storage_base_url: str | None = None,
                      vis: C.Visibility = C.DEFAULT) -> DataFrame:
    """The products of one category in listing order (``pos``); an unknown
    category or token gives no rows."""
    rows = B.category_items(C.product_listing(ledger, token, vis), category, storage_base_url,
                            group_bound=ledger.product_count)
    return rows.orderBy("pos")


def build_order(ledger: Ledger, token: str, cart: DataFrame, vis: C.Visibility = C.DEFAULT
                ) -> tuple[DataFrame, DataFrame]:
    """Order lines (C18) and the order message row (C19/C20) for one outlet's cart.

    ``cart`` holds the client's cart map: ``product_id, qty, unit`` (mode
    ``'base'`` or ``'lusin'``) and ``position`` (insertion order).  Products
    outside the listing and zero quantities drop out, as in the client.
    """
    outlet = C.resolve_outlets(ledger, token).select(F.max("outlet_id")).scalar()
    entries = cart.select(outlet.alias("outlet_id"), "product_id", "qty", "unit", "position").filter(
        F.col("outlet_id").isNotNull())
    index = B.normalize_products(C.product_listing(ledger, vis=vis))
    lines = O.order_lines(entries, index).orderBy("position")
    message = O.order_message(lines, C.outlet_profile(ledger, token))
    return lines, message


__all__ = ["get_outlet", "get_history", "get_suggestions", "get_products", "get_history_all",
           "get_products_all", "get_landing", "search_products", "browse_categories", "category_products",
           "build_order"]
