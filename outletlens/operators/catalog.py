"""Per-outlet catalogue reads (C1-C10), for all outlets in one job.

The reference answers one token per call.  Here each read is one declarative
plan over the whole ledger; the single-token call is the same plan with one
more filter (``outlets=<token>``).

Outlet selection (``outlets``):
  * ``None``            every outlet whose token can resolve (non-NULL, >= 16 chars)
  * ``str``             one token, resolved like the reference (no row if unknown);
                        looked up first, so an unknown token reads no other table,
                        and a known one puts the outlet's id into the scans' filters
  * DataFrame ``token`` a batch of tokens (unresolvable ones drop out)
  * DataFrame ``outlet_id`` outlets given directly (admin jobs)
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.text import store_display_name
from ..plans import hotkeys as HK
from ..plans.ranking import global_rank, group_position
from ..session import materialize
from ..sources.ledger import Ledger

# Fixed values of the reference's read functions.
DEFAULT_PAGE = 1000
MAX_PAGE = 1000
DEFAULT_SUGGESTIONS = 12
MAX_SUGGESTIONS = 50
DRAIN_GUARD_ROWS = 50000
LINK_PATTERN = r"^/t/([A-Za-z0-9_-]+)/?\z"   # '\z': Java '$' also matches before a final newline (T9)

# Suggestion slots are generated in blocks of this size so one outlet's slots
# spread over many tasks.
SLOT_BLOCK = 4096

# Item rows, or history rows made of them, that one task joins, counts or sorts.
JOIN_TASK_ROWS = 250_000

PRODUCT_COLUMNS = ["product_id", "name", "sku", "price", "unit", "category_name"]
PHOTO_COLUMNS = ["photo_thumb_path", "photo_large_path"]


@dataclass(frozen=True)
class Visibility:
    """Options C9/C10: stock filter (M43), price filter (M39), photo columns."""
    require_stock: bool = True
    require_price: bool = False
    include_photos: bool = True

    def product_columns(self) -> list[str]:
        return PRODUCT_COLUMNS + (PHOTO_COLUMNS if self.include_photos else [])


DEFAULT = Visibility()


# ---------------------------------------------------------------------------
# Tokens, links, outlet header
# ---------------------------------------------------------------------------
def usable_tokens(ledger: Ledger) -> DataFrame:
    """(outlet_id, catalog_token) for outlets whose token can resolve."""
    return ledger.customers.filter(P.token_usable()).select(
        F.col("id").alias("outlet_id"), F.col("catalog_token"))


def resolve_tokens(ledger: Ledger, tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """Every input token with its outlet id, NULL when it does not resolve.

    Too-short and NULL tokens get a NULL key and can never match.  The token
    table is outlet-sized and unique on the token, so this is the hot-key
    left join: a link opened very often is a hot key, and NULL keys skip the
    join instead of meeting in one shuffle partition.
    """
    ok = F.col(token_col).isNotNull() & (F.length(token_col) >= P.MIN_TOKEN_LENGTH)
    t = tokens.withColumn("_key", F.when(ok, F.col(token_col)))
    known = usable_tokens(ledger).select("outlet_id", F.col("catalog_token").alias("_key"))
    joined = HK.dimension_join(t, known, "_key", ledger.customer_count, write_facts=False, how="left")
    return joined.select(*tokens.columns, "outlet_id")


def resolve_outlets(ledger: Ledger, outlets=None) -> DataFrame:
    """One column ``outlet_id``: the outlets a read is answered for."""
    known = usable_tokens(ledger)
    if outlets is None:
        return known.select("outlet_id")
    if isinstance(outlets, str):
        if len(outlets) < P.MIN_TOKEN_LENGTH:
            return known.filter(F.lit(False)).select("outlet_id")
        return known.filter(F.col("catalog_token") == F.lit(outlets)).select("outlet_id")
    if "outlet_id" in outlets.columns:
        return outlets.select(F.col("outlet_id").cast(known.schema["outlet_id"].dataType)).dropDuplicates()
    return (resolve_tokens(ledger, outlets.select(F.col("token")))
            .filter(F.col("outlet_id").isNotNull()).select("outlet_id").dropDuplicates())


def find_outlet(ledger: Ledger, token: str):
    """The id of the outlet that holds ``token``, or None: a lookup in the outlet table only."""
    if len(token) < P.MIN_TOKEN_LENGTH:
        return None
    known = usable_tokens(ledger).filter(F.col("catalog_token") == F.lit(token))
    return known.agg(F.min("outlet_id")).first()[0]


def no_rows(ledger: Ledger, *fields: tuple[str, str | T.DataType]) -> DataFrame:
    """An empty frame of these columns, which no plan reads anything for."""
    return ledger.spark.createDataFrame([], T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t) for n, t in fields]))


def _product_fields(ledger: Ledger, vis: "Visibility") -> list[tuple[str, T.DataType]]:
    p = ledger.products.schema
    source = {"product_id": p["id"], "category_name": ledger.categories.schema["name"]}
    return [(c, source.get(c, p[c] if c in p.names else None).dataType) for c in vis.product_columns()]


def outlet_field(ledger: Ledger) -> tuple[str, T.DataType]:
    return "outlet_id", ledger.customers.schema["id"].dataType


def token_from_path(path: Column) -> Column:
    tok = F.regexp_extract(path, LINK_PATTERN, 1)
    return F.nullif(tok, F.lit(""))


def resolve_links(ledger: Ledger, opens: DataFrame, path_col: str = "path") -> DataFrame:
    """Opened path -> token -> outlet -> status ``ready`` / ``invalid``."""
    with_tok = opens.withColumn("token", token_from_path(F.col(path_col)))
    resolved = resolve_tokens(ledger, with_tok)
    return resolved.withColumn(
        "status", F.when(F.col("outlet_id").isNotNull(), F.lit("ready")).otherwise(F.lit("invalid")))


def setting_value(ledger: Ledger, key: str) -> Column:
    """Scalar subquery over the settings table; '' when the key is absent."""
    sub = ledger.app_settings.filter(F.col("key") == F.lit(key)).select(F.max("value"))
    return F.coalesce(sub.scalar(), F.lit(""))


def outlet_profile(ledger: Ledger, outlets=None) -> DataFrame:
    """Display name plus distributor identity for each resolved outlet."""
    cust = ledger.customers.select(F.col("id").alias("outlet_id"), "name", "store_name")
    if isinstance(outlets, str):
        outlet = find_outlet(ledger, outlets)
        cust = cust.filter(F.lit(False) if outlet is None else F.col("outlet_id") == F.lit(outlet))
    else:
        cust = cust.join(resolve_outlets(ledger, outlets), "outlet_id", "left_semi")
    return cust.select(
        "outlet_id",
        store_display_name().alias("store_name"),
        setting_value(ledger, "catalog_distributor_name").alias("distributor_name"),
        setting_value(ledger, "catalog_whatsapp_number").alias("whatsapp_number"),
    )


# ---------------------------------------------------------------------------
# Shared building blocks
# ---------------------------------------------------------------------------
def join_tasks(ledger: Ledger) -> int:
    """Tasks of ``JOIN_TASK_ROWS`` item rows each, at least one a core; 0 when one task can hold all rows."""
    rows = ledger.item_count
    return 0 if rows <= JOIN_TASK_ROWS else max(math.ceil(rows / JOIN_TASK_ROWS), ledger.spark.sparkContext.defaultParallelism)


def valid_purchases(ledger: Ledger, outlet=None, tasks: int = 0) -> DataFrame:
    """Item rows of valid invoices: (customer_id, invoice_id, invoice_date, product_id, quantity).

    With ``outlet`` (an id) those of one outlet: the filter reaches the invoice scan.
    With ``tasks`` both sides are dealt by invoice to that many partitions, which
    are not coalesced.
    """
    inv = ledger.invoices.filter(P.valid_invoice()).select(
        F.col("id").alias("invoice_id"), "customer_id", "invoice_date")
    if outlet is not None:
        inv = inv.filter(F.col("customer_id") == F.lit(outlet))
    items = ledger.invoice_items.select("invoice_id", "product_id", "quantity")
    if tasks:
        items, inv = items.repartition(tasks, "invoice_id"), inv.repartition(tasks, "invoice_id")
    return items.join(inv, "invoice_id")


def bought(ledger: Ledger, outlet=None) -> DataFrame:
    """Distinct (customer, product) pairs with their history aggregates.

    Aggregated on narrow keys before any product attribute is attached, so no
    wide string is shuffled.  An invoice's rows of a pair are folded first, then
    the pair's invoices, one row each.
    A task holds its rows of the join sorted and then hashed by (outlet, product,
    invoice), and those of the second fold hashed by pair, so for a large ledger
    both shares are bounded in rows: partitions coalesced by their compressed
    bytes hold millions.
    """
    tasks = join_tasks(ledger) if outlet is None else 0
    vp = valid_purchases(ledger, outlet, tasks).filter(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
    orders = vp.groupBy("customer_id", "product_id", "invoice_id").agg(
        F.sum("quantity").alias("quantity"), F.max("invoice_date").alias("invoice_date"))
    if tasks:
        orders = orders.repartition(tasks, "customer_id", "product_id")
    return orders.groupBy("customer_id", "product_id").agg(
        F.count("invoice_id").alias("order_count"),
        # Rounded after the sum: quantities may be fractional.
        F.round(F.sum("quantity")).cast("bigint").alias("total_qty"),
        F.max("invoice_date").alias("last_ordered"),
    )


def owned_pairs(ledger: Ledger) -> DataFrame:
    """Distinct (customer_id, product_id) validly bought (no product filter, T12)."""
    vp = valid_purchases(ledger).filter(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
    return vp.select("customer_id", "product_id").distinct()


def with_category(ledger: Ledger, prods: DataFrame) -> DataFrame:
    """Products with their ``category_name`` (NULL without a category).

    A category's products are a hot key, and so are those without one: the
    categories are broadcast within their checked count, beyond it those with
    the most products; products without a category skip the join.
    """
    cats = ledger.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return HK.dimension_join(prods, cats, "category_id", ledger.category_count, write_facts=False, how="left")


def catalog_products(ledger: Ledger, vis: Visibility = DEFAULT) -> DataFrame:
    """Sellable products with their category name (the product side of C4-C6)."""
    prods = ledger.products.filter(P.sellable_product(vis.require_stock, vis.require_price))
    return with_category(ledger, prods).select(F.col("id").alias("product_id"), "name", "sku", "price", "unit", "category_name",
                         *(PHOTO_COLUMNS if vis.include_photos else []))


# ---------------------------------------------------------------------------
# C4 purchase history
# ---------------------------------------------------------------------------
def purchase_history(ledger: Ledger, outlets=None, vis: Visibility = DEFAULT) -> DataFrame:
    """C4: per (outlet, sellable product) distinct valid invoices, quantity, last date."""
    columns = ["outlet_id", *vis.product_columns(), "order_count", "total_qty", "last_ordered"]
    if isinstance(outlets, str):
        outlet = find_outlet(ledger, outlets)
        if outlet is None:
            return no_rows(ledger, outlet_field(ledger), *_product_fields(ledger, vis), ("order_count", "bigint"),
                           ("total_qty", "bigint"), ("last_ordered", ledger.invoices.schema["invoice_date"].dataType))
        # One outlet has a product once: no key of this join is hot.
        mine = bought(ledger, outlet).withColumnRenamed("customer_id", "outlet_id")
        return mine.join(catalog_products(ledger, vis), "product_id").select(*columns)
    ids = resolve_outlets(ledger, outlets).withColumnRenamed("outlet_id", "customer_id")
    b = bought(ledger).join(ids, "customer_id", "left_semi")
    prods = catalog_products(ledger, vis)
    # A popular product is a hot key here (one row per owner): broadcast the
    # products within the checked count, else broadcast the heaviest keys.
    out = HK.dimension_join(b, prods, "product_id", ledger.product_count, tasks=join_tasks(ledger))
    return out.withColumnRenamed("customer_id", "outlet_id").select(*columns)


def history_order() -> list[Column]:
    """count desc, last date desc (NULLs first as in PostgreSQL), name, id."""
    return [F.col("order_count").desc_nulls_first(), F.col("last_ordered").desc_nulls_first(),
            F.col("name").asc_nulls_last(), F.col("product_id").asc_nulls_last()]


def listing_order() -> list[Column]:
    return [F.col("category_name").asc_nulls_last(), F.col("name").asc_nulls_last(),
            F.col("product_id").asc_nulls_last()]


def suggestion_order() -> list[Column]:
    return [F.col("outlet_count").desc_nulls_first(), F.col("name").asc_nulls_last(),
            F.col("product_id").asc_nulls_last()]


# ---------------------------------------------------------------------------
# C5 suggestions: the rank-slot rewrite
# ---------------------------------------------------------------------------
def clamp(value, default: int, lo: int, hi: int) -> int:
    v = default if value is None else int(value)
    return max(lo, min(hi, v))


def owner_counts(pairs: DataFrame) -> DataFrame:
    """(product_id, outlet_count): distinct outlets that validly bought each product."""
    return pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("outlet_count"))


def popular_products(ledger: Ledger, vis: Visibility, counts: DataFrame) -> DataFrame:
    """Sellable products bought by >= 1 outlet, with ``outlet_count``.

    A product shown to an outlet was never bought by it, so the reference's
    count of *other* outlets equals this global distinct-outlet count.
    """
    return catalog_products(ledger, vis).join(counts, "product_id")


def ranked_popularity(ledger: Ledger, vis: Visibility, counts: DataFrame, head: int) -> DataFrame:
    """The ``head`` most popular products with their ``rank``; the rest is never sorted as a whole."""
    pop = popular_products(ledger, vis, counts)
    if head < ledger.product_count:
        pop = pop.orderBy(*suggestion_order()).limit(head)
    return global_rank(pop, suggestion_order(), "rank", size_bound=min(head, ledger.product_count))


def head_size(ledger: Ledger, pairs: DataFrame, n: int) -> int:
    """Ranks that can be shown to some outlet: ``n`` after all that it owns.

    A small product table bounds them without counting; beyond that the largest
    ownership is measured.
    """
    if ledger.product_count <= HK.BROADCAST_ROWS:
        return ledger.product_count
    most = pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return min(ledger.product_count, n + (most or 0))


def _suggestions_for(ledger: Ledger, outlet, n: int, vis: Visibility) -> DataFrame:
    """C5 of one outlet: the top ``n`` popular products without its own; nothing is written."""
    counts = owner_counts(owned_pairs(ledger))
    own = valid_purchases(ledger, outlet).select("product_id").filter(F.col("product_id").isNotNull()).distinct()
    top = popular_products(ledger, vis, counts.join(own, "product_id", "left_anti")).orderBy(*suggestion_order()).limit(n)
    # At most MAX_SUGGESTIONS rows are numbered here.
    return top.select(F.lit(outlet).cast(outlet_field(ledger)[1]).alias("outlet_id"),
                      F.row_number().over(Window.orderBy(*suggestion_order())).cast("bigint").alias("pos"),
                      *vis.product_columns(), "outlet_count")


def suggestions(ledger: Ledger, outlets=None, limit: int | None = DEFAULT_SUGGESTIONS,
                vis: Visibility = DEFAULT) -> DataFrame:
    """Top ``limit`` products each outlet never validly bought, most outlets first.

    Plan: ranks of the most popular products -> per outlet the slots ``1..limit + owned``
    (owned = its sellable bought products, exactly the ranked products it must
    skip) -> anti join owned ranks -> first ``limit`` per outlet -> attributes.
    Linear in outlets x limit + history rows; no cross or theta join.
    """
    n = clamp(limit, DEFAULT_SUGGESTIONS, 1, MAX_SUGGESTIONS)
    if isinstance(outlets, str):
        outlet = find_outlet(ledger, outlets)
        if outlet is None:
            return no_rows(ledger, outlet_field(ledger), ("pos", "bigint"), *_product_fields(ledger, vis), ("outlet_count", "bigint"))
        return _suggestions_for(ledger, outlet, n, vis)
    ids = resolve_outlets(ledger, outlets)
    # The narrow (outlet, product) pairs feed both the popularity rank and the
    # owned side: written once so the ledger join runs once.
    pairs = materialize(owned_pairs(ledger), "pairs")
    counts = owner_counts(pairs)
    # The rank table is used twice (owned ranks, attributes): written once, so its
    # ranking runs once and both uses see the same ranks.  It holds the ranks that
    # some outlet can be shown, and no others.
    head = head_size(ledger, pairs, n)
    pop = materialize(ranked_popularity(ledger, vis, counts, head), "popularity")

    # Already bought, as ranks (trap T12: the owned side has no product filter;
    # unsellable owned products have no rank and cannot be suggested anyway).
    mine = pairs.join(ids.withColumnRenamed("outlet_id", "customer_id"), "customer_id", "left_semi")
    # Hot keys of this join are the most-owned products: a product's rows here
    # are its owners.  The HOT_KEYS heaviest products (sellable or not; a
    # top-k of the owner counts already at hand) are broadcast with their
    # rank, so they never enter a shuffle; every other product has at most
    # |pairs| / HOT_KEYS owners.  When the ranked products are few (their number
    # is checked against BROADCAST_ROWS) the whole rank table is broadcast instead.
    small = head <= HK.BROADCAST_ROWS
    ranks = pop.select("product_id", "rank")
    pairs_mine = mine.select("customer_id", "product_id")
    if small:
        owned = pairs_mine.join(F.broadcast(ranks), "product_id")
    else:
        heavy = counts.orderBy(F.col("outlet_count").desc(), F.col("product_id")).limit(HK.HOT_KEYS)
        owned = HK.split_hot_join(pairs_mine, "product_id", heavy, ranks)
    owned = owned.select(F.col("customer_id").alias("outlet_id"), "rank")
    # Slot count: limit + every product the outlet bought (an upper bound of the
    # ranked ones it must skip).  Slots past the last rank find no product and
    # fall out in the final join, so no global count is needed.
    # Counted for every customer; the left join keeps the asked outlets.
    owned_n = pairs.groupBy(F.col("customer_id").alias("outlet_id")).agg(F.count(F.lit(1)).alias("_owned"))
    need = ids.join(owned_n, "outlet_id", "left").select(
        "outlet_id", (F.lit(n) + F.coalesce(F.col("_owned"), F.lit(0))).alias("_slots"))
    blocks = need.select(
        "outlet_id", "_slots",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("_slots") - 1) / SLOT_BLOCK).cast("int"))).alias("_blk"))
    slots = blocks.repartition("outlet_id", "_blk").select(
        "outlet_id",
        F.explode(F.sequence((F.col("_blk") * SLOT_BLOCK + 1).cast("bigint"),
                             F.least(F.col("_slots"), (F.col("_blk") + 1) * SLOT_BLOCK).cast("bigint"))
                  ).alias("rank"))
    free = slots.join(owned, ["outlet_id", "rank"], "left_anti")
    w = Window.partitionBy("outlet_id").orderBy("rank")
    top = free.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)

    # Nearly every outlet's list holds the first ranks, so those are the hot
    # keys of the attribute join.  Ranks <= HOT_KEYS are broadcast (fixed row
    # bound); a deeper rank r is listed only by outlets owning >= r - n
    # products, at most |pairs| / (HOT_KEYS - n) of them, so the rest shuffles.
    # Both branches read ``top``, so beyond the broadcast bound its narrow
    # (outlet, pos, rank) rows are written once first.
    attrs = vis.product_columns() + ["outlet_count"]
    dim = pop.select("rank", *attrs)
    if small:
        res = top.join(F.broadcast(dim), "rank")
    else:
        top = materialize(top.select("outlet_id", "pos", "rank"), "suggestion_ranks")
        res = HK.split_by_key_join(top, "rank", dim, F.col("rank") <= F.lit(HK.HOT_KEYS))
    return res.select("outlet_id", F.col("pos").cast("bigint").alias("pos"), *attrs)


# ---------------------------------------------------------------------------
# C6 listing, C7 pages, C8 drain
# ---------------------------------------------------------------------------
def product_listing(ledger: Ledger, token: str | None = None, vis: Visibility = DEFAULT) -> DataFrame:
    """Sellable products with category.  Outlet-independent: computed once.

    With ``token`` the listing is gated on the token resolving: an unknown
    token gives zero rows, and no product is read for it.
    """
    if token is not None and find_outlet(ledger, token) is None:
        return no_rows(ledger, *_product_fields(ledger, vis))
    return catalog_products(ledger, vis)


def positioned_listing(ledger: Ledger, vis: Visibility = DEFAULT) -> DataFrame:
    """C6 with its 1-based global listing position (category NULLS LAST, name, id)."""
    return global_rank(product_listing(ledger, vis=vis), listing_order(), "pos",
                       size_bound=ledger.product_count)


def positioned_history(ledger: Ledger, outlets=None, vis: Visibility = DEFAULT) -> DataFrame:
    """C4 with its 1-based per-outlet position in the reference order."""
    # One outlet has at most one history row per product.
    return group_position(purchase_history(ledger, outlets, vis), ["outlet_id"], history_order(), "pos",
                          group_bound=ledger.product_count, tasks=0 if isinstance(outlets, str) else join_tasks(ledger))


def page_bounds(limit=None, offset=None, default: int = DEFAULT_PAGE, hi: int = MAX_PAGE) -> tuple[int, int]:
    """C7 clamps: LIMIT least(greatest(coalesce(n, d), 1), hi) OFFSET greatest(coalesce(o, 0), 0)."""
    n = clamp(limit, default, 1, hi)
    o = max(0, 0 if offset is None else int(offset))
    return n, o


def page_of(rows: DataFrame, order: list[Column], limit=None, offset=None) -> DataFrame:
    """C7 for one outlet's rows: one page by a total order, cut as rows are sorted (no rank of all)."""
    n, o = page_bounds(limit, offset)
    return rows.orderBy(*order).offset(o).limit(n)


def page(positioned: DataFrame, limit=None, offset=None, pos_col: str = "pos") -> DataFrame:
    """One page of a positioned result (per outlet when it has ``outlet_id``)."""
    n, o = page_bounds(limit, offset)
    return positioned.filter((F.col(pos_col) > o) & (F.col(pos_col) <= o + n))


def with_page_numbers(positioned: DataFrame, limit=None, pos_col: str = "pos") -> DataFrame:
    """C7 batch form: ``page_no = floor((pos - 1) / n)``."""
    n, _ = page_bounds(limit, 0)
    return positioned.withColumn("page_no", F.floor((F.col(pos_col) - 1) / F.lit(n)).cast("bigint"))


def drained(rows: DataFrame, order: list[Column], guard: bool = False, chunk: int = DEFAULT_PAGE) -> DataFrame:
    """C8 for one outlet's rows, in order; with ``guard`` the client's stop (see ``drain``)."""
    rows = rows.orderBy(*order)
    return rows.limit((DRAIN_GUARD_ROWS // chunk + 1) * chunk) if guard else rows


def drain(positioned: DataFrame, chunk: int = DEFAULT_PAGE, guard: bool = False,
          pos_col: str = "pos") -> DataFrame:
    """The rows a page-by-page drain returns.

    Pages stop at the first short page, so that is every row.  With the
    client's guard they also stop once more than 50 000 rows are held, checked
    after appending (so 51 pages of 1 000).
    """
    if not guard:
        return positioned
    pages = DRAIN_GUARD_ROWS // chunk + 1
    return positioned.filter(F.col(pos_col) <= pages * chunk)


def negative_token_check(ledger: Ledger, token: str) -> DataFrame:
    """Row counts of the four reads for one token (all 0 when unknown, and then only the outlet table is read)."""
    spark = ledger.spark
    return spark.range(1).select(
        outlet_profile(ledger, token).select(F.count(F.lit(1))).scalar().alias("outlet_rows"),
        purchase_history(ledger, token).select(F.count(F.lit(1))).scalar().alias("history_rows"),
        product_listing(ledger, token).select(F.count(F.lit(1))).scalar().alias("product_rows"),
        suggestions(ledger, token).select(F.count(F.lit(1))).scalar().alias("suggestion_rows"),
    )
