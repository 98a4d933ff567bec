"""Admin data-quality audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..plans import hotkeys as HK
from ..plans.ranking import global_rank
from ..session import materialize
from ..sources.ledger import SETTINGS_ROWS, Ledger, settings_frame
from .catalog import with_category

SETTINGS_PATTERN = "catalog_%"


def _active() -> "F.Column":
    return F.col("is_active") == F.lit(True)


def missing_price_summary(products: DataFrame) -> DataFrame:
    """Active SKUs, unpriced among them, percentage to 1 decimal (NULL if none)."""
    agg = products.agg(
        F.count_if(_active()).alias("active_skus"),
        F.count_if(_active() & P.unpriced()).alias("unpriced_skus"),
    )
    pct = F.round(F.col("unpriced_skus").cast("double") * F.lit(100.0)
                  / F.nullif(F.col("active_skus"), F.lit(0)).cast("double"), 1)
    return agg.withColumn("unpriced_pct", pct)


def missing_price_list(ledger: Ledger) -> DataFrame:
    """Active unpriced products with non-cancelled invoice count and last sale.

    Grouped by (sku, name, category, unit), not by id (T13); ``pos`` numbers the
    groups in the reference's order, most invoices first, then name (ties by the
    other columns).  A dictionary gives each group one narrow id, its smallest
    product id.  Sales are found with inner joins (items -> group ids ->
    non-cancelled invoices), so no string passes through the facts' shuffle, and
    counted in two levels, (group, invoice) and group.  The strings come back
    last, in a join of one row a group, where never-sold groups count 0.
    """
    keys = ["sku", "name", "category_name", "unit"]
    raw = ledger.products.filter(_active() & P.unpriced())
    # NULLs are equal in a group, so the four columns are one struct key.
    prods = with_category(ledger, raw).select(F.col("id").alias("product_id"), F.struct(*keys).alias("_g"))
    groups = materialize(prods.groupBy("_g").agg(F.min("product_id").alias("_gid")), "price_groups")
    member = prods.join(groups, "_g").select("product_id", "_gid")
    items = ledger.invoice_items.select("invoice_id", "product_id")
    inv = ledger.invoices.filter(F.col("status") != F.lit("cancelled")).select(
        F.col("id").alias("invoice_id"), "invoice_date")
    # Unpriced products are a subset of the products: broadcast within the
    # checked product count, else the hot-key join over the item scan.
    sold = (HK.dimension_join(items, member, "product_id", ledger.product_count, write_facts=False)
            .join(inv, "invoice_id")
            .groupBy("_gid", "invoice_id").agg(F.max("invoice_date").alias("_d"))
            .groupBy("_gid").agg(F.count(F.lit(1)).alias("invoice_count"), F.max("_d").alias("last_sold")))
    listed = groups.join(sold, "_gid", "left").select(
        *[F.col(f"_g.{k}").alias(k) for k in keys],
        F.coalesce(F.col("invoice_count"), F.lit(0)).cast("bigint").alias("invoice_count"), "last_sold")
    order = [F.col("invoice_count").desc()] + [F.col(k).asc_nulls_last() for k in ("name", "sku", "category_name", "unit")]
    return global_rank(listed, order, "pos", size_bound=ledger.product_count)


def stock_split(products: DataFrame) -> DataFrame:
    """Active products with and without stock."""
    stock = F.coalesce(F.col("stock_quantity"), F.lit(0))
    return products.filter(_active()).agg(
        F.count_if(stock > 0).alias("in_stock"),
        F.count_if(stock <= 0).alias("out_of_stock"),
    )


def photo_coverage(products: DataFrame) -> DataFrame:
    """Active products with a photo, and all active products."""
    return products.filter(_active()).agg(
        F.count_if(F.col("photo_thumb_path").isNotNull()).alias("with_photo"),
        F.count(F.lit(1)).alias("active_products"),
    )


def settings_list(settings: DataFrame) -> DataFrame:
    """Catalogue settings (``LIKE 'catalog_%'``: '_' matches any character)."""
    return settings.filter(F.col("key").like(SETTINGS_PATTERN)).select("key", "value").orderBy("key")


def seed_settings(existing: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Insert default keys that are absent; existing rows are kept as they are."""
    if defaults is None:
        defaults = settings_frame(existing.sparkSession, [(k, "") for k, _ in SETTINGS_ROWS])
    cols = ["key", "value", "updated_at"]
    add = defaults.select(*cols).join(existing.select("key"), "key", "left_anti")
    return existing.select(*cols).unionByName(add.select(*cols))


def privilege_audit(grants: DataFrame, grantee: str = "anon", schema: str = "public") -> DataFrame:
    """Per table, the ordered comma-joined privileges of one grantee."""
    g = grants.filter((F.col("grantee") == grantee) & (F.col("table_schema") == schema))
    return g.groupBy("table_name").agg(
        F.array_join(F.array_sort(F.collect_list("privilege_type")), ", ").alias("privileges")
    ).orderBy("table_name")


def privileged_table_count(grants: DataFrame, grantee: str = "authenticated", schema: str = "public") -> DataFrame:
    """Number of distinct tables one grantee holds privileges on."""
    g = grants.filter((F.col("grantee") == grantee) & (F.col("table_schema") == schema))
    return g.agg(F.count_distinct("table_name").alias("table_count"))
