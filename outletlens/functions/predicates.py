"""Row predicates shared by the catalogue reads (SQL three-valued logic kept)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN_LENGTH = 16


def valid_invoice(status: str = "status", verification: str = "verification_status") -> Column:
    """Not cancelled (a NULL status is dropped) and not rejected (NULL is kept)."""
    return (F.col(status) != F.lit("cancelled")) & (
        F.coalesce(F.col(verification), F.lit("")) != F.lit("rejected"))


def sellable_product(require_stock: bool = True, require_price: bool = False,
                     active: str = "is_active", stock: str = "stock_quantity",
                     price: str = "price") -> Column:
    """``is_active = true`` (NULL dropped), optionally in stock and priced."""
    cond = F.col(active) == F.lit(True)
    if require_stock:
        cond = cond & (F.coalesce(F.col(stock), F.lit(0)) > 0)
    if require_price:
        cond = cond & (F.col(price) > 0)
    return cond


def unpriced(price: str = "price") -> Column:
    return F.coalesce(F.col(price), F.lit(0.0)) <= 0


def token_usable(token: str = "catalog_token") -> Column:
    """A token can resolve only when present and at least 16 characters long."""
    return F.col(token).isNotNull() & (F.length(F.col(token)) >= MIN_TOKEN_LENGTH)
