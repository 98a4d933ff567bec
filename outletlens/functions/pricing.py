"""Unit and price rules as column expressions (all DOUBLE arithmetic, trap T1).

Mode is ``'base'`` or ``'lusin'`` and is never compared with the unit text
(trap T5): only a product whose base unit is exactly ``'pcs'`` can be sold by
the dozen, so a product whose own unit is ``'lusin'`` is never multiplied again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim

# Fixed values of the pricing rules.
PCS_PER_DOZEN = 12
MODE_BASE = "base"
MODE_DOZEN = "lusin"
DOZEN_LABEL = "lusin"
DEFAULT_UNIT = "pcs"
ROUND_STEP = 100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_unit(unit="unit") -> Column:
    return F.coalesce(F.nullif(_c(unit), F.lit("")), F.lit(DEFAULT_UNIT))


def supports_dozen(unit="unit") -> Column:
    return base_unit(unit) == F.lit(DEFAULT_UNIT)


def has_price(price="price") -> Column:
    """Finite and > 0.  NULL -> no; NaN and +inf are excluded explicitly."""
    p = _c(price)
    return (F.coalesce(p, F.lit(0.0)) > 0) & ~F.isnan(F.coalesce(p, F.lit(0.0))) & (
        F.coalesce(p, F.lit(0.0)) != F.lit(float("inf")))


def _number_or_zero(x: Column) -> Column:
    x = F.coalesce(x.cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(x)


def round_up_100(amount) -> Column:
    """ceil(x / 100) * 100 in DOUBLE; NULL / NaN count as 0."""
    return (F.ceil(_number_or_zero(_c(amount)) / F.lit(float(ROUND_STEP))).cast("double")
            * F.lit(float(ROUND_STEP)))


def dozen_price(price="price") -> Column:
    return round_up_100(_c(price).cast("double") * F.lit(float(PCS_PER_DOZEN)))


def is_dozen_mode(mode="mode", unit="unit") -> Column:
    return (F.coalesce(_c(mode), F.lit(MODE_BASE)) == F.lit(MODE_DOZEN)) & supports_dozen(unit)


def price_for_unit(price="price", mode="mode", unit="unit") -> Column:
    return F.when(is_dozen_mode(mode, unit), dozen_price(price)).otherwise(_c(price).cast("double"))


def unit_label(mode="mode", unit="unit") -> Column:
    return F.when(is_dozen_mode(mode, unit), F.lit(DOZEN_LABEL)).otherwise(base_unit(unit))


def pieces(qty="qty", mode="mode", unit="unit") -> Column:
    """Number of pieces shown in dozen mode (``qty * 12``), else NULL."""
    return F.when(is_dozen_mode(mode, unit), _c(qty) * F.lit(PCS_PER_DOZEN))


def line_subtotal(qty="qty", price="price", mode="mode", unit="unit") -> Column:
    """Rounded-up subtotal of a priced line, 0 for an unpriced one."""
    return F.when(has_price(price),
                  round_up_100(price_for_unit(price, mode, unit) * _c(qty).cast("double"))
                  ).otherwise(F.lit(0.0))


def clean_quantity(text="text") -> Column:
    """Typed text -> leading integer (parseInt semantics) or 0, clamped 0..9999."""
    lead = F.regexp_extract(js_trim(_c(text).cast("string")), r"^([+-]?[0-9]+)", 1)
    value = F.nullif(lead, F.lit("")).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(9999.0), F.coalesce(value, F.lit(0.0)))).cast("bigint")
