"""Cart, order lines, totals, messages and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing as PR
from ..functions import text as TX
from ..plans import hotkeys as HK

# Message wording.
ORDER_HEADER = "Pesanan "
TOTAL_LABEL = "Total estimasi: "
UNPRICED_NOTE_HEAD = "(belum termasuk "
UNPRICED_NOTE_TAIL = " barang yang harganya dikonfirmasi dulu)"
PRICE_PENDING_TAG = "Harga dikonfirmasi"
PRICE_PENDING_NOTE = "Boleh dipesan, harga menyusul"
SUGGESTION_NOTE_TAIL = " · laris di toko lain"


# A block of a change log holds 2 ** SEQ_BITS consecutive sequence numbers: no task
# folds more changes of one cart entry.
SEQ_BITS = 16
ENTRY = ["outlet_id", "product_id"]


def entry_events(events: DataFrame, seq_bits: int = SEQ_BITS) -> DataFrame:
    """The changes that name a cart entry, with the block of their sequence number."""
    return events.filter(F.col("product_id").isNotNull() & F.col("outlet_id").isNotNull()).select(
        *ENTRY, "seq", F.shiftright("seq", seq_bits).alias("_block"), "qty", "unit")


def _fold(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge run summaries ``(_del, _start, _last, _qty, _dozen)`` by ``keys``.

    A summary covers some changes of an entry: the last delete, the first add
    after it (the first of all without one), the last change with its quantity
    and mode.  Summaries that cover separate stretches of the log merge into one:
    an add counts when it follows the last delete of all.
    """
    runs = runs.withColumn("_cut", F.max("_del").over(Window.partitionBy(*keys)))
    return runs.groupBy(*keys).agg(
        F.expr("max(_del) AS _del"), F.expr("min(CASE WHEN _cut IS NULL OR _start > _cut THEN _start END) AS _start"),
        F.expr("max(_last) AS _last"), F.expr("max_by(_qty, _last) AS _qty"), F.expr("max_by(_dozen, _last) AS _dozen"))


def cart_runs(events: DataFrame, seq_bits: int = SEQ_BITS) -> DataFrame:
    """One run summary per cart entry, also for entries that were deleted."""
    # No quantity deletes, as 0 does.  Mode is a two-valued enum: 0/1 keeps every
    # aggregation buffer fixed-width.
    single = entry_events(events, seq_bits).withColumn("_qty", F.expr("coalesce(qty, 0)")).selectExpr(
        *ENTRY, "_block", "CASE WHEN _qty = 0 THEN seq END AS _del", "CASE WHEN _qty <> 0 THEN seq END AS _start",
        "seq AS _last", "_qty", f"cast(unit = '{PR.MODE_DOZEN}' AS int) AS _dozen")
    return _fold(_fold(single, [*ENTRY, "_block"]), ENTRY)


def cart_state(events: DataFrame, seq_bits: int = SEQ_BITS) -> DataFrame:
    """Reduce a change log ``(outlet_id, seq, product_id, qty, unit)`` to the cart.

    A qty of 0 or NULL deletes the entry; a later add re-inserts it at the end, while
    an update of a present entry keeps its place.  The mode is ``'lusin'`` or
    ``'base'`` (any other value counts as base, as in the pricing rules).  Result per live entry:
    latest ``qty`` and ``unit`` (mode) and ``position`` = first seq after the
    last delete.  The log is read once and joined with nothing: changes of one
    entry and one block of the log are folded into a run summary, then an
    entry's summaries into one.  So a hot (outlet, product) is spread over as
    many tasks as the log has blocks; what meets is one row a block.
    """
    mode = F.when(F.col("_dozen") == 1, F.lit(PR.MODE_DOZEN)).otherwise(F.lit(PR.MODE_BASE))
    return cart_runs(events, seq_bits).filter(F.col("_qty") != 0).select(
        *ENTRY, F.col("_qty").alias("qty"), mode.alias("unit"), F.col("_start").alias("position"))


def live_log(events: DataFrame, seq_bits: int = SEQ_BITS) -> DataFrame:
    """The changes that still matter: each entry's last delete and what follows it.

    ``cart_state`` of it, and of it with any further changes, equals that of the
    whole log, also when these come late (below sequence numbers already seen)
    or again.  Joined on entry and block, so a hot entry is spread here too.
    """
    ev = entry_events(events, seq_bits).dropDuplicates([*ENTRY, "seq"])
    block = [*ENTRY, "_block"]
    cut = ev.groupBy(*block).agg(F.max(F.when(F.coalesce(F.col("qty"), F.lit(0)) == 0, F.col("seq"))).alias("_del"))
    cut = cut.select(*block, F.max("_del").over(Window.partitionBy(*ENTRY)).alias("_cut"))
    return ev.join(cut, block).filter(F.col("_cut").isNull() | (F.col("seq") >= F.col("_cut"))).select(
        *ENTRY, "seq", "qty", "unit")


def _product_join(facts: DataFrame, dim: DataFrame, product_rows: int | None) -> DataFrame:
    """Many-to-one join on product_id; with a product-count bound it is the
    hot-key join (a product in every outlet's cart is a hot key)."""
    if product_rows is None:
        return facts.join(dim, "product_id")
    return HK.dimension_join(facts, dim, "product_id", product_rows)


def order_lines(cart: DataFrame, index: DataFrame, product_rows: int | None = None) -> DataFrame:
    """Cart entries joined with the product index; unknown products and
    zero quantities drop out; dozen pricing, rounded-up subtotals, unpriced flag."""
    prod = index.select("product_id", "name", F.col("price").alias("_price"), F.col("unit").alias("_unit"))
    j = _product_join(cart.filter(F.col("qty") > 0), prod, product_rows)
    priced = PR.has_price("_price")
    unit_price = F.when(priced, PR.price_for_unit("_price", "unit", "_unit")).otherwise(F.lit(0.0))
    return j.select(
        "outlet_id", "position", "product_id", "name", F.col("qty").cast("bigint").alias("qty"),
        PR.unit_label("unit", "_unit").alias("unit"),
        unit_price.alias("unit_price"),
        PR.line_subtotal("qty", "_price", "unit", "_unit").alias("subtotal"),
        (~priced).alias("needs_price"),
    )


def order_summary(lines: DataFrame) -> DataFrame:
    """Per outlet total, number of lines and of unpriced lines."""
    return lines.groupBy("outlet_id").agg(
        F.sum("subtotal").cast("double").alias("total"),
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("needs_price")).alias("needs_price_count"),
    )


def line_text() -> "F.Column":
    tag = F.when(F.col("needs_price"), F.lit(f" ({TX.UNPRICED_LABEL})")).otherwise(F.lit(""))
    return F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("qty").cast("string"), F.lit(" "),
                    F.col("unit"), tag)


def order_message(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """C20: one message per outlet with lines in cart order, total and note.

    ``profile`` is the C3 output (outlet_id, store_name, whatsapp_number).  The
    message is inherently one string per outlet, so its lines are gathered per
    outlet; a message is bounded by the outlet's cart, never by the ledger.
    The URL is NULL when no number is configured (the send button is disabled).
    """
    per = lines.select("outlet_id", F.struct("position", line_text().alias("t")).alias("l"),
                       "subtotal", "needs_price")
    agg = per.groupBy("outlet_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("body"),
        F.sum("subtotal").cast("double").alias("total"),
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("needs_price")).alias("needs_price_count"),
    )
    j = agg.join(profile, "outlet_id")
    note = F.when(F.col("needs_price_count") > 0,
                  F.concat(F.lit("\n" + UNPRICED_NOTE_HEAD), F.col("needs_price_count").cast("string"),
                           F.lit(UNPRICED_NOTE_TAIL))).otherwise(F.lit(""))
    text = F.concat(F.lit(ORDER_HEADER), F.coalesce(F.col("store_name"), F.lit("")), F.lit("\n\n"),
                    F.col("body"), F.lit("\n\n"), F.lit(TOTAL_LABEL), TX.format_currency(F.col("total")), note)
    out = j.select("outlet_id", "line_count", "needs_price_count", "total", text.alias("message"),
                   "whatsapp_number")
    return out.withColumn(
        "message_url",
        F.when(F.coalesce(F.col("whatsapp_number"), F.lit("")) != "",
               TX.message_url(F.col("whatsapp_number"), F.col("message")))).drop("whatsapp_number")


def review_list(lines: DataFrame, index: DataFrame, product_rows: int | None = None) -> DataFrame:
    """The selected products in cart order, with their product rows."""
    return _product_join(lines.select("outlet_id", "position", "product_id"), index, product_rows)


def display_rows(rows: DataFrame, qty: str | None = "qty", mode: str | None = "mode") -> DataFrame:
    """Text a product card shows, from product fields and an optional cart entry.

    ``rows`` has product_id, name, price, unit, category_name (client shape),
    optionally ``qty`` / ``mode`` and the history fields order_count / last_ordered.
    """
    q = F.coalesce(F.col(qty), F.lit(0)) if qty and qty in rows.columns else F.lit(0)
    m = F.coalesce(F.col(mode), F.lit(PR.MODE_BASE)) if mode and mode in rows.columns else F.lit(PR.MODE_BASE)
    priced = PR.has_price("price")
    dozen = PR.is_dozen_mode(m, "unit")
    active = PR.price_for_unit("price", m, "unit")
    label = PR.unit_label(m, "unit")
    tag = F.when(priced, F.concat(TX.format_currency(active), F.lit(" / "), label)).otherwise(
        F.lit(PRICE_PENDING_TAG))
    second = (F.when(PR.supports_dozen("unit") & priced,
                     F.when(dozen, F.concat(TX.format_currency(F.col("price")), F.lit(" / pcs")))
                     .otherwise(F.concat(TX.format_currency(PR.dozen_price("price")), F.lit(" / lusin"))))
              .when(~priced, F.lit(PRICE_PENDING_NOTE)))
    recap = F.when(q > 0, F.concat(
        q.cast("string"), F.lit(" "), label,
        F.when(dozen, F.concat(F.lit(" = "), (q * PR.PCS_PER_DOZEN).cast("string"), F.lit(" pcs")))
        .otherwise(F.lit("")),
        F.lit(" · "),
        F.when(priced, TX.format_currency(PR.round_up_100(q.cast("double") * active)))
        .otherwise(F.lit(TX.UNPRICED_LABEL))))
    out = rows.withColumn("price_tag", tag).withColumn("second_line", second).withColumn(
        "recap", recap).withColumn("initial", TX.initial("name"))
    if "order_count" in rows.columns and "last_ordered" in rows.columns:
        out = out.withColumn("note", F.concat(F.col("order_count").cast("string"), F.lit("× · "),
                                              TX.short_date("last_ordered")))
    elif "outlet_count" in rows.columns:
        out = out.withColumn("note", F.concat(TX.category_or_default("category_name"),
                                              F.lit(SUGGESTION_NOTE_TAIL)))
    return out
