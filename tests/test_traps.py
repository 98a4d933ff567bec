
import datetime as dt

from pyspark.sql import functions as F

from outletlens.functions import pricing as PR
from outletlens.functions import text as TX
from outletlens.operators import audits as A
from outletlens.operators import catalog as C
from outletlens.operators import orders as O
from outletlens.sources.ledger import Ledger


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_t1_double_rounding(spark):
    assert one(spark, PR.round_up_100(F.lit(16.1) * F.lit(1000.0))) == 16200.0
    assert one(spark, PR.round_up_100(F.lit(None).cast("double"))) == 0.0


def test_t2_t3_null_order_and_ties(spark):
    rows = [(1, "b", 2, None), (2, "a", 2, dt.date(2024, 1, 1)), (3, "a", 2, dt.date(2024, 1, 1)), (4, "c", 3, None)]
    df = spark.createDataFrame(rows, "product_id bigint, name string, order_count bigint, last_ordered date")
    df = df.withColumn("outlet_id", F.lit(1))
    got = C.group_position(df, ["outlet_id"], C.history_order()).orderBy("pos").collect()
    # count desc; last date desc with NULLs first (PostgreSQL); then name; then id
    assert [r.product_id for r in got] == [4, 1, 2, 3]


def test_t4_sum_stays_bigint(spark):
    L = Ledger.from_frames(
        spark,
        customers=spark.createDataFrame([(1, "A", "A", "t" * 32)], "id bigint, name string, store_name string,"
                                                                   " catalog_token string"),
        invoices=spark.createDataFrame([(10, 1, dt.date(2024, 1, 1), "paid", None)],
                                       "id bigint, customer_id bigint, invoice_date date, status string,"
                                       " verification_status string"),
        invoice_items=spark.createDataFrame([(10, 5, 3), (10, 5, 4)], "invoice_id bigint, product_id bigint,"
                                                                      " quantity bigint"),
        products=spark.createDataFrame([(5, "P", "S", 1.0, "pcs", None, True, 9, None, None)],
                                       "id bigint, name string, sku string, price double, unit string,"
                                       " category_id string, is_active boolean, stock_quantity bigint,"
                                       " photo_thumb_path string, photo_large_path string"),
    )
    r = C.purchase_history(L).collect()
    assert [(x.order_count, x.total_qty) for x in r] == [(1, 7)]   # T17 duplicate rows: distinct invoices
    assert dict(C.purchase_history(L).dtypes)["total_qty"] == "bigint"


def test_t5_mode_not_unit_text(spark):
    assert one(spark, PR.price_for_unit(F.lit(470000.0), F.lit("lusin"), F.lit("lusin"))) == 470000.0
    assert one(spark, PR.unit_label(F.lit("lusin"), F.lit("lusin"))) == "lusin"
    assert one(spark, PR.price_for_unit(F.lit(100.0), F.lit("lusin"), F.lit(""))) == 1200.0   # '' -> pcs


def test_t6_cart_delete_and_readd(spark):
    ev = spark.createDataFrame(
        [(1, 1, 100, 2, "base"), (2, 1, 200, 1, "base"), (3, 1, 100, 0, "lusin"),   # delete 100
         (4, 1, 100, 3, "lusin"), (5, 1, 200, 5, "lusin"),                           # re-add 100; update 200
         (6, 1, 300, 0, "base")],                                                     # delete of absent 300
        "seq bigint, outlet_id bigint, product_id bigint, qty bigint, unit string")
    got = {(r.product_id): (r.qty, r.unit, r.position) for r in O.cart_state(ev).collect()}
    assert got == {100: (3, "lusin", 4), 200: (5, "lusin", 2)}


def test_t7_js_trim(spark):
    assert one(spark, TX.clean_keyword(F.lit("  MasKer\t\n"))) == "masker"


def test_t8_uri_encoding(spark):
    assert one(spark, TX.encode_uri_component(F.lit("a b!~'()*+-_.\n"))) == "a%20b!~'()*%2B-_.%0A"


def test_t9_path_end(spark):
    assert one(spark, C.token_from_path(F.lit("/t/abc_-9/"))) == "abc_-9"
    assert one(spark, C.token_from_path(F.lit("/t/abc\n"))) is None
    assert one(spark, C.token_from_path(F.lit("/t/abc/x"))) is None


def test_t10_unpriced_subtotal_zero(spark):
    assert one(spark, PR.line_subtotal(F.lit(3), F.lit(0.0), F.lit("base"), F.lit("pcs"))) == 0.0
    assert one(spark, PR.line_subtotal(F.lit(3), F.lit(101.0), F.lit("base"), F.lit("pcs"))) == 400.0


def _ledger(spark, items, products=None):
    return Ledger.from_frames(
        spark,
        customers=spark.createDataFrame([(1, "A", None, "a" * 32), (2, "B", "", "b" * 32), (3, "C", "C", "c" * 32)],
                                        "id bigint, name string, store_name string, catalog_token string"),
        invoices=spark.createDataFrame([(10, 1, dt.date(2024, 1, 1), "paid", None),
                                        (20, 2, dt.date(2024, 1, 2), "paid", "approved"),
                                        (30, 3, dt.date(2024, 1, 3), "cancelled", None)],
                                       "id bigint, customer_id bigint, invoice_date date, status string,"
                                       " verification_status string"),
        invoice_items=spark.createDataFrame(items, "invoice_id bigint, product_id bigint, quantity bigint"),
        products=products or spark.createDataFrame(
            [(p, f"P{p}", f"S{p}", 10.0, "pcs", None, True, 5, None, None) for p in range(1, 6)],
            "id bigint, name string, sku string, price double, unit string, category_id string,"
            " is_active boolean, stock_quantity bigint, photo_thumb_path string, photo_large_path string"),
    )


def test_t11_null_product_does_not_empty_suggestions(spark):
    L = _ledger(spark, [(10, None, 1), (10, 1, 1), (20, 2, 1), (20, 3, 1)])
    got = {(r.outlet_id, r.product_id) for r in C.suggestions(L).collect()}
    assert (1, 2) in got and (1, 3) in got and (2, 1) in got
    assert (3, 1) in got   # outlet 3's only invoice is cancelled: it owns nothing


def test_t12_owned_side_ignores_sellability(spark):
    prods = spark.createDataFrame(
        [(1, "P1", "S1", 10.0, "pcs", None, True, 0, None, None),     # out of stock now
         (2, "P2", "S2", 10.0, "pcs", None, True, 5, None, None)],
        "id bigint, name string, sku string, price double, unit string, category_id string,"
        " is_active boolean, stock_quantity bigint, photo_thumb_path string, photo_large_path string")
    L = _ledger(spark, [(10, 1, 1), (10, 2, 1), (20, 2, 1)], prods)
    got = {(r.outlet_id, r.product_id, r.outlet_count) for r in C.suggestions(L).collect()}
    assert got == {(3, 2, 2)}   # P1 unsellable; P2 bought by 1 and 2


def test_t13_missing_price_groups_by_attributes(spark):
    prods = spark.createDataFrame(
        [(1, "Same", "S", 0.0, "pcs", None, True, 5, None, None),
         (2, "Same", "S", None, "pcs", None, True, 5, None, None)],
        "id bigint, name string, sku string, price double, unit string, category_id string,"
        " is_active boolean, stock_quantity bigint, photo_thumb_path string, photo_large_path string")
    L = _ledger(spark, [(10, 1, 1), (20, 2, 1), (30, 2, 1)], prods)
    r = A.missing_price_list(L).collect()
    assert len(r) == 1 and r[0].invoice_count == 2   # cancelled invoice 30 is not counted


def test_t14_search_sorts_by_locale_not_by_code_point(spark):
    """Mixed case and accents: 'a' and 'A' together, an accented letter next to its base letter."""
    from outletlens.operators import browse as B
    names = ["Zebra", "apel", "Éclair", "Anggur", "élan", "edam", "äpfel", "zaitun", "Edamer", "Ångström"]
    idx = spark.createDataFrame([(i, n, "SKU", 1.0, "pcs", "C", None, None) for i, n in enumerate(names)],
                                "product_id bigint, name string, sku string, price double, unit string,"
                                " category_name string, photo_thumb_url string, photo_large_url string")
    want = ["Anggur", "Ångström", "apel", "äpfel", "Éclair", "edam", "Edamer", "élan", "zaitun", "Zebra"]
    got = [r.name for r in B.search(idx, ["sku"]).orderBy("pos").collect()]
    assert got == want and sorted(names) != want
    keywords = spark.createDataFrame([("sku",)], "keyword string")
    assert [r.name for r in B.search_table(idx, keywords).orderBy("pos").collect()] == want
    cats = B.category_rollup(idx.withColumn("category_name", idx.name)).collect()
    assert [r.category_name for r in cats] == want


def test_t15_t16_nan_and_null_price(spark):
    assert one(spark, PR.has_price(F.lit(float("nan")))) is False
    assert one(spark, PR.has_price(F.lit(float("inf")))) is False
    assert one(spark, PR.has_price(F.lit(None).cast("double"))) is False
    assert one(spark, TX.format_currency(F.lit(None).cast("double"))) == "Rp 0"


def test_quantity_cleaning(spark):
    vals = {"12abc": 12, "  -3": 0, "": 0, "99999": 9999, "1e5": 1, "+7": 7, None: 0}
    for raw, want in vals.items():
        assert one(spark, PR.clean_quantity(F.lit(raw).cast("string"))) == want, raw


def test_initial_and_phone(spark):
    assert one(spark, TX.initial(F.lit("  bedak"))) == "B"
    assert one(spark, TX.initial(F.lit(None).cast("string"))) == "?"
    assert one(spark, TX.normalize_phone(F.lit("+62 812-3456-789"))) == "628123456789"
    assert one(spark, TX.short_date(F.lit(None).cast("date"))) == ""


def test_t3_search_ties_follow_listing_order(spark):
    """Equal names keep listing order (raw category NULLS LAST), not the order of
    the displayed category, where blank and NULL both read 'Lainnya'."""
    from outletlens.operators import browse as B
    rows = [(1, "Sabun", None), (2, "Sabun", "Zebra"), (3, "Sabun", ""), (4, "Sabun", "Alpha")]
    listing = spark.createDataFrame(
        [(i, n, f"SKU-{i}", 1000.0, "pcs", c, None, None) for i, n, c in rows],
        "product_id bigint, name string, sku string, price double, unit string, category_name string,"
        " photo_thumb_path string, photo_large_path string")
    idx = B.search_index(listing)
    want = [3, 4, 2, 1]
    got = [r.product_id for r in B.search(idx, ["sabun"]).orderBy("pos").collect()]
    assert got == want
    table = spark.createDataFrame([("sabun",)], "keyword string")
    assert [r.product_id for r in B.search_table(idx, table).orderBy("pos").collect()] == want
