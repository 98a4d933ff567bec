"""Column expressions and the cart reducer against small Python models of the
client semantics (Math.ceil / Math.round on doubles, Map insertion order)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from outletlens.functions import pricing as PR
from outletlens.functions import text as TX
from outletlens.operators import orders as O


def m_round_up(x):
    return math.ceil((x or 0) / 100) * 100


def m_base_unit(u):
    return u or "pcs"


def m_has_price(p):
    return p is not None and math.isfinite(p) and p > 0


def m_dozen(mode, unit):
    return mode == "lusin" and m_base_unit(unit) == "pcs"


def m_subtotal(qty, price, mode, unit):
    if not m_has_price(price):
        return 0.0
    unit_price = m_round_up(price * 12) if m_dozen(mode, unit) else price
    return float(m_round_up(unit_price * qty))


def m_currency(x):
    n = math.floor((x or 0) + 0.5)
    return "Rp " + f"{n:,}".replace(",", ".")


prices = st.one_of(st.none(), st.just(0.0),
                   st.integers(min_value=1, max_value=10_000_000).map(lambda c: c / 100))
rows = st.lists(st.tuples(st.integers(0, 9999), prices, st.sampled_from(["base", "lusin"]),
                          st.sampled_from(["pcs", "", None, "lusin", "box"])), min_size=1, max_size=80)


@settings(max_examples=8, deadline=None)
@given(rows)
def test_pricing_matches_model(spark, data):
    df = spark.createDataFrame(data, "qty bigint, price double, mode string, unit string")
    got = df.select(PR.line_subtotal("qty", "price", "mode", "unit").alias("s"),
                    PR.unit_label("mode", "unit").alias("l"),
                    TX.format_currency(PR.line_subtotal("qty", "price", "mode", "unit")).alias("c")).collect()
    for (qty, price, mode, unit), r in zip(data, got):
        want = m_subtotal(qty, price, mode, unit)
        assert r.s == want
        assert r.l == ("lusin" if m_dozen(mode, unit) else m_base_unit(unit))
        assert r.c == m_currency(want)


def m_cart(events):
    """JS Map semantics: set keeps an existing key's place, delete + set moves it last."""
    cart = {}
    for seq, product, qty, unit in sorted(events):
        if qty == 0:
            cart.pop(product, None)
        else:
            cart[product] = (qty, unit)
    return [(p, q, u) for p, (q, u) in cart.items()]


events = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.sampled_from(["base", "lusin"])),
                  min_size=1, max_size=60)


@settings(max_examples=8, deadline=None)
@given(events)
def test_cart_matches_map_model(spark, data):
    ev = [(seq, 7, p, q, u) for seq, (p, q, u) in enumerate(data)]
    df = spark.createDataFrame(ev, "seq bigint, outlet_id bigint, product_id bigint, qty bigint, unit string")
    got = [(r.product_id, r.qty, r.unit) for r in O.cart_state(df).orderBy("position").collect()]
    assert got == m_cart([(s, p, q, u) for s, _, p, q, u in ev])
