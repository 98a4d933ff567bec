"""Ledgers beyond one task's share: rows a join task holds are bounded, and computed link keys are worked out once a scan."""

import re

from pyspark.sql import functions as F

from outletlens.operators import catalog as C
from outletlens.plans import hotkeys, ranking
from outletlens.sources.ledger import Ledger

from .test_properties import _executed


def _ledger(spark, **more):
    """6 000 item rows on 1 000 invoices; some ids are NULL and some invoices come twice."""
    invoices = spark.range(1000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL ELSE id % 40 END AS customer_id", "date_add(date'2025-01-01', cast(id % 90 AS int)) AS invoice_date",
                                            "CASE WHEN id % 10 = 0 THEN 'cancelled' ELSE 'paid' END AS status", "CASE WHEN id % 11 = 0 THEN NULL ELSE 'approved' END AS verification_status")
    items = spark.range(6000).selectExpr("CASE WHEN id % 70 = 0 THEN NULL ELSE id % 1000 END AS invoice_id", "CASE WHEN id % 90 = 0 THEN NULL ELSE id % 30 END AS product_id",
                                         "cast(id % 5 AS double) AS quantity")
    return Ledger.from_frames(spark, invoices=invoices.unionByName(invoices.filter("id % 100 = 3")), invoice_items=items, **more)


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_joins_a_bounded_share_a_task(spark, monkeypatch):
    """A task's share of items and invoices does not grow with the ledger."""
    want = sorted(map(tuple, C.bought(_ledger(spark)).collect()))
    monkeypatch.setattr(C, "JOIN_TASK_ROWS", 250, raising=False)
    out = C.bought(_ledger(spark))
    assert len(want) > 100 and sorted(map(tuple, out.collect())) == want
    tasks = re.findall(r"Exchange hashpartitioning\(invoice_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", _executed(out))
    assert tasks and {int(n) for n in tasks} == {24}
    shares = C.valid_purchases(_ledger(spark), tasks=C.join_tasks(_ledger(spark))).groupBy(F.spark_partition_id()).count()
    assert shares.agg(F.max("count")).first()[0] <= 2 * 250


def test_history_folds_joins_and_ranks_a_bounded_share_a_task(spark, monkeypatch):
    """Nor does a task's share of the pairs' fold, of the products' join and of the ranking by outlet."""
    products = spark.range(30).selectExpr("id", "concat('p', id % 9) AS name", "10.0D AS price", "CASE WHEN id % 4 > 0 THEN concat('c', id % 3) END AS category_id", "id % 8 > 0 AS is_active", "5.0D AS stock_quantity")
    customers = spark.range(40).selectExpr("id", "CASE WHEN id % 9 > 0 THEN md5(cast(id AS string)) END AS catalog_token")

    def ledger():
        return _ledger(spark, products=products, customers=customers)

    def rows(df):
        return sorted(map(repr, df.collect()))

    reads = {"fold": lambda: C.bought(ledger()), "join": lambda: C.purchase_history(ledger()), "window": lambda: C.positioned_history(ledger())}
    want = {name: rows(read()) for name, read in reads.items()}
    assert all(len(w) > 50 for w in want.values())
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 2)
    monkeypatch.setattr(C, "JOIN_TASK_ROWS", 250)
    by = {"fold": r"customer_id#\d+L?, product_id#\d+L?", "join": r"product_id#\d+L?", "window": r"outlet_id#\d+L?"}
    for name, read in reads.items():
        out = read()
        assert rows(out) == want[name]
        dealt = re.findall(rf"Exchange hashpartitioning\({by[name]}, (\d+)\), REPARTITION_BY_NUM", _planned(out))
        assert dealt and set(dealt) == {"24"}, name
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    out = C.positioned_history(ledger())
    assert rows(out) == want["window"]


def test_resolving_links_works_a_token_out_once_a_scan(spark, monkeypatch):
    """beyond the broadcast bound no filter repeats the path's pattern, and the links are read twice and counted once."""
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 2)
    customers = spark.range(20).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE md5(cast(id AS string)) END AS catalog_token")
    opens = spark.range(400).selectExpr("id AS open_id", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '/t/short' WHEN id % 7 = 2 THEN concat('/t/', md5(cast(id AS string)), '/x')"
                                        " WHEN id % 3 = 0 THEN concat('/t/', md5('1')) ELSE concat('/t/', md5(cast(id % 25 AS string)), '/') END AS path")
    out = C.resolve_links(Ledger.from_frames(spark, customers=customers), opens)
    want = {}
    for i in range(400):
        outlet = None if i % 7 < 3 else 1 if i % 3 == 0 else i % 25
        known = outlet is not None and outlet < 20 and outlet % 5 != 0
        want[i] = (outlet if known else None, "ready" if known else "invalid")
    assert {r.open_id: (r.outlet_id, r.status) for r in out.collect()} == want
    plan = _executed(out).split("Initial Plan")[0]
    assert "regexp_extract" in plan and not [ln for ln in plan.splitlines() if "Filter" in ln and "regexp_extract" in ln]
