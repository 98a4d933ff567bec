"""Property tests: rewrite = literal form, disjointness, paging, totals, tokens, audits."""

from pyspark.sql import functions as F

from outletlens.operators import audits as A
from outletlens.operators import catalog as C
from outletlens.operators import orders as O
from outletlens.operators import tokens as TK
from outletlens.plans import oracle
from outletlens.sources.ledger import settings_frame

from .conftest import SF0001
from .oracle_compare import duck

# The reference's literal per-outlet form: count of *other* outlets, NOT EXISTS.
LITERAL_C5 = oracle.PRELUDE + """,
cand AS (
  SELECT o.outlet_id, s.product_id, s.name, count(DISTINCT vl.customer_id) AS outlet_count
  FROM outlets o
  JOIN valid_lines vl ON vl.customer_id IS NOT NULL AND vl.customer_id <> o.outlet_id
  JOIN sellable s ON s.product_id = vl.product_id
  WHERE NOT EXISTS (SELECT 1 FROM valid_lines m WHERE m.customer_id = o.outlet_id AND m.product_id = vl.product_id)
  GROUP BY ALL)
SELECT outlet_id, product_id, outlet_count,
  row_number() OVER (PARTITION BY outlet_id ORDER BY outlet_count DESC, name ASC NULLS LAST, product_id) AS pos
FROM cand QUALIFY pos <= 12
"""


def test_rewrite_equals_literal_form(ledger_small):
    got = sorted((r.outlet_id, r.pos, r.product_id, r.outlet_count)
                 for r in C.suggestions(ledger_small).collect())
    want = sorted(tuple(r) for r in duck(SF0001).sql(
        "SELECT outlet_id, pos, product_id, outlet_count FROM (" + LITERAL_C5 + ")").fetchall())
    assert got == want and len(got) == 1632


def test_cold_paths_match(ledger_small, monkeypatch):
    """Distributed ranking (no single-task window) and tiny slot blocks."""
    from outletlens.plans import ranking
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(C, "SLOT_BLOCK", 3)
    got = sorted((r.outlet_id, r.pos, r.product_id) for r in C.suggestions(ledger_small).collect())
    want = sorted(tuple(r) for r in duck(SF0001).sql(
        "SELECT outlet_id, pos, product_id FROM (" + oracle.ORACLE["suggestions"] + ")").fetchall())
    assert got == want


def test_suggestions_never_bought(ledger_small):
    sugg = C.suggestions(ledger_small).select(F.col("outlet_id").alias("customer_id"), "product_id")
    owned = C.valid_purchases(ledger_small).select("customer_id", "product_id")
    assert sugg.join(owned, ["customer_id", "product_id"], "left_semi").count() == 0


def test_limit_clamp(ledger_small):
    assert C.suggestions(ledger_small, limit=0).groupBy("outlet_id").count().agg(F.max("count")).first()[0] == 1
    assert C.suggestions(ledger_small, limit=500).groupBy("outlet_id").count().agg(F.max("count")).first()[0] <= 50


def test_pages_concatenate_to_whole(ledger_small, monkeypatch):
    from outletlens.plans import ranking
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)   # distributed positions
    pos = C.positioned_history(ledger_small)
    whole = pos.count()
    pages = sum(C.page(pos, 7, o).count() for o in range(0, 60, 7))
    per_outlet_max = pos.groupBy("outlet_id").count().agg(F.max("count")).first()[0]
    assert per_outlet_max < 60 and pages == whole
    # positions per outlet are exactly 1..n
    chk = pos.groupBy("outlet_id").agg(F.count("*").alias("n"), F.max("pos").alias("m"),
                                      F.count_distinct("pos").alias("d"))
    assert chk.filter((F.col("n") != F.col("m")) | (F.col("n") != F.col("d"))).count() == 0


def test_order_totals(ledger_small):
    idx = C.product_listing(ledger_small)
    lines = O.order_lines(O.cart_state(ledger_small.cart_events), idx)
    assert lines.filter((F.col("subtotal") % 100) != 0).count() == 0
    summed = lines.groupBy("outlet_id").agg(F.sum("subtotal").alias("s"))
    bad = O.order_summary(lines).join(summed, "outlet_id").filter(F.col("s") != F.col("total"))
    assert bad.count() == 0


def test_issue_and_rotate_tokens(ledger_small, tmp_path):
    snap, issued = TK.issue_tokens(ledger_small, str(tmp_path / "customers_v2"))
    assert issued == ledger_small.customers.filter(F.col("catalog_token").isNull()).count() > 0
    assert snap.filter(~F.col("catalog_token").rlike("^[0-9a-f]{32}$")).count() == 0
    assert TK.token_uniqueness_check(snap).count() == 0
    kept = snap.join(ledger_small.customers.filter(F.col("catalog_token").isNotNull()),
                     ["id", "catalog_token"], "left_semi").count()
    assert kept == ledger_small.customers.filter(F.col("catalog_token").isNotNull()).count()
    # rotation: old token of outlet 1 stops resolving, the new one resolves to it
    old = ledger_small.customers.filter(F.col("id") == 1).first().catalog_token
    rotated = TK.rotate_tokens(ledger_small, ledger_small.spark.createDataFrame([(1,)], "outlet_id bigint"),
                               str(tmp_path / "customers_v3")).collect()
    new = rotated[0].catalog_token
    L2 = ledger_small.replace(customers=ledger_small.spark.read.parquet(str(tmp_path / "customers_v3")))
    assert new != old and C.resolve_outlets(L2, old).count() == 0
    assert [r.outlet_id for r in C.resolve_outlets(L2, new).collect()] == [1]


def test_settings_and_grants(spark):
    existing = settings_frame(spark, [("catalog_whatsapp_number", "628"), ("catalogXfoo", "x"), ("other", "y")])
    seeded = A.seed_settings(existing)
    vals = {r.key: r.value for r in seeded.collect()}
    assert vals["catalog_whatsapp_number"] == "628" and vals["catalog_base_url"] == ""
    keys = [r.key for r in A.settings_list(seeded).collect()]
    assert keys == sorted(keys) and "catalogXfoo" in keys and "other" not in keys
    grants = spark.createDataFrame(
        [("anon", "public", "t1", "SELECT"), ("anon", "public", "t1", "INSERT"), ("anon", "public", "t2", "DELETE"),
         ("authenticated", "public", "t1", "SELECT"), ("authenticated", "public", "t3", "SELECT"),
         ("anon", "other", "t9", "SELECT")], "grantee string, table_schema string, table_name string,"
                                            " privilege_type string")
    assert [(r.table_name, r.privileges) for r in A.privilege_audit(grants).collect()] == [
        ("t1", "INSERT, SELECT"), ("t2", "DELETE")]
    assert A.privileged_table_count(grants).first().table_count == 2


def test_link_resolution_statuses(ledger_small, spark):
    tok = ledger_small.customers.filter(F.col("id") == 2).first().catalog_token
    opens = spark.createDataFrame([(f"/t/{tok}",), (f"/t/{tok}/",), (f"/t/{tok}\n",), ("/t/short",), ("/x",)],
                                  "path string")
    got = [r.status for r in C.resolve_links(ledger_small, opens).collect()]
    assert sorted(got) == ["invalid", "invalid", "invalid", "ready", "ready"]



def test_from_tables_schema_evolution(spark, ledger_small, tmp_path):
    """Ledger-schema tables on disk; a table written before later columns existed still loads."""
    root = tmp_path / "ledger"
    ledger_small.customers.drop("catalog_token_created_at").write.parquet(str(root / "customers"))
    ledger_small.invoices.write.parquet(str(root / "invoices"))
    ledger_small.invoice_items.write.parquet(str(root / "invoice_items"))
    ledger_small.products.drop("photo_thumb_path", "photo_large_path").write.parquet(str(root / "products"))
    ledger_small.categories.write.parquet(str(root / "categories"))
    from outletlens.sources.ledger import Ledger
    L = Ledger.from_tables(spark, str(root))
    assert "photo_thumb_path" in L.products.columns
    assert L.products.filter(F.col("photo_thumb_path").isNotNull()).count() == 0
    assert L.cart_events.count() == 0 and L.app_settings.count() == 0
    assert C.purchase_history(L).count() == C.purchase_history(ledger_small).count()
    got = sorted((r.outlet_id, r.pos, r.product_id) for r in C.suggestions(L).collect())
    want = sorted((r.outlet_id, r.pos, r.product_id) for r in C.suggestions(ledger_small).collect())
    assert got == want


def test_group_position_paths_agree(ledger_small, monkeypatch):
    """Window path and distributed path give the same per-category positions."""
    from outletlens.operators import browse as B
    from outletlens.plans import ranking
    listing = C.product_listing(ledger_small)
    a = sorted((r.category_name, r.pos, r.product_id) for r in B.category_items(listing).collect())
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    b = sorted((r.category_name, r.pos, r.product_id) for r in B.category_items(listing).collect())
    assert a == b and len(a) == 156


def test_snapshot_never_overwrites_its_input(spark, ledger_small, tmp_path):
    import pytest
    from outletlens.sources.sinks import write_order_messages, write_snapshot
    first = write_snapshot(ledger_small.customers, str(tmp_path / "c1"))
    with pytest.raises(ValueError):
        write_snapshot(first.filter(F.col("id") > 3), str(tmp_path / "c1"))
    idx = C.product_listing(ledger_small)
    from outletlens.operators import browse as B
    lines = O.order_lines(O.cart_state(ledger_small.cart_events), B.normalize_products(idx))
    msgs = write_order_messages(O.order_message(lines, C.outlet_profile(ledger_small)), str(tmp_path / "m"))
    assert msgs.count() > 0 and msgs.filter(~F.col("message").startswith("Pesanan ")).count() == 0


def test_search_table_equals_keyword_search(spark, ledger_small):
    """The n-gram equi-join search returns what the literal per-keyword filter does,
    for 1-, 2- and 3+-character keywords, blanks, repeats and keywords no gram matches."""
    from outletlens.operators import browse as B
    idx = B.normalize_products(C.product_listing(ledger_small), "https://x")
    kws = ["ring", "  BLUE ", "SKU-0001", "zzzz", "r", "ed", "all r", "-00", "  ", "0", "q", "LL"]
    want = B.search(idx, kws)
    got = B.search_table(idx, spark.createDataFrame([(k,) for k in kws] * 3, "keyword string"),
                         product_rows=ledger_small.product_count)
    cols = want.columns
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in want.select(*cols).collect())


def test_ledger_tables_push_filters_to_the_scan(spark, ledger_small, tmp_path):
    """With ledger-schema parquet, validity filters reach the scans and only used columns are read."""
    from outletlens.sources.ledger import Ledger
    root = tmp_path / "ledger"
    for t in ["customers", "invoices", "invoice_items", "products", "categories"]:
        getattr(ledger_small, t).write.parquet(str(root / t))
    df = C.purchase_history(Ledger.from_tables(spark, str(root)))
    df.count()
    scans = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    text = "\n".join(scans)
    assert "Not(EqualTo(status,cancelled))" in text
    assert "EqualTo(is_active,true)" in text
    items = [ln for ln in scans if "invoice_id:bigint,product_id:bigint,quantity:bigint>" in ln]
    assert items, "the item scan reads exactly the three used columns"


def test_ledger_from_json_and_orc(spark, ledger_small, tmp_path):
    """JSON lines, JSON arrays and ORC ledgers give the same reads; malformed JSON fails fast."""
    import json

    import pytest

    from outletlens.sources.ledger import Ledger
    tables = ["customers", "invoices", "invoice_items", "products", "categories"]
    for t in tables:
        getattr(ledger_small, t).write.json(str(tmp_path / "jl" / t))
        getattr(ledger_small, t).write.orc(str(tmp_path / "orc" / t))
        rows = [json.loads(x) for x in getattr(ledger_small, t).toJSON().collect()]
        (tmp_path / "arr" / t).mkdir(parents=True)
        (tmp_path / "arr" / t / "part-0.json").write_text(json.dumps(rows))
    want = sorted(tuple(r) for r in C.purchase_history(ledger_small).collect())
    for sub, kw in (("jl", {"fmt": "json"}), ("orc", {"fmt": "orc"}), ("arr", {"fmt": "json", "json_arrays": True})):
        L = Ledger.from_tables(spark, str(tmp_path / sub), **kw)
        assert sorted(tuple(r) for r in C.purchase_history(L).collect()) == want, sub
    bad = tmp_path / "bad"
    for t in tables:
        (bad / t).mkdir(parents=True)
        (bad / t / "part-0.json").write_text('{"id": "not a number"}\n')
    with pytest.raises(Exception):
        Ledger.from_tables(spark, str(bad), fmt="json").customers.collect()


def test_list_search_equals_table_search_and_counts_repeats_once(spark, ledger_small):
    from outletlens.operators import browse as B
    idx = B.normalize_products(C.product_listing(ledger_small), "https://x")
    kws = ["ring", "  BLUE ", "SKU-0001", "zzzz", "r", "ed", "all r", "-00", "  ", "0", "q", "LL"]
    got = B.search(idx, kws + ["ring", "r"])  # a repeated keyword counts once
    table = B.search_table(idx, spark.createDataFrame([(k,) for k in kws], "keyword string"))
    assert sorted(map(str, got.select(*table.columns).collect())) == sorted(map(str, table.collect()))
    ring = got.filter("keyword = 'ring'").collect()
    assert len({r["product_id"] for r in ring}) == len(ring) == min(60, ring[0]["match_count"])


def test_size_check_counts_shared_only_by_file_backed_ledgers(spark):
    from outletlens.sources import ledger as LG
    a = LG.Ledger.from_driver(spark, SF0001)
    n = a.product_count
    b = LG.Ledger.from_driver(spark, SF0001)
    assert b.product_count == n
    assert any(k[0] == f"driver:{SF0001}" and k[1] == "products" for k in spark._outletlens_counts)
    doubled = b.replace(products=b.products.unionByName(b.products))   # same files, twice the rows
    assert doubled.product_count == 2 * n


def test_driver_scans_read_only_the_mapped_columns(spark):
    """Column pruning reaches the driver tables: lineitem is read for the mapped columns only."""
    from __spark_entry__ import queries
    want = {"purchase_history": "struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>",
            "missing_price_list": "struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>"}
    for name, schema in want.items():
        df = queries()[name](spark, SF0001)
        df.count()
        scans = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines()
                 if "FileScan" in ln and "lineitem" in ln]
        assert scans and all(f"ReadSchema: {schema}" in ln for ln in scans), (name, scans)


def _executed(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_plans_limit_before_the_shuffle(spark):
    """C5 per outlet and C13 per keyword: the top-N is limited in each map task
    (partial WindowGroupLimit) and the match count pre-aggregated, before the
    shuffle on the group key, so a hot outlet or keyword is never gathered whole."""
    from __spark_entry__ import queries
    plan = _executed(queries()["suggestions"](spark, SF0001))
    assert any("WindowGroupLimit [outlet_id" in ln and "Partial" in ln for ln in plan.splitlines())
    plan = _executed(queries()["search_log"](spark, SF0001))
    lines = plan.splitlines()
    assert any("WindowGroupLimit [keyword" in ln and "Partial" in ln for ln in lines)
    assert any("partial_count(1)" in ln and "keys=[keyword" in ln for ln in lines)


def test_split_paths_broadcast_the_hot_heads(spark, monkeypatch):
    """Beyond the broadcast bound (forced with tiny bounds) the hot keys go
    through broadcasts and the hot and shuffled parts are unioned: C4 routes
    rows by a broadcast left join on the heavy keys; C5's final attribute join
    splits on ``rank <= HOT_KEYS`` (its owned-rank routing runs inside the
    written (outlet, pos, rank) table)."""
    from __spark_entry__ import queries
    from outletlens.plans import hotkeys
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 8)
    lines = _executed(queries()["purchase_history"](spark, SF0001)).splitlines()
    assert any("Union" in ln for ln in lines)
    assert any("BroadcastHashJoin" in ln and "LeftOuter" in ln for ln in lines)
    lines = _executed(queries()["suggestions"](spark, SF0001)).splitlines()
    assert any("Union" in ln for ln in lines)
    assert any("BroadcastHashJoin [rank" in ln and "BuildRight" in ln for ln in lines)


def test_group_position_null_groups_on_every_path(spark, monkeypatch):
    """Two group columns with NULLs and one hot group: the window path, the
    distributed path and its hot-key split give the same positions."""
    from outletlens.plans import hotkeys, ranking
    df = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") < 300, F.lit("hot"))
        .otherwise(F.lit("b")).alias("g1"),
        F.when(F.col("id") % 5 == 0, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("g2"),
        (F.col("id") * 7 % 11).alias("v"))
    order = [F.col("v").asc(), F.col("id").asc()]

    def run():
        out = ranking.group_position(df, ["g1", "g2"], order)
        return sorted((r.id, r.pos) for r in out.select("id", "pos").collect())

    window = run()
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    distributed = run()
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 1)
    split = run()
    assert window == distributed == split and len(window) == 600
