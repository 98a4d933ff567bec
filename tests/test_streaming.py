"""Streaming forms (C16 keyed state, C2 per-batch token lookup) equal the batch forms."""

import shutil

from pyspark.sql import functions as F

from outletlens.operators import catalog as C
from outletlens.operators import orders as O
from outletlens.sources.ledger import CART_EVENTS
from outletlens.streaming.cart import current_cart, start_cart_stream
from outletlens.streaming.links import start_link_stream


def _chunks(df, col, path, n=3):
    """Write ``df`` as ``n`` files in ``col`` order (arrival order of a change log)."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    step = (hi - lo) // n + 1
    for i in range(n):
        part = df.filter((F.col(col) >= lo + i * step) & (F.col(col) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("overwrite").parquet(f"{path}/chunk={i}")


def test_cart_stream_equals_batch(spark, ledger_small, tmp_path):
    src = tmp_path / "events"
    ev = ledger_small.cart_events
    _chunks(ev, "seq", str(src))
    stream = (spark.readStream.schema(CART_EVENTS).option("maxFilesPerTrigger", 1)
              .parquet(str(src / "chunk=*")))
    q = start_cart_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(240)
    assert q.exception() is None
    got = {tuple(r) for r in current_cart(spark, str(tmp_path / "out")).select(
        "outlet_id", "product_id", "qty", "unit", "position").collect()}
    want = {tuple(r) for r in O.cart_state(ev).select(
        "outlet_id", "product_id", "qty", "unit", "position").collect()}
    assert got == want and len(want) > 0


def test_link_stream_sees_rotation(spark, ledger_small, tmp_path):
    tok = ledger_small.customers.filter(F.col("id") == 3).first().catalog_token
    src = tmp_path / "opens"
    spark.createDataFrame([(f"/t/{tok}",), ("/t/nope",)], "path string").write.parquet(str(src / "a"))
    current = {"L": ledger_small}
    stream = spark.readStream.schema("path string").parquet(str(src / "*"))
    q = start_link_stream(stream, lambda: current["L"], str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    res = {r.path: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert res == {f"/t/{tok}": "ready", "/t/nope": "invalid"}
    # rotate outlet 3's token: the next batch no longer resolves the old link
    rotated = ledger_small.customers.withColumn(
        "catalog_token", F.when(F.col("id") == 3, F.md5(F.lit("new"))).otherwise(F.col("catalog_token")))
    current["L"] = ledger_small.replace(customers=rotated)
    spark.createDataFrame([(f"/t/{tok}",)], "path string").write.parquet(str(src / "b"))
    q = start_link_stream(stream, lambda: current["L"], str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    statuses = sorted(r.status for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert statuses == ["invalid", "invalid", "ready"]
    assert C.resolve_outlets(current["L"], tok).count() == 0


def test_cart_stream_survives_restart(spark, ledger_small, tmp_path):
    """Stop after part of the log, restart from the same checkpoint with more files:
    the folded cart still equals the batch reduction over the whole log."""
    src, out, ckpt = tmp_path / "events", str(tmp_path / "out"), str(tmp_path / "ckpt")
    ev = ledger_small.cart_events
    _chunks(ev, "seq", str(src), n=4)
    # the first run sees chunks 0-1 only; chunks 2-3 arrive before the restart
    first = tmp_path / "live"
    first.mkdir()
    for i in range(2):
        shutil.copytree(src / f"chunk={i}", first / f"chunk={i}")
    stream = spark.readStream.schema(CART_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(first / "chunk=*"))
    q = start_cart_stream(stream, out, ckpt)
    q.awaitTermination(240)
    assert q.exception() is None
    for i in range(2, 4):
        shutil.copytree(src / f"chunk={i}", first / f"chunk={i}")
    stream = spark.readStream.schema(CART_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(first / "chunk=*"))
    q = start_cart_stream(stream, out, ckpt)
    q.awaitTermination(240)
    assert q.exception() is None
    got = {tuple(r) for r in current_cart(spark, out).select(
        "outlet_id", "product_id", "qty", "unit", "position").collect()}
    want = {tuple(r) for r in O.cart_state(ev).select(
        "outlet_id", "product_id", "qty", "unit", "position").collect()}
    assert got == want and len(want) > 0
