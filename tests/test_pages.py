"""Saved response pages: the client's rules for arrays, other bodies, errors and the last page."""

import datetime as dt
import json

import pytest

from outletlens.sources.pages import read_pages

PRODUCTS = "catalog_get_products"


def save(root, pages, function=PRODUCTS):
    (root / function).mkdir(parents=True)
    for k, body in enumerate(pages):
        (root / function / f"page-{k:05d}.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=k % 2 or None))


def product(i, **more):
    return {"product_id": f"id-{i}", "name": f"Barang {i}", "sku": f"S{i}", "price": 1500.5, "unit": "pcs", **more}


def test_pages_follow_each_other_until_a_short_one(spark, tmp_path):
    save(tmp_path, [[product(0), product(1, price="2000.00", category_name=None)], [product(2), product(3)], [product(4)], [product(5), product(6)]])
    rows = read_pages(spark, str(tmp_path), PRODUCTS, chunk=2).orderBy("page", "pos").collect()
    assert [r.product_id for r in rows] == [f"id-{i}" for i in range(5)]  # the page after a short one was never asked for
    assert [r.pos for r in rows] == [1, 2, 1, 2, 1] and rows[1].price == 2000.0 and rows[0].price == 1500.5
    assert rows[0].photo_thumb_path is None
    rows = read_pages(spark, str(tmp_path), PRODUCTS, chunk=1).collect()
    assert len(rows) == 7  # no page is short


def test_guard_stops_after_50_000_rows(spark, tmp_path):
    save(tmp_path, [[product(i)] * 1000 for i in range(53)])
    df = read_pages(spark, str(tmp_path), PRODUCTS, guard=True)
    assert df.count() == 51_000 and df.select("product_id").distinct().count() == 51


def test_history_types(spark, tmp_path):
    save(tmp_path, [[product(1, order_count=3, total_qty="12", last_ordered="2026-07-01")]], "catalog_get_history")
    r = read_pages(spark, str(tmp_path), "catalog_get_history").first()
    assert (r.order_count, r.total_qty, r.last_ordered) == (3, 12, dt.date(2026, 7, 1))


@pytest.mark.parametrize("body", ["{}", "null", "3", '"text"', '{"rows": [1]}', " [] ", '{"message": "only a message"}'])
def test_a_body_that_is_no_array_gives_no_rows(spark, tmp_path, body):
    save(tmp_path, [body])
    assert read_pages(spark, str(tmp_path), PRODUCTS).count() == 0


@pytest.mark.parametrize("body", ['{"code": "42501", "message": "permission denied", "details": null, "hint": null}', "<html>bad gateway</html>", " "])
def test_an_error_body_stops_the_job_and_names_the_function(spark, tmp_path, body):
    save(tmp_path, [[product(1)], body])
    with pytest.raises(Exception, match=PRODUCTS):
        read_pages(spark, str(tmp_path), PRODUCTS, chunk=1).collect()


def test_a_malformed_array_stops_the_job(spark, tmp_path):
    save(tmp_path, ['[{"product_id": "a"'])
    with pytest.raises(Exception):
        read_pages(spark, str(tmp_path), PRODUCTS).collect()
