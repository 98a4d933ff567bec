"""C23 for arriving outlets and C25 as a constraint on what becomes visible."""

import pytest
from pyspark.sql import functions as F

from outletlens.operators import tokens as TK
from outletlens.sources.ledger import CUSTOMERS, Ledger
from outletlens.sources.versions import AuditFailed, Versions
from outletlens.streaming.tokens import current_customers, issue_batch, start_token_stream

ROW = "id bigint, name string, store_name string, catalog_token string"


def outlets(spark, rows):
    return spark.createDataFrame([(i, f"name {i}", None, t) for i, t in rows], ROW)


def tokens(df):
    return {r.id: r.catalog_token for r in df.collect()}


def test_each_new_outlet_gets_its_token_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    issue_batch(versions, outlets(spark, [(1, None), (2, "given-token-2-abcdef"), (2, "given-token-2-abcdef"), (None, None)]), 0)
    first = tokens(current_customers(spark, versions.path))
    assert set(first) == {1, 2} and first[2] == "given-token-2-abcdef" and len(first[1]) == 32
    # A retried batch keeps the tokens; known outlets never change.
    issue_batch(versions, outlets(spark, [(1, None), (7, None)]), 0)
    issue_batch(versions, outlets(spark, [(1, "another-token-for-1x"), (2, None), (3, None)]), 1)
    second = tokens(current_customers(spark, versions.path))
    assert set(second) == {1, 2, 3} and {k: second[k] for k in first} == first
    stamped = {r.id: r.catalog_token_created_at for r in current_customers(spark, versions.path).collect()}
    assert stamped[1] is not None and stamped[2] is None  # stamped when issued here
    assert current_customers(spark, versions.path).schema == CUSTOMERS


def test_an_attempt_that_died_leaves_no_token(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    issue_batch(versions, outlets(spark, [(1, None)]), 0)
    before = tokens(current_customers(spark, versions.path))
    outlets(spark, [(1, "half-written-token-1"), (2, "half-written-token-2")]).write.parquet(f"{versions.path}/data/1")
    assert tokens(current_customers(spark, versions.path)) == before
    issue_batch(versions, outlets(spark, [(2, None)]), 1)
    after = tokens(current_customers(spark, versions.path))
    assert after[1] == before[1] and after[2] != "half-written-token-2"


def test_text_ids(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    row = spark.createDataFrame([("a-1", "n", None, None)], ROW.replace("id bigint", "id string"))
    issue_batch(versions, row, 0)
    assert list(tokens(current_customers(spark, versions.path))) == ["a-1"]


def test_stream_over_files(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        q = start_token_stream(stream, out, ckpt)
        q.awaitTermination(240)
        assert q.exception() is None
        return tokens(current_customers(spark, out))

    for n in range(3):
        outlets(spark, [(n, None), (n + 1, None), (10 + n, f"given-token-{n:08d}")]).coalesce(1).write.parquet(f"{src}/{n}")
    first = run()
    assert set(first) == {0, 1, 2, 3, 10, 11, 12} and len(set(first.values())) == 7
    outlets(spark, [(0, None), (99, None)]).coalesce(1).write.parquet(f"{src}/9")
    second = run()
    assert set(second) == {*first, 99} and {k: second[k] for k in first} == first


def test_a_planted_duplicate_leaves_the_old_snapshot(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    issue_batch(versions, outlets(spark, [(1, "shared-token-0123456"), (2, None)]), 0)
    before = tokens(current_customers(spark, versions.path))
    with pytest.raises(TK.TokenConflict, match="shared-token-0123456"):  # among new and old rows
        issue_batch(versions, outlets(spark, [(3, "shared-token-0123456"), (4, None)]), 1)
    assert versions.published() == [0] and tokens(current_customers(spark, versions.path)) == before
    with pytest.raises(AuditFailed, match="twin-token-012345678"):  # among new rows
        issue_batch(versions, outlets(spark, [(5, "twin-token-012345678"), (6, "twin-token-012345678")]), 1)
    issue_batch(versions, outlets(spark, [(4, None)]), 1)  # the number is free for a sound batch
    assert set(tokens(current_customers(spark, versions.path))) == {1, 2, 4}


def test_publish_customers_numbers_versions(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    TK.publish_customers(versions, outlets(spark, [(1, "a" * 32), (2, None), (3, None)]))
    with pytest.raises(TK.TokenConflict):
        TK.publish_customers(versions, outlets(spark, [(1, "a" * 32), (2, "a" * 32)]))
    TK.publish_customers(versions, outlets(spark, [(1, "b" * 32)]))
    assert versions.published() == [0, 1] and versions.read(versions.latest()).count() == 1


def test_issue_and_rotate_refuse_duplicates(spark, tmp_path):
    """The snapshot at the path, if any, stays as it was."""
    good = Ledger.from_frames(spark, customers=outlets(spark, [(1, "a" * 32), (2, None)]))
    out = str(tmp_path / "snapshot")
    back, issued = TK.issue_tokens(good, out)
    assert issued == 1 and back.count() == 2
    bad = Ledger.from_frames(spark, customers=outlets(spark, [(1, "a" * 32), (2, "a" * 32), (3, None)]))
    with pytest.raises(TK.TokenConflict, match="a" * 32):
        TK.issue_tokens(bad, out)
    with pytest.raises(TK.TokenConflict):
        TK.rotate_tokens(bad, spark.createDataFrame([(3,)], "outlet_id bigint"), out)
    assert spark.read.parquet(out).count() == 2
    rotated = TK.rotate_tokens(bad, spark.createDataFrame([(2,)], "outlet_id bigint"), str(tmp_path / "fixed"))
    assert rotated.count() == 1 and spark.read.parquet(str(tmp_path / "fixed")).filter(F.col("catalog_token") == "a" * 32).count() == 1
