"""C23 for arriving outlets: each new one gets its token exactly once.

Rows of ``customers`` arrive in micro-batches.  Version N of a ``Versions`` table
holds all outlets up to batch N: those of the version before, unchanged, and the
batch's new ones, with a fresh token where they bring none.  A retried batch finds
its version published and keeps the tokens in it; tokens of an attempt that died
were visible to nobody.  A version whose tokens are not unique among old and new
outlets is not published: the stream stops with ``TokenConflict``.

An outlet that is known already is never changed, whatever arrives for it.  Of
several rows of one new outlet in a batch the least row counts; rows without an
id name no outlet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokens import publish_customers, with_issued_tokens
from ..sources.ledger import CUSTOMERS, conform
from ..sources.versions import Versions

KEPT_VERSIONS = 2


def issue_batch(versions: Versions, arrivals: DataFrame, batch_id: int) -> None:
    """Publish version ``batch_id``: the outlets known before it and the batch's new ones."""
    known = versions.published()
    if batch_id in known:
        return
    before = [n for n in known if n < batch_id]
    rows = conform(arrivals, CUSTOMERS).filter(F.col("id").isNotNull())
    others = [c for c in rows.columns if c != "id"]
    # The least row by an aggregate, so many rows of one outlet do not meet in one task.
    rows = rows.groupBy("id").agg(F.min(F.struct(*others)).alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in others])
    old = versions.read(before[-1]) if before else None
    if old is not None:
        rows = rows.join(old.select("id"), "id", "left_anti")
    rows = with_issued_tokens(rows).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    publish_customers(versions, rows if old is None else old.unionByName(rows), batch_id)
    versions.drop_before((before[-KEPT_VERSIONS + 1:] or [batch_id])[0])


def start_token_stream(arrivals: DataFrame, out_path: str, checkpoint_location: str,
                       available_now: bool = True) -> StreamingQuery:
    """Issue tokens to arriving outlets; ``out_path`` holds the versions."""
    def sink(df: DataFrame, batch_id: int) -> None:
        issue_batch(Versions(df.sparkSession, out_path), df, batch_id)

    w = arrivals.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_customers(spark: SparkSession, out_path: str) -> DataFrame:
    """All outlets seen so far, in the ledger's schema."""
    versions = Versions(spark, out_path)
    last = versions.latest()
    if last is None:
        raise ValueError(f"no customers snapshot at {out_path}")
    return conform(versions.read(last), CUSTOMERS)
