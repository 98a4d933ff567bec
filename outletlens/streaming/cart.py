"""C16 as a stream: a versioned snapshot of the changes that still matter.

Cart changes ``(outlet_id, product_id, seq, qty, unit)`` arrive in micro-batches.
Each is merged into the snapshot by the same folds as the batch reduction
(``orders.live_log``): an entry keeps its last delete, as a tombstone, and the
changes after it.  So the live cart equals ``orders.cart_state`` of everything
that arrived, in whatever order it came: late changes (below sequence numbers
already seen), replayed ones, a delete followed by a replay of older adds.

The snapshot of batch N is version N of a ``Versions`` table; a retried batch
finds its version published and changes nothing, or overwrites what an
unfinished attempt left.  The live cart reads one version, not the batches.

An entry that is changed very often without ever being deleted keeps these
changes, because a late delete could follow any of them.  With ``lateness``
changes that are more than so many sequence numbers behind the newest one are
taken as settled: a later arrival from before that is ignored, and an entry keeps
only the first and the last of its settled changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orders import ENTRY, SEQ_BITS, cart_state, live_log
from ..sources.versions import Versions

CHANGE = [*ENTRY, "seq", "qty", "unit"]
#: Versions that stay for readers that are still at them.
KEPT_VERSIONS = 2


def _settled(log: DataFrame, horizon: int, seq_bits: int) -> DataFrame:
    """Without the changes up to ``horizon`` that no change after it can bring back.

    Of a block's settled changes its first and last stay, then those of all blocks,
    so no entry's changes meet in one task.
    """
    old, deletes = F.col("seq") <= F.lit(horizon), F.coalesce(F.col("qty"), F.lit(0)) == 0
    log = log.withColumn("_block", F.shiftright("seq", seq_bits))
    for keys in ([*ENTRY, "_block"], ENTRY):
        w = Window.partitionBy(*keys)
        log = log.withColumn("_first", F.min(F.when(~deletes, F.col("seq"))).over(w)).withColumn(
            "_last", F.max(F.when(old, F.col("seq"))).over(w)).filter(
            ~old | deletes | (F.col("seq") == F.col("_last")) | F.col("seq").eqNullSafe(F.col("_first")))
    return log.select(*CHANGE)


def merge_batch(versions: Versions, batch: DataFrame, batch_id: int, lateness: int | None = None, seq_bits: int = SEQ_BITS) -> None:
    """Publish version ``batch_id``: the last snapshot before it and the batch, reduced to what matters."""
    known = versions.published()
    if batch_id in known:
        return
    rows, horizon = batch.select(*CHANGE), None
    before = [n for n in known if n < batch_id]
    if before:
        snapshot = versions.read(before[-1])
        if lateness is not None:
            newest = snapshot.agg(F.max("seq")).first()[0]
            horizon = None if newest is None else newest - lateness
            rows = rows if horizon is None else rows.filter(F.col("seq") > F.lit(horizon))
        rows = snapshot.select(*CHANGE).unionByName(rows)
    log = live_log(rows, seq_bits)
    versions.publish(log if horizon is None else _settled(log, horizon, seq_bits), batch_id)
    versions.drop_before((before[-KEPT_VERSIONS + 1:] or [batch_id])[0])


def start_cart_stream(events: DataFrame, out_path: str, checkpoint_location: str, available_now: bool = True,
                      lateness: int | None = None) -> StreamingQuery:
    """Run the reduction; ``out_path`` holds the snapshots."""
    def sink(df: DataFrame, batch_id: int) -> None:
        merge_batch(Versions(df.sparkSession, out_path), df, batch_id, lateness)

    w = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_cart(spark: SparkSession, out_path: str, seq_bits: int = SEQ_BITS) -> DataFrame:
    """The live cart: the last snapshot, reduced."""
    versions = Versions(spark, out_path)
    last = versions.latest()
    if last is None:
        raise ValueError(f"no cart snapshot at {out_path}")
    return cart_state(versions.read(last), seq_bits)
