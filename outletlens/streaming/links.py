"""C2 as a stream: opened links resolved against the *current* token table.

Each micro-batch re-reads the token table through ``ledger_factory`` (a
stream-static join that sees rotations: a rotated token stops resolving from
the next batch on).  Output goes to ``out_path/batch_id=N`` with overwrite, so
a retried batch replaces its own files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import resolve_links
from ..sources.ledger import Ledger


def start_link_stream(opens: DataFrame, ledger_factory: Callable[[], Ledger], out_path: str,
                      checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    def sink(df: DataFrame, batch_id: int) -> None:
        resolved = resolve_links(ledger_factory(), df)
        resolved.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = opens.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
