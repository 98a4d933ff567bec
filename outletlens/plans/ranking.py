"""Total-order ranking and per-group positions, safe for any input size.

Both functions first check the size that would land in one task: the whole
input for ``global_rank``, the largest group for ``group_position``.  Within
``SINGLE_TASK_ROWS`` a plain ``row_number`` window is used; over a total order
it is deterministic, so nothing is materialised.  Beyond that bound nothing is
ever gathered into one task:

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
``global_rank`` then range-partitions with a distributed sort, tags each row
with ``monotonically_increasing_id`` (partition index in the upper bits, row
index inside the partition in the lower 33 bits), writes the tagged rows once
to the checkpoint folder so every use reads the same ids (and survives
executor loss), and adds per-partition offsets from a table with one row per
partition.

``group_position`` gives a 1-based position inside each group, computed as the
global rank minus the group's first rank: no group is ever gathered into one
task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .hotkeys import dimension_join

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


# Rows one task may rank with a window: a bound checked before each use.
SINGLE_TASK_ROWS = 100_000


def _rows(bound: DataFrame | int) -> int:
    return bound if isinstance(bound, int) else bound.count()


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank",
                checkpoint: bool = True, single_task_rows: int | None = None,
                size_bound: DataFrame | int | None = None) -> DataFrame:
    """Add a dense 1-based ``rank_col`` by the (total) ``order``.

    The caller must make ``order`` total (end with a unique key), otherwise ties
    are numbered arbitrarily.  ``size_bound`` is an optional cheaper frame with
    at least as many rows as ``df`` (e.g. the dimension it was filtered from),
    counted instead of ``df``, or such a count already known.
    """
    limit = SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows
    if limit > 0 and _rows(df if size_bound is None else size_bound) <= limit:
        return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return _distributed_rank(df, order, rank_col, checkpoint)


def _distributed_rank(df: DataFrame, order: list[Column], rank_col: str, checkpoint: bool, tasks: int = 0) -> DataFrame:
    ordered = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if tasks else df.orderBy(*order)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        tagged = materialize(tagged, "ranked")
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: bounded by the shuffle partition count.
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
    return ranked.withColumn(rank_col, (F.col("_off") + local + F.lit(1)).cast("bigint")).drop(
        "_mid", "_pid", "_off")


def group_position(df: DataFrame, group_cols: list[str], order: list[Column],
                   pos_col: str = "pos", single_task_rows: int | None = None,
                   group_bound: DataFrame | int | None = None, tasks: int = 0) -> DataFrame:
    """1-based position of each row inside its group, by ``order`` (made total by caller).

    Group keys may be NULL; NULLs form one group (null-safe join back).
    ``group_bound`` is an optional frame whose row count bounds the largest
    group (e.g. the product table for one outlet's history), or that count: while
    it is small enough, no group needs counting.  Beyond it the groups are
    counted, as a bound says little about the largest of them.  With ``tasks``
    the rows are dealt to that many partitions, which are not coalesced, so that
    a task sorts a bounded share of them.
    """
    limit = SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows
    if limit > 0:
        small = group_bound is not None and _rows(group_bound) <= limit
        if small or (df.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0) <= limit:
            w = Window.partitionBy(*group_cols).orderBy(*order)
            df = df.repartition(tasks, *group_cols) if tasks else df
            return df.withColumn(pos_col, F.row_number().over(w).cast("bigint"))
    ranked = _distributed_rank(df, [F.col(c).asc_nulls_last() for c in group_cols] + order, "_grank", True, tasks)
    # One struct key per group: NULL group values match each other in it.
    ranked = ranked.withColumn("_gkey", F.struct(*[F.col(c) for c in group_cols]))
    # This path runs because some group is too big for one task, so that group
    # is a hot key of the join back to the first ranks: the hot-key join
    # broadcasts it (or all first ranks, when the groups are few).
    first = materialize(ranked.groupBy("_gkey").agg(F.min("_grank").alias("_first")), "group_first")
    out = dimension_join(ranked, first, "_gkey", first.count(), write_facts=False, tasks=tasks)
    return (out.withColumn(pos_col, (F.col("_grank") - F.col("_first") + F.lit(1)).cast("bigint"))
            .drop("_grank", "_first", "_gkey"))
