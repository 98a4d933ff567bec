"""Equi-joins whose hot keys are known in advance.

A many-to-one join against a dimension that is too large to broadcast must
shuffle, and a key holding a large share of the many side then lands in one
task.  When the hot keys can be named up front (the head of a popularity
ranking, or a top-k of key counts), their dimension rows form a *head* with a
fixed row bound: it is broadcast, and rows with a hot key never enter a
shuffle.  Only the remaining rows, whose per-key load the caller bounds, are
shuffle-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_HOT = "_hot_key"

# Dimension rows up to which a dimension is broadcast whole (after a count check).
BROADCAST_ROWS = 100_000
# Hot keys broadcast with their dimension rows beyond that bound.
HOT_KEYS = 4096


def split_hot_join(left: DataFrame, on: str, hot_keys: DataFrame, dim: DataFrame,
                   how: str = "inner", tasks: int = 0) -> DataFrame:
    """Inner (or left) join of ``left`` with ``dim`` (unique on ``on``).

    ``hot_keys`` (column ``on``, at most a fixed number of rows) names the heavy
    keys.  Left rows are routed by one broadcast left join against them: hot
    rows join the dimension rows of the hot keys (a broadcast head of at most
    as many rows; hot keys missing from ``dim`` drop out of an inner join and
    keep NULLs in a left join), the others are shuffle-joined with ``dim``.
    In a left join, rows with a NULL key can match nothing: they go with the
    hot rows, so they skip the shuffle, where they would all meet in one
    partition.  There the routing reads both sides of the broadcast join, so
    no filter on a computed key is pushed below it and worked out again a row.
    With ``tasks`` both sides of the shuffle join are dealt by key to that many
    partitions, which are not coalesced.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    keys = hot_keys.select(on)
    marked = left.join(F.broadcast(keys.withColumn(_HOT, F.lit(True))), on, "left")
    head = dim.join(F.broadcast(keys), on)
    if how == "left":
        no_shuffle = F.coalesce(F.col(_HOT), F.col(on).isNull())
        hot, cold = marked.filter(no_shuffle), marked.filter(~no_shuffle)
    else:
        hot, cold = marked.filter(F.col(_HOT).isNotNull()), marked.filter(F.col(_HOT).isNull())
    cold = cold.drop(_HOT)
    if tasks:
        cold, dim = cold.repartition(tasks, on), dim.repartition(tasks, on)
    return hot.drop(_HOT).join(F.broadcast(head), on, how).unionByName(cold.join(dim, on, how))


def split_by_key_join(left: DataFrame, on: str, dim: DataFrame, is_hot) -> DataFrame:
    """Inner join of ``left`` with ``dim`` (unique on ``on``) where the hot keys
    are those satisfying the column predicate ``is_hot`` (a fixed, bounded key
    range such as ``rank <= K``).  The hot part of ``dim`` is broadcast; the
    rest of both sides is shuffle-joined.  No join is needed to route rows."""
    hot = left.filter(is_hot).join(F.broadcast(dim.filter(is_hot)), on)
    cold = left.filter(~is_hot).join(dim.filter(~is_hot), on)
    return hot.unionByName(cold)


def heaviest_keys(df: DataFrame, on: str, k: int) -> DataFrame:
    """The ``k`` non-NULL keys with the most rows (a top-k report; ties by key).

    NULL keys never match an equi-join.  Map-side combining leaves one row of
    them a task; they sort last and fall out after the cut, so a computed key
    is worked out once a row, not again in a filter below the count.
    """
    counts = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.col(on).isNull(), F.col("_n").desc(), F.col(on)).limit(k)
    return top.filter(F.col(on).isNotNull()).select(on)


def dimension_join(facts: DataFrame, dim: DataFrame, on: str, dim_rows: int,
                   broadcast_rows: int | None = None, hot_keys: int | None = None,
                   write_facts: bool = True, how: str = "inner", tasks: int = 0) -> DataFrame:
    """Many-to-one inner (or left) join of ``facts`` with ``dim`` (unique on ``on``).

    ``dim_rows`` is a proven bound of the dimension's row count (e.g. the
    product count).  Within ``broadcast_rows`` the dimension is broadcast.
    Beyond it the facts are read twice: once for their ``hot_keys`` heaviest
    keys (a key-sized partial aggregation), which are broadcast with their
    dimension rows, and once for the join, where every other key holds at most
    ``|facts| / hot_keys`` rows and is shuffle-joined.  Computed facts are
    written once first (``write_facts``); a plain table scan is cheaper to
    read again than to copy, so callers pass ``write_facts=False`` for it.
    ``tasks`` bounds what a task of the shuffle join sorts (see ``split_hot_join``).
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    k = HOT_KEYS if hot_keys is None else hot_keys
    if dim_rows <= limit:
        return facts.join(F.broadcast(dim), on, how)
    if write_facts:
        facts = materialize(facts, "facts")
    return split_hot_join(facts, on, heaviest_keys(facts, on, k), dim, how, tasks)
