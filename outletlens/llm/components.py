"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of ``links`` (a, b).

    Every vertex points to a smaller or equal vertex.  In a round each vertex,
    and the vertex it points to, take the smallest pointer seen over its links;
    then pointers are followed twice.  Rounds grow with the logarithm of a
    component's size.  A vertex with very many links is one row of the pointer
    table and partial minima on the link side, so no task holds its links.
    Each round is written out, so lost executors cost one round.
    """
    links = links.filter("a <> b")
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    at = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("id"), "p")
    at = materialize(at, "pointers")
    while True:
        seen = both.join(at.select(F.col("id").alias("b"), "p"), "b").groupBy("a").agg(F.min("p").alias("m"))
        near = at.join(seen.withColumnRenamed("a", "id"), "id")
        offers = near.select("id", F.least("p", "m").alias("p"), F.lit(False).alias("own")).union(near.filter("m < p").select(F.col("p").alias("id"), F.col("m").alias("p"), F.lit(False).alias("own")))
        offers = offers.union(at.select("id", "p", F.lit(True).alias("own")))
        new = offers.groupBy("id").agg(F.min("p").alias("p"), F.min(F.when(F.col("own"), F.col("p"))).alias("was"))
        new = materialize(new, "pointers")
        to = new.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        new = new.join(to, "p").select("id", F.col("pp").alias("p"), "was")
        new = materialize(new, "pointers")
        changed = new.filter("p <> was").limit(1).count()
        at = new.select("id", "p")
        if not changed:
            return at.select("id", F.col("p").alias("component"))
