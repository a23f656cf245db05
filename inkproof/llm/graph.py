"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.llm.shared import cut


def _least(links: DataFrame) -> DataFrame:
    """Per node, its smallest neighbour; the key is renamed so that the join below gets an exchange of its own."""
    return links.groupBy("u").agg(F.min("v").alias("least")).select((F.col("u").bitwiseXOR(F.lit(1))).alias("w"), "least")


def _joined(links: DataFrame) -> DataFrame:
    return links.join(_least(links), F.col("u").bitwiseXOR(F.lit(1)) == F.col("w"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbours and itself."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _joined(both).where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node move to the smallest of them (links go from u to a smaller v)."""
    moved = _joined(links).select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Alternating large and small stars, a round per checkpoint, until a round changes nothing; the
    rounds grow with the logarithm of the longest path.  Self-links and repeated links are allowed.
    """
    start = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, before = cut(start.distinct()), None
    while True:
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
