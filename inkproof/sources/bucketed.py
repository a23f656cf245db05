"""Inputs laid out by their document key, so that what joins and groups by it needs no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_BUCKET = 100_000


def bucket_count(rows: int, least: int = 16) -> int:
    """Buckets for a table of so many rows: a bucket is a task, so it must not grow with the table."""
    return max(least, -(-rows // ROWS_A_BUCKET))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket that a whole number as key goes to."""
    return F.pmod(F.hash(key.cast("bigint")), F.lit(buckets))


def write_bucketed(
    frame: DataFrame,
    table: str,
    path: str,
    *,
    key: str = "doc_id",
    buckets: int = 200,
    mode: str = "overwrite",
    compression: str | None = None,
) -> DataFrame:
    """The frame as a table of ``buckets`` by the hash of ``key``, a sorted file each, below ``path``; and the table read again.

    Tables that are joined need the same number of buckets (or multiples) and the same type of key.  A row with a null
    key goes to one bucket.  A table of that name is replaced, or with ``mode="append"`` added to: a table may be written some
    buckets (``bucket_of``) at a time.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    # dealt as the buckets are, so a task writes one file
    dealt = frame.repartition(buckets, key)
    options = {"path": path} | ({"compression": compression} if compression else {})
    dealt.write.mode(mode).bucketBy(buckets, key).sortBy(key).options(**options).saveAsTable(table)
    return frame.sparkSession.table(table)


def drop_tables(frame: DataFrame, tables: Sequence[str]) -> None:
    """Forget the tables; their files stay below their paths."""
    for table in tables:
        frame.sparkSession.sql(f"drop table if exists `{table}`")
