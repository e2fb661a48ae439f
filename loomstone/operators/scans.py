"""Scans of a tenant's rows: whole, by page and by key. Record policy does not apply to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.errors import InvalidCursor


def tenant(rows: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's rows; on a table partitioned by tenant only its files are read."""
    return rows.where(F.col("tenant_id") == tenant_id)


def offset_of(cursor: str | None) -> int:
    """The offset that a plain cursor names."""
    if cursor is None:
        return 0
    if not cursor.isdecimal():
        raise InvalidCursor(f"cursor {cursor!r} is not an offset")
    return int(cursor)


def page(rows: DataFrame, tenant_id: str, limit: int = 100, cursor: str | None = None) -> DataFrame:
    """One page in byte order of record_id, with ``next_cursor`` (null on the last page) on each row.

    The plan keeps ``offset + limit + 1`` rows per task, never a full sort.
    """
    at, size = offset_of(cursor), max(1, limit)
    ordered = tenant(rows, tenant_id).orderBy("record_id").offset(at).limit(size + 1)
    # The window sees one page and a row: which row is beyond it, and whether there is one, come from the same sort.
    whole = Window.orderBy("record_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = ordered.withColumn("n", F.count("*").over(whole)).withColumn("at", F.row_number().over(Window.orderBy("record_id")))
    more = F.when(F.col("n") > size, F.lit(str(at + size)))
    return numbered.where(F.col("at") <= size).withColumn("next_cursor", more).drop("n", "at")


def get(rows: DataFrame, tenant_id: str, record_id: str) -> DataFrame:
    """The row of one key, if it is there."""
    return rows.where((F.col("tenant_id") == tenant_id) & (F.col("record_id") == record_id))


def bitmap_ids(rows: DataFrame, tenant_id: str, **wanted) -> DataFrame:
    """Distinct ids of a tenant's rows with the wanted column values."""
    out = tenant(rows, tenant_id)
    for name, value in wanted.items():
        out = out.where(F.col(name) == value)
    return out.select("record_id").distinct()
