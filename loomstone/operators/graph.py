"""Edges: visible neighbours and validity ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbors(edges: DataFrame, source, visible: Column) -> DataFrame:
    """Distinct targets of the visible edges of a node, in order."""
    return edges.where((F.col("src") == source) & visible).select("dst").distinct().orderBy("dst")


def all_neighbors(edges: DataFrame, visible: Column) -> DataFrame:
    """Distinct visible targets of every node."""
    return edges.where(visible).select("src", "dst").distinct()


def any_range_holds(ranges: Column, at: Column) -> Column:
    """Whether some closed range of an array of ``begin, end`` structs holds the point; a null end is open."""
    return F.exists(ranges, lambda r: (F.coalesce(r["begin"], F.lit(0)) <= at) & (r["end"].isNull() | (at <= r["end"])))
