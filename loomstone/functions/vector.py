"""Cosine similarity and the freshness gate as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.model import Freshness

#: Taken off the score of a vector that is out of date.
DIRTY_PENALTY = 0.05


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a column and a fixed vector; null on another length, an empty or a zero vector."""
    v = vector.cast("array<double>")
    q = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    norm = float(sum(float(x) ** 2 for x in query) ** 0.5)
    size = F.sqrt(_dot(v, v))
    ok = (F.size(v) == len(query)) & F.lit(norm > 0) & (size > 0)
    return F.when(ok, _dot(v, q) / (size * F.lit(norm or 1.0)))


def penalty(status: Column, mode: Freshness) -> Column:
    """0 for a ready vector, the penalty for a dirty one where that is allowed, null where it may not be scored."""
    ready = F.when(status == "Ready", F.lit(0.0))
    return ready.when(status == "Dirty", F.lit(DIRTY_PENALTY)) if mode == Freshness.ALLOW_DIRTY else ready
