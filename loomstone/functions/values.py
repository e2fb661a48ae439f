"""Hashes, validity ranges and state rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of a derived feature in its lifecycle, and the modes in which it may be asked for.
FEATURE_STATUSES = ("Ready", "Dirty", "Pending", "Failed", "Stale", "Deprecated", "Missing")
FEATURE_MODES = ("Strict", "Lazy", "AllowDirty", "OnRead", "AllowStale")
MAX_ATTEMPTS = 3


def usable(status: Column, mode: Column) -> Column:
    """Whether a feature in ``status`` serves a request in ``mode``; an unknown mode is never served."""
    return (
        F.when(mode == "Strict", status == "Ready")
        .when(mode.isin("Lazy", "AllowDirty"), status.isin("Ready", "Dirty"))
        .when(mode == "OnRead", status != "Failed")
        .when(mode == "AllowStale", ~status.isin("Failed", "Deprecated"))
        .otherwise(F.lit(False))
    )


def body_hash(text: Column) -> Column:
    """``sha256:`` and the hexadecimal digest of the text's bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def source_hash(columns: Sequence[tuple[str, Column]]) -> Column:
    """Hexadecimal digest over ``name=value`` pairs, each ended by a zero byte.

    Values are JSON text; a missing value adds nothing after the equals sign.
    """
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("")), F.lit("\0")) for name, value in columns]
    return F.sha2(F.concat(*parts), 256)


def contains_epoch(begin: Column, end: Column, at: Column) -> Column:
    """Whether a closed range holds a point; a null begin is 0, a null end is open."""
    return (F.coalesce(begin, F.lit(0)) <= at) & (end.isNull() | (at <= end))


def leasable(status: Column, lease_until: Column, not_before: Column, now: Column) -> Column:
    """A queued job, a failed one whose next attempt is due, or a leased or running one whose lease has run out."""
    due = (status == "FailedRetryable") & (not_before.isNull() | (not_before <= now))
    lapsed = status.isin("Leased", "Running") & (lease_until <= now)
    return F.coalesce((status == "Queued") | due | lapsed, F.lit(False))


def after_failure(attempts: Column, permanent: Column, most: int = MAX_ATTEMPTS) -> Column:
    """Status of a job that has failed after ``attempts`` leases."""
    return F.when(permanent, F.lit("FailedPermanent")).when(attempts >= most, F.lit("DeadLettered")).otherwise(F.lit("FailedRetryable"))
