"""Versioned tables: commits folded into versions, and the rows visible at an epoch.

A commit row is ``tenant_id, record_id, epoch, ordinal, op, fields`` with op
``put``, ``patch``, ``delete`` or ``status`` and fields a map from column to
JSON text. A key present with a null value is an explicit null; a missing key
leaves the column as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = ("tenant_id", "record_id")


def _order() -> WindowSpec:
    """Within a key, the order of changes."""
    return Window.partitionBy(*KEY).orderBy("epoch", "ordinal")


def with_generation(commits: DataFrame) -> DataFrame:
    """Adds ``generation``: a put or a delete begins a new one, patches belong to the last."""
    starts = F.when(F.col("op").isin("put", "delete"), 1).otherwise(0)
    return commits.withColumn("generation", F.sum(starts).over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def versions(commits: DataFrame) -> DataFrame:
    """``tenant_id, record_id, version_id, begin_epoch, end_epoch, op, tombstone`` of every version that can be seen.

    The next change of a key ends a version. Of several changes in one epoch
    the last one stands: the earlier ones begin and end together.
    """
    chained = commits.withColumn("end_epoch", F.lead("epoch").over(_order()))
    return chained.where("end_epoch is null or end_epoch > epoch").select(
        *KEY, F.col("epoch").alias("version_id"), F.col("epoch").alias("begin_epoch"), "end_epoch", "op", F.when(F.col("op") == "delete", F.lit("user_delete")).alias("tombstone")
    )


def visible_at(rows: DataFrame, epoch: int) -> DataFrame:
    """Versions that a reader at ``epoch`` sees."""
    return rows.where((F.col("begin_epoch") <= epoch) & (F.col("end_epoch").isNull() | (F.col("end_epoch") > epoch)) & F.col("tombstone").isNull())


def tombstoned_at(rows: DataFrame, epoch: int) -> DataFrame:
    """Keys whose latest version at ``epoch`` is a tombstone."""
    current = rows.where((F.col("begin_epoch") <= epoch) & (F.col("end_epoch").isNull() | (F.col("end_epoch") > epoch)))
    return current.where("tombstone is not null").select(*KEY)


def sealed_minus_tombstones(sealed: DataFrame, rows: DataFrame, epoch: int) -> DataFrame:
    """Sealed rows without the keys deleted since."""
    return sealed.join(tombstoned_at(rows, epoch), list(KEY), "left_anti")


def merged(commits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every change with the merged value of each column so far in its generation.

    A put replaces all columns, a patch those that it names; explicit nulls
    stay. One shuffle on the key serves all columns.
    """
    rows = with_generation(commits)
    within = Window.partitionBy(*KEY, "generation").orderBy("epoch", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    named = [F.last(F.when(F.map_contains_key("fields", F.lit(c)), F.struct(F.col("fields")[c].alias("v"))), ignorenulls=True).over(within)["v"].alias(c) for c in columns]
    return rows.select(*KEY, "epoch", "ordinal", "op", "generation", *named)


def state_at(commits: DataFrame, epoch: int | None, columns: Sequence[str]) -> DataFrame:
    """Live records at ``epoch`` (latest if null): ``tenant_id, record_id, version_id`` and the merged columns."""
    seen = commits if epoch is None else commits.where(F.col("epoch") <= epoch)
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("epoch").desc(), F.col("ordinal").desc()))
    rows = merged(seen, columns).withColumn("n", last).where("n = 1 and op <> 'delete'")
    return rows.select(*KEY, F.col("epoch").alias("version_id"), *[F.col(f"`{c}`") for c in columns])


def as_commits(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A state as put commits, to replay later commits onto."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))
    return state.select(*KEY, F.col("version_id").alias("epoch"), F.lit(0).cast("long").alias("ordinal"), F.lit("put").alias("op"), pairs.alias("fields"))


def recovered(checkpoint: DataFrame, checkpoint_epoch: int, commits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """State of a checkpoint and the commits after it."""
    tail = commits.where(F.col("epoch") > checkpoint_epoch).select(*KEY, "epoch", "ordinal", "op", "fields")
    return state_at(as_commits(checkpoint, columns).unionByName(tail), None, columns)


def feature_states(commits: DataFrame, has_vector: Column, has_source: Column, override: Column | None = None) -> DataFrame:
    """Changes with ``status`` of a derived vector after each.

    A vector makes it Ready, a new source value without one Dirty, any other
    change leaves it; ``override`` (null: none) sets it outright. A generation
    begins with Missing.
    """
    rows = with_generation(commits)
    said = F.when(has_vector, F.lit("Ready")).when(has_source, F.lit("Dirty"))
    if override is not None:
        said = F.coalesce(override, said)
    within = Window.partitionBy(*KEY, "generation").orderBy("epoch", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("status", F.coalesce(F.last(said, ignorenulls=True).over(within), F.lit("Missing")))


def identity_violations(rows: DataFrame, id_column: str, tenant_column: str) -> DataFrame:
    """Rows whose id or tenant column disagrees with the header or is empty."""
    wrong = ~F.col(id_column).eqNullSafe(F.col("record_id")) | ~F.col(tenant_column).eqNullSafe(F.col("tenant_id")) | (F.coalesce(F.col(id_column), F.lit("")) == "")
    return rows.where(wrong)


def dimension_violations(rows: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Rows whose vector has another length than declared."""
    return rows.where(F.col(column).isNotNull() & (F.size(column) != dimensions))


def invalidations(commits: DataFrame, vectors: Mapping[str, Sequence[str]]) -> DataFrame:
    """``tenant_id, record_id, epoch, ordinal, feature, status``: what each put or patch makes stale.

    A vector becomes dirty by a change that names one of its sources and not the
    vector itself. One pass, no shuffle.
    """
    named = []
    for vector, sources in vectors.items():
        touched = F.lit(False)
        for source in sources:
            touched = touched | F.map_contains_key("fields", F.lit(source))
        named.append(F.when(touched & ~F.map_contains_key("fields", F.lit(vector)), F.lit(vector)))
    features = F.filter(F.array(*named), lambda x: x.isNotNull()) if named else F.array().cast("array<string>")
    rows = commits.where(F.col("op").isin("put", "patch")).select(*KEY, "epoch", "ordinal", F.explode(features).alias("feature"))
    return rows.withColumn("status", F.lit("Dirty"))
