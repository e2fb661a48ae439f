"""Folds over operational events: jobs, idempotency, usage, suppression, activation, commits per branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import values


def first_per_key(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first event of each key: what an idempotent enqueue or commit keeps.

    A combined minimum by key, so a hot key sends one row per task.
    """
    others = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("first")).select(*key, *[F.col(f"first.{c}").alias(c) for c in others])


def idempotent(requests: DataFrame, key: list[str], order: str, body: str) -> DataFrame:
    """Requests with ``outcome``: ``executed`` for the first of a key, ``replayed`` for the same body, else ``conflict``."""
    first = first_per_key(requests.select(*key, order, body), key, order).select(*key, F.col(order).alias("first_order"), F.col(body).alias("first_body"))
    outcome = F.when(F.col(order) == F.col("first_order"), "executed").when(F.col(body).eqNullSafe(F.col("first_body")), "replayed").otherwise("conflict")
    return requests.join(first, key).withColumn("outcome", outcome).drop("first_order", "first_body")


def final_job_states(events: DataFrame) -> DataFrame:
    """``job_id, attempts, status, lease_until, not_before`` after all events ``job_id, seq, kind, lease_until, not_before, permanent``.

    Kinds are enqueued, leased, heartbeat, completed and failed. Events before a
    job's enqueueing do not count.
    """
    opened = events.where("kind = 'enqueued'").groupBy("job_id").agg(F.min("seq").alias("opened"))
    live = events.join(opened, "job_id").where("seq >= opened")
    last = F.max_by("kind", F.when(F.col("kind").isin("enqueued", "heartbeat"), None).otherwise(F.col("seq")))
    folded = live.groupBy("job_id").agg(
        F.count_if(F.col("kind") == "leased").alias("attempts"), last.alias("last"),
        F.max_by("lease_until", F.when(F.col("kind").isin("leased", "heartbeat", "completed", "failed"), F.col("seq"))).alias("lease_until"),
        F.max_by("not_before", F.when(F.col("kind").isin("leased", "completed", "failed"), F.col("seq"))).alias("not_before"),
        F.coalesce(F.max_by("permanent", F.when(F.col("kind") == "failed", F.col("seq"))), F.lit(False)).alias("permanent"),
    )
    status = (
        F.when(F.col("last").isNull(), "Queued").when(F.col("last") == "leased", "Leased").when(F.col("last") == "completed", "Succeeded")
        .otherwise(values.after_failure(F.col("attempts"), F.col("permanent")))
    )
    return folded.select("job_id", "attempts", status.alias("status"), "lease_until", "not_before")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def usage_totals(events: DataFrame, kind: str, units: str) -> DataFrame:
    """Units per kind."""
    return events.groupBy(F.col(kind).alias("kind")).agg(F.sum(units).alias("units"))


def suppression(events: DataFrame, key: str, mode: str) -> DataFrame:
    """1.0 for a record that was ever suppressed; a later recall does not clear it."""
    return events.groupBy(F.col(key).alias("record_id")).agg(F.max(F.when(F.col(mode) == "Suppress", 1.0).otherwise(0.0)).alias("penalty"))


def activation(events: DataFrame, key: str, amount: str) -> DataFrame:
    """Sum of the positive amounts and number of events of each record."""
    return events.groupBy(F.col(key).alias("record_id")).agg(F.sum(F.greatest(F.col(amount), F.lit(0.0))).alias("level"), F.count("*").alias("count"))


def branch_epochs(commits: DataFrame, branch: str, key: str, order: str) -> DataFrame:
    """Commit numbers per branch: each key counts once, in the order of its first arrival."""
    first = first_per_key(commits.select(branch, key, order), [branch, key], order)
    return first.withColumn("epoch", F.row_number().over(Window.partitionBy(branch).orderBy(order)).cast("long"))


def recompute_queue(features: DataFrame) -> DataFrame:
    """Dirty features as jobs to enqueue, keyed so that a second enqueue changes nothing."""
    dirty = features.where("status = 'Dirty'")
    key = F.concat_ws(":", "feature_id", "record_id", "source_hash")
    return dirty.select("record_id", F.lit("GenerateEmbedding").alias("kind"), key.alias("idempotency_key"), F.lit("Pending").alias("next_status"))


def audit(rows: DataFrame, actor_id: str, query_digest: str) -> DataFrame:
    """One audit row per returned record."""
    return rows.select(F.lit(actor_id).alias("actor_id"), F.lit(query_digest).alias("query_digest"), "record_id", "version_id", F.lit("returned").alias("decision"))


def provenance(rows: DataFrame, source_type: str, source_id: str, parents: str) -> DataFrame:
    """A provenance struct beside each record."""
    made = F.struct(F.lit(source_type).alias("source_type"), F.col(source_id).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_uri"), F.col(parents).alias("parent_records"), F.lit(None).cast("string").alias("created_by"))
    return rows.withColumn("provenance", made)
