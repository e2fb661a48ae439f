"""Record policy as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.model import POLICY, VISIBILITIES, Actor

#: Members that a policy may lack.
OPTIONAL = ("workspace_id", "owner_id")


def default_policy(tenant: Column) -> Column:
    """The policy of a record that states none: visible to its tenant."""
    return F.struct(
        tenant.alias("tenant_id"), F.lit(None).cast("string").alias("workspace_id"), F.lit(None).cast("string").alias("owner_id"),
        F.lit("Tenant").alias("visibility"), F.array().cast("array<struct<user_id:string,allow:boolean>>").alias("acl"), F.lit("normal").alias("sensitivity"),
        F.struct(F.lit(None).cast("bigint").alias("retain_until_epoch"), F.lit(False).alias("legal_hold")).alias("retention"),
        F.lit(False).alias("suppress_from_ai"), F.lit(True).alias("allow_embedding"), F.lit(False).alias("allow_training"),
    )


def parsed(policy_json: Column, tenant: Column) -> Column:
    """A policy from JSON text. Absent or malformed text falls back to the default: the reading fails open."""
    p = F.from_json(policy_json, POLICY)
    required = [p[f.name].isNotNull() for f in POLICY.fields if f.name not in OPTIONAL]
    entries = ~F.exists(p["acl"], lambda e: e.isNull() | e["user_id"].isNull() | e["allow"].isNull())
    whole = reduce(lambda a, b: a & b, [*required, p["retention"]["legal_hold"].isNotNull(), entries, p["visibility"].isin(*VISIBILITIES)])
    return F.when(F.coalesce(whole, F.lit(False)), p).otherwise(default_policy(tenant))


def deny_reasons(policy: Column, actor: Actor) -> Column:
    """Array of the reasons why ``actor`` may not see a record; empty means visible."""
    p = policy
    listed = F.exists(F.coalesce(p["acl"], F.array().cast("array<struct<user_id:string,allow:boolean>>")), lambda e: F.coalesce(e["allow"] & (e["user_id"] == F.lit(actor.user_id)), F.lit(False)))
    reasons = [
        F.when(~p["tenant_id"].eqNullSafe(F.lit(actor.tenant_id)), F.lit("tenant_mismatch")),
        F.when(p["visibility"] == "Hidden", F.lit("hidden")),
        F.when((p["visibility"] == "Acl") & ~listed, F.lit("acl_denied")),
        F.when(p["suppress_from_ai"], F.lit("suppress_from_ai")),
    ]
    return F.array_compact(F.array(*reasons))


def visible(policy: Column, actor: Actor) -> Column:
    """Whether ``actor`` may see a record; a null policy is the default one of the actor's tenant."""
    return policy.isNull() | (F.size(deny_reasons(policy, actor)) == 0)
