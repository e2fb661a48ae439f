"""Stored tables as queryable ones: JSON fields typed by role, statuses of derived vectors, policy, edges, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.cursor import Signer
from loomstone.errors import NotFound, UnknownTable
from loomstone.functions.policy import parsed
from loomstone.model import TableSpec
from loomstone.operators import versions
from loomstone.plans.hybrid import Table
from loomstone.sources.storage import Store

#: Fields that every table may have beside its declared columns.
POLICY, EDGES, VALID_FROM, VALID_TO = "policy", "edges", "valid_from", "valid_to"


def status_field(vector: str) -> str:
    """The field in which a status commit, or a checkpoint, states a vector's status."""
    return f"__status.{vector}"


def columns_of(spec: TableSpec) -> list[str]:
    """All stored columns of a table."""
    vectors = [v.name for v in spec.vectors]
    return list(dict.fromkeys([spec.id_column, spec.tenant_column, *spec.scalars, *spec.texts, *vectors, *[status_field(v) for v in vectors], POLICY, EDGES, VALID_FROM, VALID_TO]))


def spec_of(store: Store, name: str) -> TableSpec:
    raw = store.manifest()["tables"].get(name)
    if raw is None:
        raise UnknownTable(f"no table {name!r}")
    return TableSpec.from_dict(raw)


def statuses(commits: DataFrame, spec: TableSpec) -> DataFrame:
    """``tenant_id, record_id, feature_status`` after the commits given."""
    last = Window.partitionBy(*versions.KEY).orderBy(F.col("epoch").desc(), F.col("ordinal").desc())
    rows = commits
    named = []
    for v in spec.vectors:
        has = lambda c: F.coalesce(F.col("fields")[c], F.lit("null")) != "null"
        source = F.lit(False)
        for s in v.sources:
            source = source | F.map_contains_key("fields", F.lit(s))
        folded = versions.feature_states(rows.drop("generation", "status"), has(v.name), source, F.col("fields")[status_field(v.name)])
        rows = folded.withColumn(f"status_{v.name}", F.col("status"))
        named += [F.lit(v.name), F.col(f"status_{v.name}")]
    made = F.create_map(*named) if named else F.create_map().cast("map<string,string>")
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select(*versions.KEY, made.alias("feature_status"))


def text_of(column: str) -> Column:
    """A text column's string; null where the field is not a JSON string."""
    return F.when(F.col(column).startswith('"'), F.variant_get(F.try_parse_json(F.col(column)), "$", "string"))


def with_sealed(hot: DataFrame, sealed: DataFrame, touched: DataFrame) -> DataFrame:
    """Live rows, and sealed rows of keys that the log does not know: a record that is both counts once, a deleted one not at all.

    Of several sealed versions of a key the newest counts. ``touched`` has the
    key of every record that a commit names, deletes too.
    """
    key = list(versions.KEY)
    newest = Window.partitionBy(*key).orderBy(F.col("version_id").desc())
    rest = sealed.join(touched.select(*key).distinct(), key, "left_anti").withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    return hot.unionByName(rest, allowMissingColumns=True)


def open_table(store: Store, name: str, epoch: int | None = None, signer: Signer | None = None) -> Table:
    """The table as a reader of ``epoch`` (latest if null) queries it: live records and published segments' further ones.

    Scalars are variants, so that equality is that of JSON values; texts that
    are not JSON strings are null and not searched; vectors are arrays of floats.
    """
    spec = spec_of(store, name)
    columns = columns_of(spec)
    commits = store.history(name, columns, epoch)
    state = versions.state_at(commits, None, columns).join(statuses(commits, spec), list(versions.KEY))
    held = 0
    try:
        sealed = store.segment_rows(name)
        held = sum(name in s["tables"] for s in store.manifest()["segments"])
    except NotFound:
        sealed = None
    if sealed is not None:
        if epoch is not None:
            sealed = sealed.where(F.col("version_id") <= epoch)
        known = [F.col(f"`{c}`") if c in sealed.columns else F.lit(None).cast("string").alias(c) for c in columns]
        ready = [x for v in spec.vectors for x in (F.lit(v.name), F.when(F.col(v.name).isNotNull(), "Ready").otherwise("Missing"))]
        status = F.create_map(*ready) if ready else F.create_map().cast("map<string,string>")
        sealed = sealed.select("tenant_id", "record_id", F.col("version_id").cast("long").alias("version_id"), *known).withColumn("feature_status", status)
        state = with_sealed(state.select(*versions.KEY, "version_id", *[F.col(f"`{c}`") for c in columns], "feature_status"), sealed, store.history(name, columns))
    rows = state.select(
        "record_id", "tenant_id", "version_id", F.col("version_id").alias("begin_epoch"), F.lit(None).cast("long").alias("end_epoch"), F.lit(None).cast("string").alias("tombstone"),
        *[F.try_parse_json(F.col(s)).alias(s) for s in spec.scalars], *[text_of(t).alias(t) for t in spec.texts], *[F.from_json(v.name, "array<float>").alias(v.name) for v in spec.vectors],
        "feature_status", parsed(F.col(POLICY), F.col("tenant_id")).alias("policy"), F.from_json(EDGES, "array<string>").alias("edges"),
        F.expr(f"try_cast({VALID_FROM} AS BIGINT)").alias("valid_from"), F.expr(f"try_cast({VALID_TO} AS BIGINT)").alias("valid_to"),
    )
    table = Table(rows, spec, signer=signer)
    table.segments = held
    return table
