"""The driver's tables as the engine's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.model import TableSpec, VectorSpec
from loomstone.plans.hybrid import Table

#: Dimensions of the embeddings table.
DIMENSIONS = 64
DOCS = TableSpec("docs", "record_id_source", "lang", ("source", "n_chars"), ("text",), (VectorSpec("embedding", DIMENSIONS, ("text",)),))
#: The same with a second text column.
FIELDED = TableSpec("docs", "record_id_source", "lang", ("n_chars",), ("text", "source"), (VectorSpec("embedding", DIMENSIONS, ("text",)),))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: tenant is the language; status, policy, edges and validity follow from the id."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    i = F.col("doc_id")
    status = F.when(F.col("embedding").isNull(), "Missing").when(i % 7 == 0, "Dirty").when(i % 11 == 0, "Pending").when(i % 13 == 0, "Failed").otherwise("Ready")
    policy = F.struct(
        F.col("lang").alias("tenant_id"), F.lit(None).cast("string").alias("workspace_id"), F.lit(None).cast("string").alias("owner_id"),
        F.when(F.col("toxic") == 1, "Hidden").when(F.col("quality") == 0, "Acl").otherwise("Tenant").alias("visibility"),
        F.array(F.struct(F.concat(F.lit("u"), (i % 10).cast("string")).alias("user_id"), F.lit(True).alias("allow"))).alias("acl"), F.lit("normal").alias("sensitivity"),
        F.struct(F.lit(None).cast("bigint").alias("retain_until_epoch"), F.lit(False).alias("legal_hold")).alias("retention"),
        (i % 17 == 0).alias("suppress_from_ai"), F.lit(True).alias("allow_embedding"), F.lit(False).alias("allow_training"),
    )
    joined = d.join(e, "doc_id", "left").join(lab, "doc_id", "left")
    return joined.select(
        i.cast("string").alias("record_id"), F.col("lang").alias("tenant_id"), F.lit(1).cast("long").alias("version_id"), F.lit(1).cast("long").alias("begin_epoch"),
        F.lit(None).cast("long").alias("end_epoch"), F.lit(None).cast("string").alias("tombstone"), "source", "n_chars", "text", "embedding",
        F.create_map(F.lit("embedding"), status).alias("feature_status"), policy.alias("policy"), F.array("source", "lang").alias("edges"),
        i.alias("valid_from"), (i + F.col("n_chars")).alias("valid_to"),
    )


def docs_table(spark: SparkSession, sf_dir: str, spec: TableSpec = DOCS) -> Table:
    return Table(docs(spark, sf_dir), spec)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of vec_id 0."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def commits(spark: SparkSession, sf_dir: str, batched: bool = False) -> DataFrame:
    """Events as commits: one epoch each, or ten to an epoch."""
    i = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("patch")
    fields = F.map_filter(
        F.create_map(
            F.lit("event_type"), F.col("event_type"), F.lit("value"), F.when(F.col("event_type") != "view", F.col("value").cast("string")),
            F.lit("props"), F.when(F.col("event_type") != "click", F.col("props")),
        ),
        lambda k, v: v.isNotNull(),
    )
    epoch = (F.floor(i / 10) + 1).cast("long") if batched else i + 1
    return table(spark, sf_dir, "events").select(
        F.lit("users").alias("table"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("user_id").cast("string").alias("record_id"),
        epoch.alias("epoch"), (i % 10 if batched else F.lit(0).cast("long")).alias("ordinal"), op.alias("op"), fields.alias("fields"),
    )


#: DuckDB: the docs binding.
DOCS_SQL = """
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS record_id, d.lang AS tenant_id, CAST(1 AS BIGINT) AS version_id, d.doc_id, d.source, d.n_chars, d.text, e.embedding,
         CASE WHEN e.embedding IS NULL THEN 'Missing' WHEN d.doc_id % 7 = 0 THEN 'Dirty' WHEN d.doc_id % 11 = 0 THEN 'Pending'
              WHEN d.doc_id % 13 = 0 THEN 'Failed' ELSE 'Ready' END AS status,
         CASE WHEN toxic = 1 THEN 'Hidden' WHEN quality = 0 THEN 'Acl' ELSE 'Tenant' END AS visibility,
         'u' || CAST(d.doc_id % 10 AS VARCHAR) AS allowed, d.doc_id % 17 = 0 AS suppressed, [d.source, d.lang] AS edges,
         d.doc_id AS valid_from, d.doc_id + d.n_chars AS valid_to
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN lab ON lab.doc_id = d.doc_id
)"""

#: DuckDB: the commits binding; ``{epoch}`` and ``{ordinal}`` are expressions of event_id.
COMMITS_SQL = """
commits AS (
  SELECT 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, CAST(user_id AS VARCHAR) AS record_id, {epoch} AS epoch, {ordinal} AS ordinal,
         CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op,
         event_type, CASE WHEN event_type <> 'view' THEN value END AS value, CASE WHEN event_type <> 'click' THEN props END AS props
  FROM events
)"""
ONE_SQL = COMMITS_SQL.format(epoch="event_id + 1", ordinal="CAST(0 AS BIGINT)")
BATCH_SQL = COMMITS_SQL.format(epoch="CAST(floor(event_id / 10) AS BIGINT) + 1", ordinal="event_id % 10")

#: DuckDB: versions, and the merged state at an epoch. ``value`` and ``props`` are null where a change does not name them.
VERSIONS_SQL = """
versions AS (
  SELECT tenant_id, record_id, epoch AS version_id, epoch AS begin_epoch, end_epoch, op, CASE WHEN op = 'delete' THEN 'user_delete' END AS tombstone
  FROM (SELECT *, lead(epoch) OVER (PARTITION BY tenant_id, record_id ORDER BY epoch, ordinal) AS end_epoch FROM commits)
  WHERE end_epoch IS NULL OR end_epoch > epoch
)"""
STATE_SQL = """
generations AS (
  SELECT *, sum(CASE WHEN op IN ('put', 'delete') THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, record_id ORDER BY epoch, ordinal ROWS UNBOUNDED PRECEDING) AS generation
  FROM commits WHERE epoch <= {at}
),
state AS (
  SELECT tenant_id, record_id, max(epoch) AS version_id, arg_max(op, epoch * 100 + ordinal) AS op,
         arg_max(event_type, epoch * 100 + ordinal) FILTER (event_type IS NOT NULL AND last_generation) AS event_type,
         arg_max(value, epoch * 100 + ordinal) FILTER (value IS NOT NULL AND last_generation) AS value,
         arg_max(props, epoch * 100 + ordinal) FILTER (props IS NOT NULL AND last_generation) AS props
  FROM (SELECT *, generation = max(generation) OVER (PARTITION BY tenant_id, record_id) AS last_generation FROM generations)
  GROUP BY tenant_id, record_id
)"""
