"""Commits as a stream: state kept up to date by micro-batches, and late duplicates dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomstone.operators import versions
from loomstone.sources.storage import COMMIT_SCHEMA


def read(spark: SparkSession, path: str, schema: str = COMMIT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder of commits, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def idempotent(commits: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Commits whose key has not been seen within the watermark: state is bounded by the delay that is allowed."""
    return commits.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def maintain(commits: DataFrame, target: str, columns: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the live state of a commit stream under ``target``.

    Batch ``n`` reads state ``n - 1``, applies its commits and writes state ``n``
    beside it; a repeated batch overwrites its own folder, so a restart changes
    nothing. Older states go, all but the one before.
    """
    spark = commits.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        from loomstone.sources.storage import Files

        files = Files(spark, target)
        done = [int(n) for n in files.names("") if n.isdecimal() and int(n) < number and files.exists(f"{n}/_SUCCESS")]
        changes = batch.select("tenant_id", "record_id", "epoch", "ordinal", "op", "fields")
        if done:
            state = spark.read.parquet(f"{target}/{max(done)}")
            changes = versions.as_commits(state, columns).unionByName(changes)
        versions.state_at(changes, None, columns).write.mode("overwrite").parquet(f"{target}/{number}")
        for old in sorted(done)[:-1]:
            files.delete(str(old))

    return commits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete state."""
    from loomstone.sources.storage import Files

    files = Files(spark, target)
    done = [int(n) for n in files.names("") if n.isdecimal() and files.exists(f"{n}/_SUCCESS")]
    return spark.read.parquet(f"{target}/{max(done)}")


def windowed_usage(events: DataFrame, at: str, kind: str, units: str, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Units per kind and window of event time; rows later than the watermark are dropped.

    ``late`` is null for a stream that has its watermark.
    """
    marked = events if late is None else events.withWatermark(at, late)
    return marked.groupBy(F.window(at, width).alias("window"), F.col(kind).alias("kind")).agg(F.sum(units).alias("units"))
