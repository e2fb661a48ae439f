"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='loomstone-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    A lost executor costs a re-read of these files only. The files go when the
    application ends; the shuffle files behind them, which nothing reads again,
    when they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomstone-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def private(columns: list[str]) -> list[str]:
    """A name of our own for each column of an input, so that none can clash with names that an operator adds."""
    return [f"__in{i}" for i in range(len(columns))]


def appended(df: DataFrame, of: str, columns: dict[str, str], make, *keep) -> DataFrame:
    """``df`` with new columns, made in Arrow batches from column ``of``; an input column of such a name is replaced.

    ``make`` takes the column of a batch and yields ``i, j`` and the new columns
    of its rows ``[i, j)``, so a worker holds one batch and one slice's results.
    The input goes through under private names: no name of its own can clash.
    """
    kept = [c for c in df.columns if c not in columns or c == of]
    names, at = private(kept), kept.index(of)

    def batches(it):
        for batch in it:
            for i, j, new in make(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], [*names, *columns])

    sent = df.select(*[quoted(c).alias(n) for c, n in zip(kept, names, strict=True)])
    schema = sent.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in columns.items()]).schema
    out = sent.mapInArrow(trimmed(batches, *keep), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True) if c not in columns], *columns)


def bounded(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Arrow batches of at most ``rows`` rows: long texts must fit a Python worker several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return spark


#: Caches of large values that operators keep in a worker.
CACHES: list = []


def cached(function):
    """``function.cache_clear`` is called when a task of another operator starts in the same worker."""
    CACHES.append(function)
    return function


def trimmed(batches, *keep):
    """``batches`` as a worker runs it, giving freed memory back to the system when a task ends.

    Workers live on between tasks and stages; what one stage has freed or keeps
    for itself must not stand beside what the next one needs. The caches in
    ``keep`` stay, all other registered ones are emptied first.
    """

    def run(it):
        for cache in CACHES:
            if all(cache is not k for k in keep):
                cache.cache_clear()
        try:
            yield from batches(it)
        finally:
            _free()

    return run


def freeing(table):
    """The same for a function of one group."""

    def run(group):
        try:
            return table(group)
        finally:
            _free()

    return run


def _free() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
