"""Makes this package importable in Python workers on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per Spark context.

    Nothing is sent where PYTHONPATH already names the repository: the workers
    inherit that variable.
    """
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_loomstone_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="loomstone-")) / "loomstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((ROOT / "loomstone").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._loomstone_shipped = True
    return spark
