"""Making the package known to Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that it needs no installation there."""
    context = spark.sparkContext
    if getattr(context, "_strandframe_shipped", False):
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "strandframe.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name, p.relative_to(top)))
    context.addPyFile(str(to))
    context._strandframe_shipped = True
