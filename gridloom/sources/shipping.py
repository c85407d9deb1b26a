"""The package's own code on the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Add the package to the Spark context's Python files, once, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"  # Spark serves it to the executors from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._gridloom_shipped = True
