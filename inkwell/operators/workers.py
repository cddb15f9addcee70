"""Python workers of a cluster: the package is sent to them before a function of it runs there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, as a job's --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_inkwell_shipped", False):
        return
    package = Path(__file__).parent.parent
    with zipfile.ZipFile(target := f"{tempfile.mkdtemp(prefix='inkwell-')}/inkwell_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(target)
    context._inkwell_shipped = True
