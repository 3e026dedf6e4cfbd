"""Getting this package to the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all Python workers, once an application; no shared file system or installation is needed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="barsift-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)  # copies it
    if not spark.sparkContext.master.startswith("local"):
        atexit.register(lambda: Path(name).unlink(missing_ok=True))
    _shipped.add(app)
