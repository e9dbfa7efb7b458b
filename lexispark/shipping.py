"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lexispark-")) / "lexispark.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"lexispark/{p.relative_to(root)}")
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
