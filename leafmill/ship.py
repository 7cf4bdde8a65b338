"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a session; nothing where local workers find it on PYTHONPATH."""
    sc = spark.sparkContext
    on_path = str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, "_leafmill_shipped", False) or (sc.master.startswith("local") and on_path):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="leafmill-"), "leafmill.zip")  # on the driver only; Spark's file server hands it out
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, str(f.relative_to(ROOT.parent)))
    sc.addPyFile(path)
    sc._leafmill_shipped = True
