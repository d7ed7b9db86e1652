"""Prepares a session: ships this package to its Python workers, and keeps what they are sent at a time small."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows in one Arrow batch to or from a Python worker: texts may be long, and two workers share an executor's memory.
ARROW_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: workers can then import the package wherever they run and whatever their path is.

    It lowers the session's Arrow batch size to ARROW_ROWS for whatever runs there later, as frames are evaluated later.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.NamedTemporaryFile(prefix="querysieve-", suffix=".zip", delete=False) as f:
            with zipfile.ZipFile(f, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, os.path.join(root.name, p.relative_to(root)))
        sc.addPyFile(f.name)  # workers fetch it from here as long as the driver runs
        atexit.register(lambda: os.path.exists(f.name) and os.unlink(f.name))
        _shipped.add(sc.applicationId)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(ARROW_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    return spark
