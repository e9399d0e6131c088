"""Makes this package importable in Python workers that do not share its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of whole texts that an Arrow batch holds at most; long texts are many bytes.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Arrow batches are kept short too, as their rows hold whole texts.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    file = os.path.join(tempfile.mkdtemp(prefix="isoreach-"), "isoreach_package.zip")
    with zipfile.ZipFile(file, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(file)
    _shipped.add(app)
