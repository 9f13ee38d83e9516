"""What every entry point needs of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="loamline-code-"), "loamline.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("loamline", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        # Rows may be whole documents: batches of a thousand keep Python workers small.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if app not in _shipped:
        _shipped.add(app)
    return spark


def shipped(frame: DataFrame) -> DataFrame:
    """The table, once its session's executors have this package: for operators whose workers import it."""
    ship(frame.sparkSession)
    return frame
