"""Gets this package to Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch between executors and their Python workers, so that a batch of long texts is no
#: larger than one of short texts (but for a single longer text). A session's own setting stays.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once; without it workers could import
    the package only where it is installed or on their path. Bounds the batches sent to workers."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    own = os.path.join(folder, name)
                    z.write(own, os.path.join("folioflow", os.path.relpath(own, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
