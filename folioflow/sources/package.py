"""The package on the executors: Python workers import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_known: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application.

    Spark's own file server hands the archive out; executors never read the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _known:
        return
    _known.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # imported from an archive: it has been sent
        return
    archive = Path(tempfile.mkdtemp(prefix="folioflow-")) / "folioflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
