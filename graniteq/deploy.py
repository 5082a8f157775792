"""Making this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_graniteq_shipped"


def ship_package(spark: SparkSession) -> None:
    """Sends the package's own source to all executors, once for each Spark context.

    Workers can then import it wherever they start, with or without a PYTHONPATH.
    The driver's file server hands it out, so executors need no common folder.
    """
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it runs from an archive that was shipped already
        archive = Path(tempfile.mkdtemp(prefix="graniteq-")) / "graniteq.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
    setattr(context, _MARK, True)
