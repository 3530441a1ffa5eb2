"""The library in the executors' hands: tasks that unpickle its classes must be able to import them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once per context."""
    context = spark.sparkContext
    if getattr(context, "_pacelens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="pacelens-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = Path(folder) / "pacelens_code.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(bundle))
    context._pacelens_shipped = True
