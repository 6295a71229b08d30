"""The code of this package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the context's files, once; in one process it is there."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE or sc.master.startswith("local[") or sc.master == "local":
        return
    root = Path(__file__).resolve().parent
    where = tempfile.mkdtemp()  # read by the driver's own file server alone
    atexit.register(shutil.rmtree, where, True)
    name = os.path.join(where, f"{root.name}-core.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(name)
    _DONE.add(sc.applicationId)
