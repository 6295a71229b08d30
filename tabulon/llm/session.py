"""What the operators need of a session: shared scratch tables and the code
of this package on the executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' path, once a context."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    where = tempfile.mkdtemp()  # read by the driver's own file server alone
    atexit.register(shutil.rmtree, where, True)
    name = os.path.join(where, f"{root.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it
    is unset (tests in one process), a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Tables written to the shared folder.  They are read back rather than
    recomputed when an executor is lost."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.base = spark, f"{shared(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.remove)  # results are read by the caller, so they go last

    def remove(self) -> None:
        """Delete all tables, unless the session has ended."""
        if self.spark.sparkContext._jsc is not None:
            self.delete(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let the JVM release the
        shuffle files of finished jobs."""
        for name in names:
            self.delete(self.path(name))
        for _ in range(2):  # the first collection frees what holds the files' owners, the second these
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.4)

    def delete(self, at: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def parallel(spark: SparkSession, df: DataFrame, floor: int = 1) -> int:
    """Shuffle partitions for what follows: the session's own setting."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))
