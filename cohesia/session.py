"""Session helpers: code shipping and durable cut points.

``materialise`` cuts lineage by writing Parquet into the shared folder named
by ``spark.checkpoint.dir``. Parquet is compressed and survives the loss of any
executor. A private folder is used only when the setting is absent in local mode (tests); on a cluster that is refused.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
_PRIVATE: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of any cluster (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="cohesia-code-"), "cohesia_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="cohesia-scratch-")
    return "file://" + _PRIVATE[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone
        pass


class Scratch:
    """A set of intermediate tables of one query.

    ``keep`` writes a frame and returns it reread; ``drop`` removes a table that
    later tables have replaced. What is left is removed when Python exits.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False, codec: str | None = None) -> None:
        """tidy: after each table, let the driver give up shuffle files of finished steps (for operators that shuffle much); codec: of the Parquet files."""
        self.spark = spark
        self.tidy = tidy
        self.options = {"compression": codec} if codec else {}
        self.root = f"{scratch_root(spark)}/cohesia-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        if self.tidy:  # the frames of the step before are out of reach by now, those of this one afterwards
            self.spark.sparkContext._jvm.System.gc()
        df.write.mode("overwrite").options(**self.options).parquet(path)
        if self.tidy:
            self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cohesia_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_cohesia_path", None)
        if path:
            _delete(self.spark, path)
