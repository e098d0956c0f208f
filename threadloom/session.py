"""Session helpers: table loading, shared scratch tables and code shipping."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers when nothing else does.

    Workers inherit ``PYTHONPATH`` and, in local mode, the working directory; only if the package's
    parent is on neither is a zip handed to ``addPyFile``.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    known = {str(Path(p or ".").resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if str(root) in known or (local and Path.cwd().resolve() == root):
        return
    archive = Path(tempfile.mkdtemp()) / "threadloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (root / "threadloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the session names one.

    Where it is unset (single-machine tests), a temporary folder is chosen once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    chosen = getattr(spark.sparkContext, "_threadloom_dir", None)
    if chosen is None:
        chosen = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext._threadloom_dir = chosen
    return chosen


class Scratch:
    """Written tables that cut lineage.

    ``save`` computes a frame once, writes it as parquet below the shared folder and returns a frame
    reading it back, so a lost executor costs a re-read and never a recomputation of the whole plan.
    Tables are dropped by ``drop`` or when the driver process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/threadloom/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._remove, self.base)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._threadloom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path = getattr(f, "_threadloom_path", None)
            if path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            if path.startswith("file://") and "shutil" in sys.modules:
                sys.modules["shutil"].rmtree(path[7:], ignore_errors=True)
