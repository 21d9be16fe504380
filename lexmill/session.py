"""Session settings and the few helpers that need a running session."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def make_session(app: str = "lexmill", **conf: str) -> SparkSession:
    """A session with the library's defaults; a running one is reused.

    ``LEXMILL_MASTER`` names the master (``local[*]`` when unset).  Values in
    ``conf`` override the defaults; underscores stand for dots.
    """
    builder = SparkSession.builder.appName(app)
    if SparkSession.getActiveSession() is None:
        builder = builder.master(os.environ.get("LEXMILL_MASTER", "local[*]"))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    A cluster sets ``spark.checkpoint.dir``.  Only a local session that names
    none gets a temporary folder; elsewhere a missing setting is an error,
    since a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexmill-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later reads start from there.

    Spark removes the files with the last reference to them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``make_session`` does.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of tasks that a shuffle of this session has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lexmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexmill-package-")
    staged = Path(folder) / "staged"
    shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder) / f"{package.name}-package"), "zip", staged))
    sc._lexmill_shipped = True
