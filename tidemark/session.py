"""Getting the package to the executors, and tables that several readers share."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once for each application.

    ``addPyFile`` is what ``--py-files`` does; without it, tasks can only import
    the package where it is installed on every node.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "tidemark_package")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", top, "tidemark"))
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one in local mode alone."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several readers, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
