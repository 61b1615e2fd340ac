"""A session with the settings that this package expects."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "satchel", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; master and sizes are left to the caller or spark-submit."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows of an Arrow batch; texts are long, and a batch is held by the JVM and the Python worker of each task.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once for each application, and bounds the session's batches."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_satchel_shipped", False):
        return
    top = Path(__file__).resolve().parent
    # The driver's own file; Spark sends it to the executors.
    made = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="satchel-")), "satchel.zip")
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(made)
    sc._satchel_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; without one, a temporary folder if everything runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="satchel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
