"""SparkSession construction with the settings every operator assumes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "tessera", cores: str | int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the submitter's settings win.

    Adaptive execution is on (run-time coalescing and skew-join splitting) and the
    session time zone is UTC so that timestamps compare equal across engines.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    n = os.cpu_count() if cores == "*" else int(cores)
    base = {
        "spark.sql.shuffle.partitions": str(max(8, n or 8)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, whatever their working folder and search path; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-package-")  # the driver serves it as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tessera_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"tessera/{path.relative_to(root).as_posix()}")
    sc.addPyFile(archive)
    sc._tessera_shipped = True
