"""Session settings and shipping of the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine expects of a session: UTC times, adaptive plans, Arrow transfer.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", app: str = "sparkwell", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session with the engine's settings; on a cluster pass the master and the shared checkpoint folder."""
    b = SparkSession.builder.master(master).appName(app)
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | more
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run. Does nothing the second time."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkwell_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="sparkwell-zip-")) / "sparkwell.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._sparkwell_shipped = True
