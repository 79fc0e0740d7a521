"""Session set-up: configuration for local use, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("orrery")
    conf = _CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.driver.host": "127.0.0.1"}
    return builder.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_orrery_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="orrery-"), "orrery.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("orrery", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._orrery_shipped = True
    return spark
