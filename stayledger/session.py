"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings the library is written for. Joins carry no strategy hints except where
# a size was checked, so the choice stays with the statistics and AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "stayledger") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="stayledger-")


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and stream checkpoints.

    It is the folder named by ``spark.checkpoint.dir``. Only a local master may
    go without that setting; each application then gets one temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that no earlier run has used."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
