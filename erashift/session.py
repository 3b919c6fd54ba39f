"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Stored rounds of a loop are deleted once nothing refers to them.
_START_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def build_session(app_name: str = "erashift", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_START_CONF, **_RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on, on a session made elsewhere."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    It is named by spark.checkpoint.dir. Only a local master, where every task
    sees the same disk, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="erashift-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Store df in the shared folder and continue from the stored copy.

    Survives executor loss (the copy is on shared storage) and stops a loop's
    plan from growing.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_partitioned(df: DataFrame, keys: list[str]) -> DataFrame:
    """Shuffle and sort a table once by the key a loop joins it on, and keep it on
    the executors' disks in that layout.

    Joins on these keys then neither move nor sort it again (a stored copy
    would lose the layout). Lost blocks are rebuilt from the plan, so cut()
    the input first. The caller unpersists.
    """
    known = df.dropna(subset=keys)
    kept = known.repartition(*keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept
